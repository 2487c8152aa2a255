"""Following units across recordings: candidates, rotation, similarity, partners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.angles import circular_difference, length, vector_angle
from ..scale import cut_lineage
from .quantiles import corr_or_null, finite, quantiles
from .scan import following, number_rows, previous, running_sum, scan


def putative_matches(prob: DataFrame, units: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Pairs of a reference and another unit whose larger probability exceeds `threshold`.

    `prob` holds ``row, col, p`` (a pair that is absent has probability 0);
    `units` gives each row its ``unit_id`` and its ``side``, "ref" or "other".
    """
    ref = units.where("side = 'ref'").select(F.col("row").alias("__a"), F.col("unit_id").alias("ref_unit"))
    other = units.where("side = 'other'").select(F.col("row").alias("__b"), F.col("unit_id").alias("other_unit"))

    def oriented(row: str, col: str, name: str) -> DataFrame:
        p = prob.select(*by, F.col("row").alias(row), F.col("col").alias(col), F.col("p").alias("__p"))
        return p.join(ref, "__a", "left_semi").join(other, "__b", "left_semi").select(
            *by, "__a", "__b", *[(F.col("__p") if n == name else F.lit(None).cast("double")).alias(n)
                                 for n in ("p_ref_row", "p_other_row")])

    # both orientations in one aggregate instead of a full outer join
    both = oriented("__a", "__b", "p_ref_row").unionByName(oriented("__b", "__a", "p_other_row"))
    pairs = both.groupBy(*by, "__a", "__b").agg(
        F.coalesce(F.max("p_ref_row"), F.lit(0.0)).alias("p_ref_row"),
        F.coalesce(F.max("p_other_row"), F.lit(0.0)).alias("p_other_row"))
    hits = pairs.where(F.greatest("p_ref_row", "p_other_row") > threshold)
    hits = hits.join(ref, "__a").join(other, "__b").drop("__a", "__b")
    return with_candidate_counts(
        hits.withColumn("p_avg", (F.col("p_ref_row") + F.col("p_other_row")) / 2), by)


def with_candidate_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Add how many candidates each side of a pair has."""
    n_ref = pairs.groupBy(*by, "ref_unit").agg(F.count("*").cast("bigint").alias("n_ref_candidates"))
    n_other = pairs.groupBy(*by, "other_unit").agg(F.count("*").cast("bigint").alias("n_other_candidates"))
    return pairs.join(n_ref, [*by, "ref_unit"]).join(n_other, [*by, "other_unit"])


def estimate_rotation(candidates: DataFrame, hd_ref: DataFrame, hd_other: DataFrame, by: list[str],
                      min_pairs: int = 3) -> DataFrame:
    """Circular mean of preferred-direction differences over unambiguous tuned pairs.

    Fewer than `min_pairs` pairs give no rotation: 0 with a null resultant.
    """
    unique = candidates.where("n_ref_candidates = 1 AND n_other_candidates = 1")
    a = hd_ref.where("significant").select(F.col("unit_id").alias("ref_unit"), F.col("preferred_direction_deg").alias("__a"))
    c = hd_other.where("significant").select(F.col("unit_id").alias("other_unit"), F.col("preferred_direction_deg").alias("__b"))
    pairs = unique.join(a, "ref_unit").join(c, "other_unit")
    d = F.radians(F.col("__b") - F.col("__a"))
    sums = pairs.groupBy(*by).agg(
        F.avg(F.cos(d)).alias("__x"), F.avg(F.sin(d)).alias("__y"), F.count("*").cast("bigint").alias("n_pairs"))
    if by:
        sums = candidates.select(*by).distinct().join(sums, by, "left")
    n = F.coalesce(F.col("n_pairs"), F.lit(0))
    ok = n >= min_pairs
    turned = circular_difference(vector_angle("__x", "__y"), F.lit(0.0))
    return sums.select(*by, F.when(ok, turned).otherwise(0.0).alias("rotation_deg"),
                       F.when(ok, length("__x", "__y")).alias("resultant_length"), n.cast("bigint").alias("n_pairs"))


def tuning_similarity(pairs: DataFrame, curves_ref: DataFrame, curves_other: DataFrame, n_bins: int,
                      rotation_deg: float = 0.0) -> DataFrame:
    """Pearson r of the two curves of each pair after turning the other one back.

    A flat curve gives null. Curves hold ``unit_id, angle_bin, hz``.
    """
    shift = int(round(rotation_deg / (360.0 / n_bins)))
    a = curves_ref.select(F.col("unit_id").alias("ref_unit"), "angle_bin", F.col("hz").alias("__a"))
    back = F.pmod(F.col("angle_bin") - shift, F.lit(n_bins)).cast("bigint")
    c = curves_other.select(F.col("unit_id").alias("other_unit"), back.alias("angle_bin"), F.col("hz").alias("__b"))
    keys = ["ref_unit", "other_unit"]
    both = pairs.select(*keys).join(a, "ref_unit").join(c, ["other_unit", "angle_bin"])
    r = F.when((F.stddev_pop("__a") > 0) & (F.stddev_pop("__b") > 0), corr_or_null("__a", "__b"))
    scored = both.groupBy(*keys).agg(r.alias("similarity"))
    return pairs.join(scored, keys, "left")


def select_partners(candidates: DataFrame, by: list[str], rule: str = "probability",
                    checkpoint_dir: str | None = None) -> DataFrame:
    """One partner per reference unit and one reference unit per partner, best rank first.

    Walking down one ranking and taking every pair whose two units are still
    free is the same as repeatedly taking all pairs that are the best left for
    both of their units. Each round does that with two aggregates over the pairs
    left, so nothing is walked in one task. Rule "tuning" ranks by
    ``similarity`` with unscored pairs last.
    """
    scored = finite("similarity") if rule == "tuning" else F.lit(False)
    if rule not in ("tuning", "probability"):
        raise ValueError(f"rule must be 'tuning' or 'probability', got {rule!r}")
    lead = F.when(scored, -F.col("similarity")).otherwise(2.0) if rule == "tuning" else F.lit(2.0)
    work = candidates.withColumns({"__scored": scored, "__lead": lead.cast("double"), "__p": -F.col("p_avg")})
    order = ["__lead", "__p", "ref_unit", "other_unit"] if rule == "tuning" else ["__p", "ref_unit", "other_unit"]
    ranked = cut_lineage(number_rows(work, by, order, "rank"), checkpoint_dir)
    keys = [*by, "ref_unit", "other_unit"]
    left = ranked.select(*keys, "rank")
    taken = []
    while True:
        best_ref = left.groupBy(*by, "ref_unit").agg(F.min("rank").alias("rank"))
        best_other = left.groupBy(*by, "other_unit").agg(F.min("rank").alias("rank"))
        mutual = left.join(best_ref, [*by, "ref_unit", "rank"], "left_semi")
        mutual = cut_lineage(mutual.join(best_other, [*by, "other_unit", "rank"], "left_semi").select(*keys, "rank"),
                             checkpoint_dir)
        if mutual.isEmpty():
            break
        taken.append(mutual)
        left = left.join(mutual.select(*by, "ref_unit"), [*by, "ref_unit"], "left_anti")
        left = cut_lineage(left.join(mutual.select(*by, "other_unit"), [*by, "other_unit"], "left_anti"), checkpoint_dir)
    if not taken:
        chosen = left.limit(0)
    else:
        chosen = reduce(DataFrame.unionByName, taken)
    by_ref = chosen.select(*by, "ref_unit", F.col("rank").alias("__ref_rank"))
    by_other = chosen.select(*by, "other_unit", F.col("rank").alias("__other_rank"), F.col("ref_unit").alias("__owner"))
    best = ranked.groupBy(*by, "ref_unit").agg(F.min("rank").alias("__best"))
    out = (ranked.join(by_ref, [*by, "ref_unit"], "left").join(by_other, [*by, "other_unit"], "left")
           .join(best, [*by, "ref_unit"]))
    is_chosen = F.coalesce(F.col("rank") == F.col("__ref_rank"), F.lit(False))
    reason = (
        F.when(~is_chosen & (F.col("__ref_rank") < F.col("rank")), "not needed")
        .when(~is_chosen, F.concat(F.lit("lost to unit "), F.col("__owner").cast("string")))
        .when(F.col("n_ref_candidates") == 1, "only candidate")
        .when(F.col("rank") != F.col("__best"), "fallback")
        .when(F.col("__scored"), "best tuning similarity")
        .otherwise("highest average P"))
    return out.select(*[c for c in candidates.columns], "rank", is_chosen.alias("chosen"), reason.alias("reason"))


def matched_wide(baseline: DataFrame, chosen: DataFrame, recording: str, recordings: list) -> DataFrame:
    """One row per baseline unit with each recording's partner and its probability."""
    picked = chosen.where("chosen")
    wide = picked.groupBy("ref_unit").pivot(recording, recordings).agg(
        F.first("other_unit").alias("unit"), F.first("p_avg").alias("p_avg"))
    return baseline.join(wide.withColumnRenamed("ref_unit", "unit_id"), "unit_id", "left")


def match_counts(candidates: DataFrame, by: list[str]) -> DataFrame:
    """How the reference units fared, per recording."""
    per_ref = candidates.groupBy(*by, "ref_unit").agg(F.count("*").alias("n")).groupBy(*by).agg(
        F.count("*").cast("bigint").alias("with_candidate"),
        F.sum((F.col("n") > 1).cast("bigint")).alias("with_several"))
    per_other = candidates.groupBy(*by, "other_unit").agg(F.count("*").alias("n")).groupBy(*by).agg(
        F.sum((F.col("n") > 1).cast("bigint")).alias("contested"))
    out = per_ref.join(per_other, by)
    if "chosen" in candidates.columns:
        fate = candidates.groupBy(*by).agg(
            F.sum(F.col("chosen").cast("bigint")).alias("matched"),
            F.sum((F.col("reason") == "fallback").cast("bigint")).alias("fell_back"))
        out = out.join(fate, by).withColumn("lost", F.col("with_candidate") - F.col("matched"))
    return out


def probe_drift(matched: DataFrame, depths_ref: DataFrame, depths_other: DataFrame, by: list[str]) -> DataFrame:
    """Median depth shift of matched pairs per recording."""
    a = depths_ref.select(F.col("unit_id").alias("ref_unit"), F.col("depth").alias("__a"))
    c = depths_other.select(F.col("unit_id").alias("other_unit"), F.col("depth").alias("__b"))
    pairs = matched.join(a, "ref_unit").join(c, "other_unit").withColumn("shift", F.col("__b") - F.col("__a"))
    return quantiles(pairs, by, "shift", {"drift": 0.5}).withColumnRenamed("n_values", "n_pairs")


def decoder_units(chosen: DataFrame, tuned: DataFrame, recording: str, recordings: list, mode: str) -> DataFrame:
    """Tuned reference units matched in every recording ("joint") or in any ("pairwise")."""
    picked = chosen.where("chosen").join(tuned.select(F.col("unit_id").alias("ref_unit")), "ref_unit", "left_semi")
    found = picked.where(F.col(recording).isin(*recordings)).groupBy("ref_unit").agg(
        F.count_distinct(recording).cast("bigint").alias("n_recordings"))
    if mode == "joint":
        return found.where(F.col("n_recordings") == len(recordings))
    if mode == "pairwise":
        return found
    raise ValueError(f"mode must be 'joint' or 'pairwise', got {mode!r}")


def control_band_candidates(units: DataFrame, by: list[str], n_units: int, low: str, high: str) -> DataFrame:
    """Runs of `n_units` units next to each other in depth and wholly outside a band.

    `units` has one row per distinct depth with the count ``n`` of units there.
    """
    work = units.withColumn("__side", F.when(F.col("depth") < F.col(low), "below").when(
        F.col("depth") > F.col(high), "above")).where("__side IS NOT NULL")
    ranked = scan(work, [*by, "__side"], ["depth"], {"__upto": running_sum("n")})
    ranked = ranked.withColumn("__from", F.col("__upto") - F.col("n"))
    first = ranked.select(*by, "__side", "__from", F.col("depth").alias("first"), low, high)
    last = ranked.select(*by, "__side", (F.col("__upto") - n_units).alias("__from"), F.col("depth").alias("last"))
    # a run starts where a depth starts and stops where one stops, so equal depths are never split
    return first.join(last, [*by, "__side", "__from"]).withColumn(
        "span", F.col("last") - F.col("first")).drop("__from").withColumnRenamed("__side", "side")


def control_band(units: DataFrame, by: list[str], depth: str, low: float, high: float, n_units: int, gap: float = 0.0,
                 side: str = "either", margin: float = 1e-6) -> DataFrame:
    """The band outside ``low..high`` that holds `n_units` neighbouring units at the most similar width.

    Its edges stop short of the units next to the run, and units at one depth
    are never parted. One row per key; no row where no run fits.
    """
    if side not in ("either", "below", "above"):
        raise ValueError(f"side must be 'either', 'below' or 'above', got {side!r}")
    width = high - low
    d = F.col(depth).cast("double")
    where = F.when(d < low - gap, "below").when(d > high + gap, "above")
    levels = units.withColumn("__side", where).where(F.col("__side").isin(["below", "above"] if side == "either" else [side]))
    levels = levels.groupBy(*by, "__side", d.alias("__d")).agg(F.count("*").alias("__n"))
    ranked = scan(levels, [*by, "__side"], ["__d"], {
        "__upto": running_sum("__n"), "__before": previous("__d"), "__after": following("__d")})
    first = ranked.select(*by, "__side", (F.col("__upto") - F.col("__n")).alias("__from"), F.col("__d").alias("first"), "__before")
    last = ranked.select(*by, "__side", (F.col("__upto") - n_units).alias("__from"), F.col("__d").alias("last"), "__after")
    runs = first.join(last, [*by, "__side", "__from"])
    below = F.col("__side") == "below"
    floor = F.coalesce(F.col("__before") + margin, F.when(below, F.col("first")).otherwise(high + gap + margin))
    ceiling = F.coalesce(F.col("__after") - margin, F.when(below, F.lit(low - gap - margin)).otherwise(F.col("last")))
    runs = runs.withColumns({"__floor": floor, "__ceiling": ceiling}).where("__floor <= first AND __ceiling >= last")
    w = F.least(F.greatest(F.lit(float(width)), F.col("last") - F.col("first")), F.col("__ceiling") - F.col("__floor"))
    runs = runs.withColumn("__w", w)
    least = F.greatest(F.col("__floor"), F.col("last") - F.col("__w"))
    most = F.least(F.col("first"), F.col("__ceiling") - F.col("__w"))
    runs = runs.withColumn("start", F.least(F.greatest((F.col("first") + F.col("last") - F.col("__w")) / 2, least), most))
    runs = runs.withColumn("stop", F.col("start") + F.col("__w"))
    distance = F.when(below, low - F.col("stop")).otherwise(F.col("start") - high)
    best = F.min_by(F.struct(F.col("__side").alias("side"), "start", "stop"),
                    F.struct(F.round(F.abs(F.col("__w") - width), 9), F.round(-distance, 9), "start"))
    return runs.groupBy(*by).agg(best.alias("__b")).select(*by, "__b.side", "__b.start", "__b.stop")
