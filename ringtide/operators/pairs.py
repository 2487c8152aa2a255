"""Correlations between every pair of units, at one lag or over many."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import cut_lineage
from .blocks import dense, filter_rows, map_blocks, smoothed_rates
from .quantiles import average_rank, corr_or_null, finite


def wide_counts(counts: DataFrame, bins: DataFrame, keys: list[str], index: str, unit: str, count: str,
                units: list) -> DataFrame:
    """Long spike counts as one array per bin over `units`; bins without spikes get zeros."""
    entries = counts.where(F.col(unit).isin(units)).groupBy(*keys, index).agg(
        F.map_from_entries(F.collect_list(F.struct(unit, count))).alias("__m"))
    order = F.array(*[F.lit(u) for u in units])
    out = bins.join(entries, [*keys, index], "left")
    return out.withColumn("counts", F.transform(
        order, lambda u: F.coalesce(F.try_element_at("__m", u), F.lit(0)).cast("bigint"))).drop("__m")


def pair_counts(bins: DataFrame, keys: list[str], index: str, mask: str, max_lag: int,
                block: int = 8192) -> DataFrame:
    """Number of masked bin pairs at each lag from 0 to `max_lag`; negative lags mirror it."""
    types = {f.name: f.dataType.simpleString() for f in bins.schema}
    kept = bins.where(mask).select(*keys, index)

    def work(key, pdf, start, stop):
        lo = start - max_lag
        m = np.zeros(stop - start + 2 * max_lag)
        m[pdf[index].to_numpy() - lo] = 1.0
        core = m[max_lag:max_lag + stop - start]
        n = [core @ m[max_lag + k:max_lag + k + len(core)] for k in range(max_lag + 1)]
        out = pd.DataFrame({k: [v] * (max_lag + 1) for k, v in zip(keys, key)}, index=range(max_lag + 1))
        return out.assign(lag=np.arange(max_lag + 1), n=np.rint(n).astype(np.int64))

    schema = "".join(f"{k} {types[k]}, " for k in keys) + "lag bigint, n bigint"
    parts = map_blocks(kept, keys, index, block, max_lag, work, schema)
    return parts.groupBy(*keys, "lag").agg(F.sum("n").alias("n_pairs"))


def _sum_blocks(df, keys, index, block, halo, work) -> DataFrame:
    """Sum over blocks of the matrices `work` returns, as ``(key, i, j, s, f)``."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def cells(key, pdf, start, stop):
        zero, filtered = work(pdf, start, stop)
        n = len(zero)
        out = pd.DataFrame({k: [v] * n for k, v in zip(keys, key)}, index=range(n))
        return out.assign(i=np.arange(n), zero=list(zero), filtered=list(filtered))

    schema = "".join(f"{k} {types[k]}, " for k in keys) + "i bigint, zero array<double>, filtered array<double>"
    parts = map_blocks(df, keys, index, block, halo, cells, schema)
    each = parts.select(*keys, "i", F.posexplode(F.arrays_zip("zero", "filtered")).alias("j", "c"))
    return each.groupBy(*keys, "i", F.col("j").cast("bigint").alias("j")).agg(
        F.sum("c.zero").alias("s"), F.sum("c.filtered").alias("f"))


def pairwise_correlations(bins: DataFrame, keys: list[str], index: str, counts: str, duration: str, mask: str,
                          sigma_bins: float, max_lag: int, start_lag: int, block: int = 8192) -> DataFrame:
    """Correlation of each unit pair at lag 0, on the shoulder, and their difference.

    The shoulder averages the correlations at ``start_lag <= |lag| <= max_lag``,
    each divided by its own number of masked bin pairs. It is one symmetric
    filter per unit and one product of matrices: the lags are never joined. The
    constant 1 rides along as one more unit, which carries the means, so nothing
    needs centring first.
    """
    if not 0 < start_lag <= max_lag:
        raise ValueError(f"need 0 < start_lag <= max_lag, got {start_lag} and {max_lag}")
    rates = smoothed_rates(bins, keys, index, counts, duration, sigma_bins, block)
    lags = pair_counts(bins, keys, index, mask, max_lag, block).where(f"lag >= {start_lag} AND n_pairs > 0")
    # one weight per lag and key: at most max_lag numbers per recording
    weights: dict = {}
    for r in lags.collect():
        weights.setdefault(tuple(r[k] for k in keys), {})[r["lag"]] = r["n_pairs"]
    kernels = {}
    for key, table in weights.items():
        kernel = np.zeros(2 * max_lag + 1)
        for lag, n in table.items():
            kernel[max_lag + lag] = kernel[max_lag - lag] = 1.0 / (n * 2 * len(table))
        kernels[key] = kernel
    augmented = F.concat(F.col("rates"), F.array(F.lit(1.0)))
    kept = rates.where(mask).select(*keys, index, augmented.alias("__x"))

    def work(pdf, start, stop):
        key = tuple(pdf[k].iloc[0] for k in keys)
        lo = start - max_lag
        x = dense(pdf, index, "__x", lo, stop - start + 2 * max_lag)
        kernel = kernels.get(key)
        y = filter_rows(x, kernel) if kernel is not None else np.full_like(x, np.nan)
        core = slice(max_lag, max_lag + stop - start)
        return x[core].T @ x[core], x[core].T @ y[core]

    # units squared rows, read several times below: computed once
    sums = cut_lineage(_sum_blocks(kept, keys, index, block, max_lag, work))
    return _centred_correlations(sums, keys)


def _centred_correlations(sums: DataFrame, keys: list[str]) -> DataFrame:
    """From products that include the constant to correlations of the centred rates."""
    last = sums.groupBy(*keys).agg(F.max("i").alias("__one")) if keys else sums.agg(F.max("i").alias("__one"))
    if keys:
        work = sums.join(last, keys)
    else:
        work = sums.withColumn("__one", last.scalar())
    one = F.col("__one")
    total = work.where((F.col("i") == one) & (F.col("j") == one)).select(*keys, F.col("s").alias("n"), F.col("f").alias("c"))
    side = work.where((F.col("j") == one) & (F.col("i") < one)).select(
        *keys, "i", F.col("s").alias("sum"), F.col("f").alias("edge"))
    square = work.where((F.col("i") == F.col("j")) & (F.col("i") < one)).select(*keys, "i", F.col("s").alias("sq"))
    unit = side.join(square, [*keys, "i"])
    unit = unit.join(total, keys) if keys else unit.withColumn("n", total.select("n").scalar()).withColumn(
        "c", total.select("c").scalar())
    mean = F.col("sum") / F.col("n")
    unit = unit.withColumns({"mean": mean, "sd": F.sqrt(F.greatest(F.col("sq") / F.col("n") - mean * mean, F.lit(0.0)))})
    a = unit.select(*keys, "i", F.col("mean").alias("mi"), F.col("sd").alias("si"), F.col("edge").alias("ei"), "n", "c")
    b = unit.select(*keys, F.col("i").alias("j"), F.col("mean").alias("mj"), F.col("sd").alias("sj"), F.col("edge").alias("ej"))
    pairs = work.where((F.col("i") < one) & (F.col("j") < one)).join(a, [*keys, "i"]).join(b, [*keys, "j"])
    flipped = work.select(*keys, F.col("i").alias("j"), F.col("j").alias("i"), F.col("f").alias("f2"))
    pairs = pairs.join(flipped, [*keys, "i", "j"])
    scale = F.col("si") * F.col("sj")
    zero = F.col("s") / F.col("n") - F.col("mi") * F.col("mj")
    shoulder = ((F.col("f") + F.col("f2")) / 2 - F.col("mi") * F.col("ej") - F.col("ei") * F.col("mj")
                + F.col("mi") * F.col("mj") * F.col("c"))
    out = pairs.select(
        *keys, "i", "j", F.when(scale > 0, zero / scale).alias("zero_lag"),
        F.when(scale > 0, shoulder / scale).alias("baseline"), F.col("mi").alias("rate_mean"), F.col("si").alias("rate_sd"))
    return out.withColumn("metric", F.col("zero_lag") - F.col("baseline"))


def pair_correlogram(bins: DataFrame, keys: list[str], index: str, a: str, b: str, mask: str, max_lag: int) -> DataFrame:
    """Correlation of two rate columns at every lag, divided by the masked pairs at that lag.

    Positive lags have `a` later than `b`. Each bin is copied once per lag and
    meets its partner in an equi-join.
    """
    kept = bins.where(mask).select(*keys, index, F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"))
    stats = kept.groupBy(*keys).agg(
        F.avg("__a").alias("__ma"), F.avg("__b").alias("__mb"), F.stddev_pop("__a").alias("__sa"), F.stddev_pop("__b").alias("__sb"))
    lagged = kept.select(*keys, F.col("__a"), F.col(index).alias("__t"), F.explode(
        F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"))
    lagged = lagged.withColumn(index, F.col("__t") - F.col("lag"))
    met = lagged.join(kept.select(*keys, index, "__b"), [*keys, index])
    sums = met.groupBy(*keys, "lag").agg(
        F.count("*").cast("bigint").alias("n_pairs"), F.sum(F.col("__a") * F.col("__b")).alias("ab"),
        F.sum("__a").alias("sa"), F.sum("__b").alias("sb"))
    if keys:
        out = sums.join(stats, keys)
    else:
        out = sums.withColumns({c: stats.select(c).scalar() for c in stats.columns})
    cov = F.col("ab") - F.col("__mb") * F.col("sa") - F.col("__ma") * F.col("sb") + F.col("n_pairs") * F.col("__ma") * F.col("__mb")
    scale = F.col("__sa") * F.col("__sb")
    return out.select(*keys, F.col("lag").cast("bigint").alias("lag"), "n_pairs", F.when(scale > 0, cov / F.col("n_pairs") / scale).alias("r"))


def masked_rates(bins: DataFrame, keys: list[str], counts: str, duration: str, mask: str) -> DataFrame:
    """Total spikes over total time of each unit inside the mask."""
    kept = bins.where(mask).select(*keys, F.col(duration).cast("double").alias("__d"), F.posexplode(counts).alias("unit", "__k"))
    return kept.groupBy(*keys, F.col("unit").cast("bigint").alias("unit")).agg(
        (F.sum("__k") / F.sum("__d")).alias("rate_hz"))


def auc(scores: DataFrame, keys: list[str], positive: str, score: str) -> DataFrame:
    """How often a positive outranks a negative, ties counting half; null if a group is empty."""
    kept = scores.where(finite(score) & F.col(positive).isNotNull())
    ranked = average_rank(kept, keys, score)
    pos = F.col(positive)
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.when(pos, F.col("avg_rank"))).alias("rs"), F.sum(pos.cast("bigint")).alias("np"), F.sum((~pos).cast("bigint")).alias("nn"))
    u = F.col("rs") - F.col("np") * (F.col("np") + 1) / 2
    return sums.select(*keys, F.col("np").alias("n_positive"), F.col("nn").alias("n_negative"),
                       F.when((F.col("np") > 0) & (F.col("nn") > 0), u / (F.col("np") * F.col("nn"))).alias("auc"))


def rank_correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Spearman's rho per key; null below three pairs or without spread."""
    kept = df.where(finite(x) & finite(y))
    ranked = average_rank(average_rank(kept, keys, x, "__rx"), keys, y, "__ry")
    return ranked.groupBy(*keys).agg(
        F.count("*").cast("bigint").alias("n"),
        F.when((F.count("*") >= 3) & (F.stddev_pop("__rx") > 0) & (F.stddev_pop("__ry") > 0), corr_or_null("__rx", "__ry")).alias("rho"))


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson's r over finite pairs per key; null below three or without spread."""
    return df.where(finite(x) & finite(y)).groupBy(*keys).agg(
        F.count("*").cast("bigint").alias("n"),
        F.when((F.count("*") >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), corr_or_null(x, y)).alias("r"))


def binned_mean(df: DataFrame, keys: list[str], x: str, y: str, low: float, width: float, n_bins: int,
                clip: bool = False) -> DataFrame:
    """Mean, standard error and count of y per equal bin of x; empty bins have no row."""
    index = F.floor((F.col(x) - low) / width)
    kept = df.where(finite(x) & finite(y))
    if clip:
        index = F.least(F.greatest(index, F.lit(0)), F.lit(n_bins - 1))
    else:
        kept = kept.where((index >= 0) & (index < n_bins))
    out = kept.groupBy(*keys, index.cast("bigint").alias("bin")).agg(
        F.avg(y).alias("mean"), F.count("*").cast("bigint").alias("n"),
        F.when(F.count("*") > 1, F.stddev_samp(y) / F.sqrt(F.count("*"))).alias("sem"))
    return out.withColumn("centre", low + (F.col("bin") + 0.5) * width)


def ring_vs_tuning_table(screen: DataFrame, ring: DataFrame, stats: DataFrame, min_coupling: float = 0.5) -> DataFrame:
    """Every candidate unit with its screen, its place on the ring and its measured tuning.

    `screen` has ``unit, status, partner_snr``; `ring` ``unit, angle_deg, radius,
    coupling``; `stats` ``unit, preferred_deg, mvl, significant``. A unit without
    a direction is not tuned, one off the ring is no member.
    """
    out = screen.join(stats, "unit", "left").join(ring, "unit", "left")
    tuned = F.coalesce(F.col("significant"), F.lit(False)) & F.col("preferred_deg").isNotNull()
    return out.withColumns({"tuned": tuned, "member": F.coalesce(F.col("coupling") >= min_coupling, F.lit(False))}).drop("significant")


def difference_curve(pairs: DataFrame, directions: DataFrame, width: float = 15.0) -> DataFrame:
    """Mean pair score by the absolute difference of preferred directions, pairs counted once."""
    from ..functions.angles import circular_difference

    a = directions.select(F.col("unit").alias("i"), F.col("preferred_deg").alias("__a"))
    b = directions.select(F.col("unit").alias("j"), F.col("preferred_deg").alias("__b"))
    both = pairs.where("i < j").join(a, "i").join(b, "j")
    both = both.withColumn("difference", F.round(F.abs(circular_difference(F.col("__a"), F.col("__b"))), 9))
    return binned_mean(both, [], "difference", "corr_z", 0.0, width, int(180 / width), clip=True)


def crosstab(table: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Counts of `rows` by the given values of `columns`, in their order."""
    counted = table.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1)))
    return counted.select(rows, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(str(v)) for v in values])


def structure_test(pairs_x: DataFrame, pairs_y: DataFrame, units: DataFrame, orders: list[list[int]]) -> tuple[DataFrame, DataFrame]:
    """Correlation of two pair tables over ``i < j``, observed and with the units of one permuted.

    Both tables hold ``i, j, v`` in both orders; `units` maps a unit to its
    position ``p`` among ``len(order)``. Returns the observed row and one per
    permutation.
    """
    x = pairs_x.where("i < j").select("i", "j", F.col("v").alias("x"))
    y = pairs_y.select("i", "j", F.col("v").alias("y"))
    observed = x.join(y, ["i", "j"]).agg(corr_or_null("x", "y").alias("value"))
    spark = pairs_x.sparkSession
    rows = [(s, p, int(q)) for s, order in enumerate(orders) for p, q in enumerate(order)]
    mapping = spark.createDataFrame(rows, "shuffle int, p bigint, q bigint")
    a = units.select(F.col("p").alias("q"), F.col("unit").alias("to"))
    moved = mapping.join(a, "q").join(units.select("p", F.col("unit").alias("from")), "p").select("shuffle", "from", "to")
    left = moved.select("shuffle", F.col("from").alias("i"), F.col("to").alias("ti"))
    right = moved.select("shuffle", F.col("from").alias("j"), F.col("to").alias("tj"))
    shuffled = x.join(left, "i").join(right, ["shuffle", "j"]).join(
        y.select(F.col("i").alias("ti"), F.col("j").alias("tj"), "y"), ["ti", "tj"])
    return observed, shuffled.groupBy("shuffle").agg(corr_or_null("x", "y").alias("value"))
