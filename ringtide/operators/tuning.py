"""How event rates depend on heading: curves, vector length, significance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.angles import bin_centre, heading_bin, length, vector_angle
from ..scale import cut_lineage, written
from .nulls import draw_shifts
from .shifted import shifted_bands, shifted_cells, shifted_stats, smoother


def wrapped_kernel(sigma_bins: float, n_bins: int, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Normalised Gaussian weights by offset, folded onto a ring of `n_bins`."""
    if sigma_bins <= 0:
        return [(0, 1.0)]
    radius = int(truncate * sigma_bins + 0.5)
    offsets = np.arange(-radius, radius + 1)
    weights = np.exp(-0.5 * (offsets / sigma_bins) ** 2)
    weights /= weights.sum()
    folded = np.zeros(n_bins)
    np.add.at(folded, offsets % n_bins, weights)
    return [(int(i), float(w)) for i, w in enumerate(folded) if w > 0]


def kernel_sql(sigma_bins: float, n_bins: int, truncate: float = 4.0) -> str:
    """The same weights as a SQL VALUES list, for oracle queries."""
    return ", ".join(f"({i}, {w!r}::DOUBLE)" for i, w in wrapped_kernel(sigma_bins, n_bins, truncate))


def frame_spike_counts(spikes: DataFrame, frames: DataFrame, by: list[str], unit: str, time: str,
                       frame_order: list[str], chunks=None) -> DataFrame:
    """Spikes per unit between consecutive frames of its session, with rates.

    Intervals are closed below and open above, the last one closed on both
    sides; spikes outside the frames are dropped. Only intervals with spikes get
    a row.
    """
    from .joins import asof_join
    from .scan import following, previous, scan

    t = frame_order[0]
    edges = scan(frames, by, frame_order, {
        "__next": following(t), "__before": previous(t)}, chunks)
    edges = edges.select(*by, F.col(t).alias("__t"), F.col("__next"), F.col("__before"))
    hit = asof_join(spikes, edges, by, time, "__t", ["__t", "__next", "__before"], "__next", chunks)
    last_closed = F.col("__next").isNull() & (F.col(time) == F.col("__t"))
    start = F.when(last_closed, F.col("__before")).otherwise(F.col("__t"))
    stop = F.when(last_closed, F.col("__t")).otherwise(F.col("__next"))
    hit = hit.withColumns({"start": start, "stop": stop}).where("start IS NOT NULL AND stop IS NOT NULL")
    out = hit.groupBy(*by, unit, "start", "stop").agg(F.count("*").cast("bigint").alias("n_spikes"))
    return out.withColumn("rate", F.col("n_spikes") / (F.col("stop") - F.col("start")))


def tuning_counts(frames: DataFrame, unit: str, heading: str, duration: str, n_bins: int) -> DataFrame:
    """Spikes per unit and heading bin beside the time spent there; unseen cells are zero.

    Each frame row is one spike of its unit. What is shuffled and written is one
    row per (unit, bin), from which both sums are taken, so that the frames are
    computed once. The rows of a unit stay in one partition.
    """
    work = frames.withColumn("angle_bin", heading_bin(F.col(heading), n_bins))
    cells = written(work.groupBy(unit, "angle_bin").agg(
        F.count("*").cast("bigint").alias("n_spikes"), F.sum(duration).alias("__d")), "cells")
    occupancy = cells.groupBy("angle_bin").agg(F.sum("__d").alias("occupancy"))  # a row per bin
    known = F.col(unit).isNotNull() & F.col("angle_bin").isNotNull()
    held = cells.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.when(known, F.struct("angle_bin", "n_spikes")))).alias("__held"))
    ring = F.sequence(F.lit(0).cast("bigint"), F.lit(n_bins - 1).cast("bigint"))
    grid = held.select(unit, F.inline(F.transform(ring, lambda i: F.struct(
        i.alias("angle_bin"), F.coalesce(F.try_element_at("__held", i), F.lit(0)).cast("bigint").alias("n_spikes")))))
    out = grid.join(F.broadcast(occupancy), "angle_bin", "left")
    return out.select(unit, "angle_bin", "n_spikes", F.coalesce("occupancy", F.lit(0)).alias("occupancy"))


def smooth_ring(cells: DataFrame, keys: list[str], index: str, value: str, n_bins: int,
                sigma_deg: float, out: str, truncate: float = 4.0) -> DataFrame:
    """Circular Gaussian smoothing of one value per (key, bin), over an array per key; bins that no value reaches have no row."""
    kernel = wrapped_kernel(sigma_deg / (360.0 / n_bins), n_bins, truncate)
    known = F.when(F.col(index).isNotNull() & F.col(value).isNotNull(), F.struct(F.col(index).cast("bigint").alias("i"), F.col(value).cast("double").alias("v")))
    held = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(known)).alias("__held"))
    ring = F.sequence(F.lit(0).cast("bigint"), F.lit(n_bins - 1).cast("bigint"))
    dense = held.withColumn("__v", F.transform(ring, lambda i: F.try_element_at("__held", i)))

    def spread(i: Column) -> Column:
        taps = [F.get("__v", F.pmod(i - off, F.lit(n_bins)).cast("int")) * F.lit(w) for off, w in kernel]
        total = sum((F.coalesce(t, F.lit(0.0)) for t in taps), F.lit(0.0))
        return F.struct(i.alias(index), F.when(F.coalesce(*taps).isNotNull(), total).alias(out))

    return dense.select(*keys, F.inline(F.transform(ring, spread))).where(F.col(out).isNotNull())


def occupancy_normalized_rate(counts: DataFrame, keys: list[str], n_bins: int, sigma_deg: float,
                              per_second: float = 1.0, out: str = "hz") -> DataFrame:
    """Spikes over time per bin, zero where never visited, then smoothed round the ring."""
    hz = F.when(F.col("occupancy") > 0, F.col("n_spikes") / (F.col("occupancy") / F.lit(per_second))).otherwise(0.0)
    return smooth_ring(counts.withColumn("__hz", hz), keys, "angle_bin", "__hz", n_bins, sigma_deg, out)


def mean_vector(curves: DataFrame, keys: list[str], n_bins: int, rate: str = "hz") -> DataFrame:
    """Length and direction of the rate-weighted mean vector; null for a silent curve."""
    theta = F.radians(bin_centre(F.col("angle_bin"), n_bins))
    sums = curves.groupBy(*keys).agg(
        F.sum(rate).alias("__t"), F.sum(F.col(rate) * F.cos(theta)).alias("__x"),
        F.sum(F.col(rate) * F.sin(theta)).alias("__y"), F.max(rate).alias("peak_rate_hz"))
    ok = F.col("__t") > 0
    return sums.select(
        *keys, F.when(ok, length("__x", "__y") / F.col("__t")).alias("mean_vector_length"),
        F.when(ok, vector_angle("__x", "__y")).alias("preferred_direction_deg"), "peak_rate_hz")


def _shifted(frames: DataFrame, unit: str, heading: str, duration: str, order: list[str], n_bins: int, sigma_deg: float,
             shifts: list[int], n_frames: int, per_second: float) -> tuple:
    """What `shifted_stats` and `shifted_bands` take."""
    spent = frames.groupBy(heading_bin(F.col(heading), n_bins).alias("angle_bin")).agg(F.sum(duration).alias("d")).collect()
    occupancy = {r["angle_bin"]: float(r["d"] or 0) for r in spent}  # a number per bin
    rates = smoother([occupancy.get(i, 0.0) for i in range(n_bins)],
                     wrapped_kernel(sigma_deg / (360.0 / n_bins), n_bins), per_second)
    return shifted_cells(frames, unit, heading, order, n_bins, shifts, n_frames), unit, len(shifts), rates, n_bins


def shifted_curves(frames: DataFrame, unit: str, heading: str, duration: str, order: list[str],
                   n_bins: int, sigma_deg: float, shifts: list[int], n_frames: int,
                   per_second: float = 1.0) -> DataFrame:
    """Tuning curves after shifting the spikes along the frame clock, one per unit and shift.

    Shift s gives frame i the spikes of frame ``(i + s) mod n``. Bins that no
    spike reaches have no row.
    """
    bands = shifted_bands(*_shifted(frames, unit, heading, duration, order, n_bins, sigma_deg, shifts, n_frames, per_second))
    return bands.select(unit, "angle_bin", F.posexplode("hz").alias("shuffle", "hz")).where("hz IS NOT NULL").select(
        unit, "shuffle", "angle_bin", "hz")


def _percentile(values: Column, p: float) -> Column:
    """Linear-interpolation percentile of a sorted array without nulls; null if it is empty."""
    at = F.lit(float(p)) * (F.size(values) - 1)
    low, high = (F.get(values, f(at).cast("int")) for f in (F.floor, F.ceil))
    return low + (high - low) * (at - F.floor(at))


def hd_significance(frames: DataFrame, unit: str, heading: str, duration: str, order: list[str],
                    n_bins: int = 36, sigma_deg: float = 10.0, n_shuffles: int = 500,
                    min_shift: float = 20.0, alpha: float = 0.01, seed: int = 0,
                    min_peak_rate: float = 0.0, per_second: float = 1.0,
                    shifts: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Vector length of each unit against circularly shifted spikes.

    Returns the statistics per unit, and per unit and bin the null curves' ``hz``
    under every shuffle (see `shifted_bands`). `min_shift` is in seconds; `per_second` is the number of duration units
    in one. The number of frames and their mean length size the draws, unless
    `shifts` gives them.
    """
    frames = written(frames.select(*dict.fromkeys([unit, heading, duration, *order])), "frames")
    row = frames.agg(F.count("*").alias("n"), F.avg(duration).alias("mean")).first()
    n, mean = int(row["n"]), float(row["mean"]) / per_second
    least = round(min_shift / mean)
    if 2 * least >= n:
        raise ValueError(f"min_shift={min_shift} leaves no room to shift {n * mean:.1f} s")
    if shifts is None:
        shifts = draw_shifts(n_shuffles, least, n - least, seed)
    n_shuffles = len(shifts)
    # the shift by nothing is the unit's own curve, so that one pass gives it and its nulls
    moved = _shifted(frames, unit, heading, duration, order, n_bins, sigma_deg, [0, *shifts], n, per_second)
    stats = shifted_stats(*moved).where(F.col(unit).isNotNull()).select(
        unit, "n_spikes", "peak_rate_hz", F.when(F.col("total") > 0, length("x", "y") / F.col("total")).alias("mean_vector_length"),
        F.when(F.col("total") > 0, vector_angle("x", "y")).alias("preferred_direction_deg"),
        F.sort_array(F.array_compact("null_mvl")).alias("__null"))
    some = F.col("mean_vector_length").isNotNull() & (F.size("__null") > 0)
    hits = F.when(some, F.size(F.filter("__null", lambda x: x >= F.col("mean_vector_length")))).cast("bigint")
    p = (1 + hits) / F.lit(n_shuffles + 1)
    quiet = F.col("peak_rate_hz") < min_peak_rate
    total_s = n * mean
    out = stats.select(
        unit, "mean_vector_length", "preferred_direction_deg", "peak_rate_hz",
        (F.col("n_spikes") / F.lit(total_s)).alias("mean_rate_hz"), "n_spikes",
        F.coalesce(p, F.lit(1.0)).alias("p_value"), _percentile(F.col("__null"), 1 - alpha).alias("mvl_threshold"),
        quiet.alias("too_quiet"), (F.coalesce(p, F.lit(1.0)) <= alpha).alias("__sig"))
    return out.withColumn("significant", F.col("__sig") & ~F.col("too_quiet")).drop("__sig"), shifted_bands(*moved, skip=1)


def null_band(null_curves: DataFrame, unit: str, percentiles=(2.5, 50.0, 97.5)) -> DataFrame:
    """Percentiles of the shuffled curves per unit and bin, whose `hz` holds one value per shuffle."""
    known = null_curves.withColumn("__known", F.sort_array(F.array_compact("hz")))
    return known.select(unit, "angle_bin", F.array(*[_percentile(F.col("__known"), p / 100.0) for p in percentiles]).alias("band"))


def apply_mvl_cutoff(stats: DataFrame, min_mvl) -> DataFrame:
    """Drop significant units whose vector is shorter than a cut: None, a number or ``"bimodal"``.

    Candidates are the units significant before any earlier cut, so the step can
    be run again with another cut.
    """
    from .thresholds import otsu_table

    weak = F.col("weakly_tuned") if "weakly_tuned" in stats.columns else F.lit(False)
    work = stats.withColumn("__candidate", F.col("significant") | weak)
    if min_mvl == "bimodal":
        work = cut_lineage(work)  # the cut and the units both come from it
    if min_mvl is None:
        cut = F.lit(None).cast("double")
    elif min_mvl == "bimodal":
        candidates = work.where("__candidate")
        cut = otsu_table(candidates, [], "mean_vector_length").select("cutoff").scalar()
    elif isinstance(min_mvl, str):
        raise ValueError(f"min_mvl must be None, 'bimodal' or a number, not {min_mvl!r}")
    else:
        cut = F.lit(float(min_mvl))
    work = work.withColumn("mvl_cutoff", cut)
    below = F.coalesce(F.col("mean_vector_length") < F.col("mvl_cutoff"), F.lit(False))
    work = work.withColumn("weakly_tuned", F.col("__candidate") & below)
    return work.withColumn("significant", F.col("__candidate") & ~F.col("weakly_tuned")).drop("__candidate")


def peak_normalised(curves: DataFrame, unit: str, rate: str = "hz") -> DataFrame:
    """Curves divided by their own peak; a unit has as many rows as heading bins."""
    peak = F.max(rate).over(W.partitionBy(unit))
    return curves.withColumn("normalised", F.when(peak > 0, F.col(rate) / peak))
