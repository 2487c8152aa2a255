"""Square waves on analog channels and their agreement with camera frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import finite
from .scan import following, number_rows, plan_cuts, previous, scan
from .thresholds import two_level_thresholds


def describe_analog_channels(samples: DataFrame, keys: list[str], frame: str, value: str, fs: float,
                             min_rail_fraction: float = 0.8, chunks=None) -> DataFrame:
    """Levels, threshold, duty, rails and falling edges of each channel, and whether it looks like a TTL."""
    levels = two_level_thresholds(samples, keys, value)
    return _describe(samples, levels, keys, frame, value, fs, min_rail_fraction, chunks)


def _describe(samples, levels, keys, frame, value, fs, min_rail_fraction, chunks) -> DataFrame:
    x = F.col(value).cast("double")
    work = samples.where(finite(value)).join(levels.select(*keys, "threshold"), keys)
    above = x > F.col("threshold")
    means = work.groupBy(*keys).agg(
        F.avg(F.when(above, x)).alias("__high"), F.avg(F.when(~above, x)).alias("__low"))
    work = work.join(means, keys)
    work = scan(work.withColumn("__above", above), keys, [frame], {"__next": following("__above")}, chunks)
    span = F.col("__high") - F.col("__low")
    near = (x <= F.col("__low") + 0.1 * span).cast("double") + (x >= F.col("__high") - 0.1 * span).cast("double")
    out = work.groupBy(*keys).agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.first("threshold").alias("threshold"),
        F.coalesce(F.avg(F.col("__above").cast("double")), F.lit(0.0)).alias("duty_cycle"),
        F.coalesce(F.avg(near), F.lit(0.0)).alias("rail_fraction"),
        F.coalesce(F.sum((F.col("__above") & ~F.col("__next")).cast("bigint")), F.lit(0)).cast("bigint").alias("falling_edges"),
        F.count("*").cast("bigint").alias("n_samples"))
    rate = F.col("falling_edges") / (F.col("n_samples") / F.lit(float(fs)))
    return out.withColumn("crossings_per_s", rate).withColumn(
        "looks_like_ttl", F.col("rail_fraction") >= min_rail_fraction)


def pick_ttl_channel(described: DataFrame, channel: str) -> DataFrame:
    """The one channel that looks like a TTL; the caller refuses none or several."""
    return described.where("looks_like_ttl").select(channel, "threshold")


def falling_edges(samples: DataFrame, thresholds: DataFrame, keys: list[str], frame: str, value: str,
                  chunks=None) -> DataFrame:
    """Rows that are the first not above the threshold after one that was."""
    chunks = plan_cuts(samples, frame, chunks, keyless=not keys)
    work = samples.join(thresholds.select(*keys, "threshold"), keys)
    above = F.col(value).cast("double") > F.col("threshold")
    work = scan(work.withColumn("__above", above), keys, [frame], {"__before": previous("__above")}, chunks)
    return work.where(F.col("__before") & ~F.col("__above")).drop("__above", "__before")


def cross_check_frames(edges: DataFrame, keys: list[str], time: str, frame_counts: DataFrame, period: str,
                       chunks=None) -> DataFrame:
    """Edge count and interval regularity against the tracking file's frame count and period."""
    gaps = scan(edges, keys, [time], {"__next": following(time)}, chunks)
    joined = gaps.join(frame_counts, keys)
    gap = F.col("__next") - F.col(time)
    regular = F.abs(gap - F.col(period)) <= 0.2 * F.col(period)
    out = joined.groupBy(*keys).agg(
        F.count("*").cast("bigint").alias("n_detected"), F.first("n_frames").alias("n_frames"),
        F.count(gap).cast("bigint").alias("n_intervals"),
        F.coalesce(F.sum(F.when(regular, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("n_regular"))
    plausible = ((F.abs(F.col("n_frames") - F.col("n_detected")) < 0.01 * F.col("n_frames"))
                 & (F.col("n_intervals") > 0) & (F.col("n_regular") > 0.99 * F.col("n_intervals")))
    return out.withColumn("frame_count_difference", F.col("n_frames") - F.col("n_detected")).withColumn("plausible", plausible)


def align_frames_to_events(events: DataFrame, frames: DataFrame, keys: list[str], event_order: list[str],
                           frame_order: list[str], assume_missing: str = "start") -> DataFrame:
    """Pair events with frames by position; surplus frames are taken to be missing at one end.

    A key with more events than frames is refused when its rows are read.
    """
    if assume_missing not in ("start", "end"):
        raise ValueError(f"assume_missing must be 'start' or 'end', got {assume_missing!r}")
    e = number_rows(events, keys, event_order, "__i")
    f = number_rows(frames, keys, frame_order, "__j")
    n = events.groupBy(*keys).agg(F.count("*").alias("__ne")).join(
        frames.groupBy(*keys).agg(F.count("*").alias("__nf")), keys)
    fits = F.assert_true(F.col("__nf") >= F.col("__ne"), F.lit("more events than tracking frames")).isNull()
    n = n.withColumn("__skip", F.when(fits, F.col("__nf") - F.col("__ne")) if assume_missing == "start" else F.when(fits, F.lit(0)))
    e = e.join(n.select(*keys, "__skip"), keys).withColumn("__j", F.col("__i") + F.col("__skip")).drop("__skip", "__i")
    return e.join(f, [*keys, "__j"]).withColumnRenamed("__j", "frame_index")


def clock_report(samples: DataFrame, keys: list[str], time: str, declared_rate: float) -> DataFrame:
    """Span, realised sampling rate and drift of a clock against the declared rate."""
    out = samples.groupBy(*keys).agg(
        F.min(time).alias("t_first"), F.max(time).alias("t_last"), F.count("*").cast("bigint").alias("n"))
    span = F.col("t_last") - F.col("t_first")
    realised = F.when(span > 0, (F.col("n") - 1) / span)
    return out.withColumns({"span": span, "realised_rate": realised}).withColumn(
        "drift_ppm", (F.col("realised_rate") / F.lit(float(declared_rate)) - 1) * 1e6)


def sync_clock_problem(samples: DataFrame, keys: list[str], frame: str, time: str, chunks=None) -> DataFrame:
    """What disqualifies a clock: a non-finite or negative start, or time that stands still or goes back."""
    work = scan(samples, keys, [frame], {"__before": previous(time)}, chunks)
    stalled = F.col(time) <= F.col("__before")
    out = work.groupBy(*keys).agg(
        F.bool_and(finite(time)).alias("__finite"), F.min_by(time, frame).alias("__first"),
        F.max_by(time, frame).alias("__last"), F.coalesce(F.bool_or(stalled), F.lit(False)).alias("__stalled"))
    problem = (F.when(~F.col("__finite"), "not finite").when(F.col("__first") < 0, "negative start")
               .when(F.col("__last") <= F.col("__first"), "does not advance")
               .when(F.col("__stalled"), "not increasing"))
    return out.select(*keys, problem.alias("problem"))


def synced_times(samples: DataFrame, stamps: DataFrame, keys: list[str], frame: str, fs: float, require: bool = False) -> DataFrame:
    """Samples with their acquisition time, or frame over rate where the clock does not hold up.

    A clock counts for a recording if it has one stamp per sample and none of
    the faults :func:`sync_clock_problem` names; `require` refuses the others
    when their rows are read.
    """
    faults = sync_clock_problem(stamps, keys, frame, "t")
    sizes = samples.groupBy(*keys).agg(F.count("*").alias("__n")).join(
        stamps.groupBy(*keys).agg(F.count("*").alias("__m")), keys, "left").join(faults, keys, "left")
    good = F.coalesce((F.col("__n") == F.col("__m")) & F.col("problem").isNull(), F.lit(False))
    if require:
        good = F.when(F.assert_true(good, F.lit("the acquisition clock is not usable")).isNull(), good)
    judged = sizes.select(*keys, good.alias("synced"))
    joined = samples.join(judged, keys).join(stamps.select(*keys, frame, F.col("t").alias("__t")), [*keys, frame], "left")
    t = F.when(F.col("synced"), F.col("__t")).otherwise(F.col(frame) / F.lit(float(fs)))
    return joined.withColumn("t", t).drop("__t")
