"""Which moments, frames and intervals belong to which states or behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import asof_join, running_max_join
from .runs import intervals_between_frames, label_runs
from .scan import following, plan_cuts, scan


def times_in_states(points: DataFrame, spans: DataFrame, by: list[str], time: str,
                    states: list[str], out: str = "inside", chunks=None) -> DataFrame:
    """Flag points inside a span of `states`: half-open, and only the latest-started span counts."""
    chosen = spans.where(F.col("state").isin(*states))
    chosen = chosen.select(*by, F.col("start").alias("__start"), F.col("stop").alias("__stop"))
    hit = asof_join(points, chosen, by, time, "__start", ["__start", "__stop"], "__stop", chunks)
    inside = F.coalesce(F.col(time) < F.col("__stop"), F.lit(False))
    return hit.withColumn(out, inside).drop("__start", "__stop")


def frames_in_states(frames: DataFrame, spans: DataFrame, by: list[str], time: str, order: list[str],
                     states: list[str]) -> DataFrame:
    """Frame mask and inter-frame mask together; an interval needs both of its frames."""
    inside = times_in_states(frames, spans, by, time, states, "frame_kept")
    return intervals_between_frames(inside, by, order, "frame_kept", "interval_kept")


def seconds_since(points: DataFrame, spans: DataFrame, by: list[str], time: str,
                  out: str = "since", chunks=None) -> DataFrame:
    """Time since the latest stop among spans already started; 0 inside one, null before any."""
    s = spans.select(*by, F.col("start").alias("__start"), F.col("stop").alias("__stop"))
    hit = running_max_join(points, s, by, time, "__start", "__stop", "__last", chunks)
    since = F.greatest(F.col(time) - F.col("__last"), F.lit(0))
    return hit.withColumn(out, F.when(F.col("__last").isNotNull(), since)).drop("__last")


def passes(column: str, at_most=None, more_than=None, magnitude: bool = False) -> Column:
    """Threshold test: maxima are inclusive, the minimum is strict, missing fails."""
    c = F.abs(F.col(column)) if magnitude else F.col(column)
    ok = F.lit(True)
    if at_most is not None:
        ok = ok & (c <= at_most)
    if more_than is not None:
        ok = ok & (c > more_than)
    return F.coalesce(ok & ~F.isnan(c.cast("double")), F.lit(False))


def behavior_interval_mask(frames: DataFrame, keys: list[str], order: list[str], time: str,
                           passing: Column, start_mask: str | None = None, min_duration=0,
                           chunks=None) -> DataFrame:
    """Inter-frame intervals whose two frames pass, in stretches of at least `min_duration`.

    Adds ``interval_kept`` to each frame, about the interval that follows it; the
    last frame of a key has null.
    """
    chunks = plan_cuts(frames, order, chunks, keyless=not keys)
    work = frames.withColumn("__pass", passing)
    work = scan(work, keys, order, {"__next": following(F.struct(F.col("__pass").alias("ok"), F.col(time).alias("t")))}, chunks)
    start = F.col(start_mask) if start_mask else F.lit(True)
    keep = F.coalesce(start & F.col("__pass") & F.col("__next.ok"), F.lit(False))
    work = work.withColumns({"__keep": keep, "__stop": F.col("__next.t")})
    work = label_runs(work, keys, order, ["__keep"], "__run", chunks=chunks)
    if min_duration:
        spans = work.where("__keep").groupBy(*keys, "__run").agg(
            (F.max("__stop") - F.min(time)).alias("__span"))
        long = spans.where(F.col("__span") >= min_duration).select(*keys, "__run", F.lit(True).alias("__long"))
        work = work.join(long, [*keys, "__run"], "left")
        work = work.withColumn("__keep", F.col("__keep") & F.coalesce("__long", F.lit(False)))
    kept = F.when(F.col("__stop").isNotNull(), F.col("__keep"))
    return work.select(*frames.columns, kept.alias("interval_kept"), F.col("__stop").alias("next_time"))


def interval_mask_to_spans(masked: DataFrame, keys: list[str], order: list[str], time: str,
                           mask: str = "interval_kept", chunks=None) -> DataFrame:
    """Spans covered by runs of kept intervals, first frame to last frame."""
    work = masked.withColumn("__m", F.coalesce(F.col(mask), F.lit(False)))
    work = label_runs(work, keys, order, ["__m"], "__run", chunks=chunks).where("__m")
    return work.groupBy(*keys, "__run").agg(
        F.min(time).alias("start"), F.max("next_time").alias("stop"),
        F.count("*").cast("bigint").alias("n_intervals")).drop("__run")
