"""Concatenated recordings back into sessions: frames, spikes, states, time stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import overlap_join
from .scan import following, running_sum, scan


def cumulative_offsets(sessions: DataFrame, keys: list[str], index: str, n: str, chunks=None) -> DataFrame:
    """First frame of each session on the concatenated clock."""
    out = scan(sessions, keys, [index], {"__upto": running_sum(n)}, chunks)
    return out.withColumn("offset", (F.col("__upto") - F.col(n)).cast("bigint")).drop("__upto")


def session_bounds(offsets: DataFrame, keys: list[str], index: str, offset: str, chunks=None) -> DataFrame:
    """Consecutive offsets as half-open frame spans; the last offset closes the last span."""
    out = scan(offsets, keys, [index], {"stop": following(offset)}, chunks)
    return out.where("stop IS NOT NULL").withColumn("start", F.col(offset))


def split_frames(rows: DataFrame, bounds: DataFrame, by: list[str], frame: str, width: int) -> DataFrame:
    """Rows with the session that holds their frame and the frame counted from its start."""
    from .joins import interval_join

    out = interval_join(rows, bounds, by, frame, "start", "stop", width)
    return out.withColumn("local_frame", F.col(frame) - F.col("start"))


def split_counts(split: DataFrame, units: DataFrame, sessions: DataFrame, session: str, unit: str) -> DataFrame:
    """Spikes per session and unit; a silent unit keeps its row with 0."""
    counted = split.groupBy(session, unit).agg(F.count("*").cast("bigint").alias("n_spikes"))
    names = sessions.agg(F.collect_set(session).alias("__s"))  # one short name per session
    grid = units.select(unit).distinct().withColumn("__s", names.scalar()).select(unit, F.explode("__s").alias(session))
    out = grid.join(counted, [session, unit], "left")
    return out.withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)).cast("bigint"))


def split_states(intervals: DataFrame, bounds: DataFrame, by: list[str], width: float) -> DataFrame:
    """State spans clipped to each session and shifted to its clock; empty ones are dropped."""
    b = bounds.withColumnsRenamed({"start": "__t0", "stop": "__t1"})
    out = overlap_join(intervals, b, by, "start", "stop", "__t0", "__t1", width)
    return out.withColumns({"start": F.col("lo") - F.col("__t0"), "stop": F.col("hi") - F.col("__t0")}).drop("lo", "hi", "__t1")


def to_concatenated_time(intervals: DataFrame, sessions: DataFrame, by: list[str]) -> DataFrame:
    """State spans moved onto the concatenated clock, gathered and sorted per state."""
    moved = intervals.join(sessions.select(*by, "t_start"), by)
    return moved.withColumns({"start": F.col("start") + F.col("t_start"), "stop": F.col("stop") + F.col("t_start")}).drop("t_start")


def timestamps(rows: DataFrame, frame: str, fs: float, offset: str | None = None) -> DataFrame:
    """Seconds of each frame, from the session's start or from the recording's."""
    base = F.col(frame) + F.col(offset) if offset else F.col(frame)
    return rows.withColumn("t", base.cast("double") / F.lit(float(fs)))
