"""Probe channels: shared sites, gains, bad lists, depth-spread picks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_sync_label
from .joins import near_sites
from .scan import number_rows


def drop_sync_channels(channels: DataFrame, label: str) -> DataFrame:
    """Channels that are not sync lines."""
    return channels.where(~is_sync_label(label))


def align_channels_by_location(sites: DataFrame, recording: str, channel: str, reference, x: str = "x",
                               y: str = "y", tolerance: float = 1.0) -> DataFrame:
    """Sites of the reference recording found within `tolerance` in every recording.

    Returns one row per recording and kept site with the channel that sits
    there. ``one_to_one`` is false where two sites fell on one channel.
    """
    ref = sites.where(F.col(recording) == reference).select(F.col(channel).alias("site"), x, y)
    hits = near_sites(sites.select(recording, channel, x, y), ref, x, y, "site", tolerance)
    best = hits.groupBy(recording, "site").agg(F.min(F.struct("distance", channel)).alias("__b"))
    best = best.select(recording, "site", F.col("__b")[channel].alias(channel), F.col("__b.distance").alias("residual"))
    n = sites.select(recording).distinct().agg(F.count("*").alias("n")).scalar()
    common = best.groupBy("site").agg(F.count("*").alias("__n")).where(F.col("__n") == n).select("site")
    kept = best.join(common, "site", "left_semi")
    shared = kept.groupBy(recording, channel).agg((F.count("*") == 1).alias("one_to_one"))
    return kept.join(shared, [recording, channel])


def check_gain_consistency(channels: DataFrame, recording: str, channel: str, reference, columns: list[str],
                           relative: float = 1e-5, absolute: float = 1e-8) -> DataFrame:
    """Per recording whether every gain agrees with the first recording's."""
    ref = channels.where(F.col(recording) == reference).select(channel, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = channels.join(ref, channel)
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.abs(F.col(c) - F.col(f"__{c}")) <= absolute + relative * F.abs(F.col(f"__{c}")))
    return joined.groupBy(recording).agg(F.bool_and(ok).alias("consistent"), F.count("*").cast("bigint").alias("n_channels"))


def resolve_bad_channels(entries: DataFrame, channels: DataFrame) -> DataFrame:
    """Rows and ids meant by a mixed list of row numbers and ids, sorted and without repeats.

    `entries` has ``entry`` (text) and ``is_row``; `channels` has ``row, channel_id``.
    """
    by_row = entries.where("is_row").select(F.col("entry").cast("bigint").alias("row"))
    by_id = entries.where("NOT is_row").select(F.col("entry").alias("channel_id"))
    return channels.join(by_row, "row", "left_semi").unionByName(
        channels.join(by_id, "channel_id", "left_semi")).distinct()


def unresolved_bad_channels(entries: DataFrame, channels: DataFrame) -> DataFrame:
    """Entries that name no channel; the caller refuses them."""
    rows = entries.where("is_row").withColumn("row", F.col("entry").cast("bigint")).join(channels, "row", "left_anti")
    ids = entries.where("NOT is_row").withColumn("channel_id", F.col("entry")).join(channels, "channel_id", "left_anti")
    return rows.select("entry").unionByName(ids.select("entry"))


def bad_channel_union(detected: DataFrame, manual: DataFrame) -> DataFrame:
    """Detected and listed channels together, each with who named it."""
    both = detected.select("channel_id", F.lit("detected").alias("source")).unionByName(
        manual.select("channel_id", F.lit("manual").alias("source")))
    return both.groupBy("channel_id").agg(F.array_join(F.sort_array(F.collect_set("source")), "+").alias("source"))


def pick_channels(channels: DataFrame, keys: list[str], n: int, order: list[str]) -> DataFrame:
    """`n` channels evenly spread along `order`, ends included.

    The wanted positions depend on each probe's channel count and are built as
    an array of at most `n` numbers per probe.
    """
    from .quantiles import _ALL

    group = list(keys) or [_ALL]
    work = channels if keys else channels.withColumn(_ALL, F.lit(0))
    ranked = number_rows(work, group, order, "__i")
    totals = work.groupBy(*group).agg(F.count("*").alias("__n"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                        lambda k: F.rint((F.col("__n") - 1) * k / F.lit(max(n - 1, 1))).cast("bigint"))
    wanted = totals.withColumn("__want", F.when(F.col("__n") <= n, F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)).otherwise(
        F.array_distinct(steps)))
    wanted = wanted.select(*group, F.explode("__want").alias("__i"))
    out = ranked.join(wanted, [*group, "__i"], "left_semi")
    return out.select(*channels.columns)


def interleave(processed: DataFrame, raw: DataFrame, order: DataFrame, channel: str) -> DataFrame:
    """Processed and untouched channels together in their original order."""
    both = processed.unionByName(raw)
    return both.join(order, channel)


def even_positions(n_available: int, n: int) -> list[int]:
    """Positions of `n` items spread evenly over `n_available`, without repeats."""
    if n >= n_available:
        return list(range(n_available))
    return [int(i) for i in np.unique(np.linspace(0, n_available - 1, n).round().astype(int))]
