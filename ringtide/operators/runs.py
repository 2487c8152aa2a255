"""Gaps and islands: runs of equal value, runs of a mask, their spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import following, plan_cuts, previous, running_sum, scan


def label_runs(df: DataFrame, keys: list[str], order: list[str], values: list[str],
               name: str = "run", also: Column | None = None, chunks=None) -> DataFrame:
    """Number from 0 the runs of rows whose `values` equal the row before.

    `also` is a condition over ``__prev.<column>`` and the row that starts a run too.
    """
    chunks = plan_cuts(df, order, chunks, keyless=not keys)
    held = F.struct(*[F.col(c) for c in dict.fromkeys([*values, *order])])
    out = scan(df, keys, order, {"__prev": previous(held)}, chunks)
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col("__prev")[v])
    starts = F.col("__prev").isNull() | ~same
    if also is not None:
        starts = starts | F.coalesce(also, F.lit(False))
    out = out.withColumn("__new", starts.cast("bigint"))
    out = scan(out, keys, order, {name: running_sum("__new")}, chunks)
    return out.withColumn(name, (F.col(name) - 1).cast("bigint")).drop("__prev", "__new")


def state_epochs(bins: DataFrame, keys: list[str], index: str, time: str, code: str, step,
                 chunks=None) -> DataFrame:
    """Runs of one code: state span widened by half a step, first and last bin inclusive."""
    runs = label_runs(bins, keys, [index], [code], "__run", chunks=chunks)
    half = F.lit(step) / 2
    return runs.groupBy(*keys, "__run").agg(
        F.first(code).alias(code),
        (F.min(time) - half).alias("start"),
        (F.max(time) + half).alias("stop"),
        F.min(index).alias("first_bin"),
        F.max(index).alias("last_bin"),
        F.count("*").cast("bigint").alias("n_bins"),
    ).drop("__run")


def true_runs(df: DataFrame, keys: list[str], order: list[str], mask: str,
              measures: dict[str, Column], chunks=None) -> DataFrame:
    """One row per run of TRUE with the given aggregates."""
    runs = label_runs(df, keys, order, [mask], "run", chunks=chunks).where(F.col(mask))
    return runs.groupBy(*keys, "run").agg(*[c.alias(n) for n, c in measures.items()])


def masked_runs(df: DataFrame, keys: list[str], order: list[str], mask: Column, duration: str,
                max_gap, min_run, chunks=None) -> DataFrame:
    """Rows of the runs worth decoding, numbered by ``run``.

    Rows longer than `max_gap` are holes: they leave the mask before runs are
    found, and runs shorter than `min_run` in total are dropped.
    """
    kept = mask & (F.col(duration) <= max_gap)
    work = df.withColumn("__keep", F.coalesce(kept, F.lit(False)))
    work = label_runs(work, keys, order, ["__keep"], "run", chunks=chunks).where("__keep").drop("__keep")
    sizes = work.groupBy(*keys, "run").agg(F.sum(duration).alias("__total"))
    sizes = sizes.where(F.col("__total") >= min_run).select(*keys, "run")
    return work.join(sizes, [*keys, "run"], "left_semi")


def intervals_between_frames(df: DataFrame, keys: list[str], order: list[str], mask: str,
                             out: str = "interval_kept", chunks=None) -> DataFrame:
    """An inter-frame interval is kept if both frames around it are; the last row gets null."""
    held = scan(df, keys, order, {"__next": following(F.col(mask))}, chunks)
    return held.withColumn(out, F.when(F.col("__next").isNotNull(), F.col(mask) & F.col("__next"))).drop("__next")
