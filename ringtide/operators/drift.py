"""Probe movement at the junctions of concatenated sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import previous, scan


def probe_row_pitch(sites: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """Smallest gap between distinct depths, per probe; null with one depth only."""
    rows = sites.select(*keys, F.round(F.col(y).cast("double"), 3).alias("__y")).distinct()
    gaps = scan(rows, keys, ["__y"], {"__before": previous("__y")})
    return gaps.groupBy(*keys).agg(F.min(F.col("__y") - F.col("__before")).alias("pitch"))


def verdict(step, sig_interp: float, pitch) -> Column:
    """Four-level judgement of a step in microns."""
    s, p = (F.col(c) if isinstance(c, str) else c for c in (step, pitch))
    return (F.when(p.isNotNull() & (s < p), "negligible").when(s <= sig_interp, "correctable")
            .when(s <= 2 * sig_interp, "marginal").otherwise("beyond correction"))


def drift_at_junctions(shifts: DataFrame, junctions: DataFrame, by: list[str], window: int, sig_interp: float,
                       pitch: float | None) -> DataFrame:
    """Mean shift on each side of each junction, without the batch that contains it.

    `shifts` has ``batch, section, um``; `junctions` ``junction, batch``. Each
    junction names its 2*window neighbouring batches, so the join is on equality.
    """
    offsets = F.explode(F.array(*[F.lit(i) for i in range(-window, window + 1) if i]))
    near = junctions.withColumn("__o", offsets).select(
        *by, "junction", F.col("batch").alias("boundary_batch"), (F.col("batch") + F.col("__o")).alias("batch"),
        F.when(F.col("__o") < 0, "pre").otherwise("post").alias("__side"))
    joined = near.join(shifts, [*by, "batch"])
    pre, post = F.col("__side") == "pre", F.col("__side") == "post"
    per_batch = joined.groupBy(*by, "junction", "boundary_batch", "batch", "__side").agg(
        F.sum("um").alias("s"), F.count("um").alias("n"), (F.max("um") - F.min("um")).alias("spread"))
    out = per_batch.groupBy(*by, "junction", "boundary_batch").agg(
        (F.sum(F.when(pre, F.col("s"))) / F.sum(F.when(pre, F.col("n")))).alias("pre_mean_um"),
        (F.sum(F.when(post, F.col("s"))) / F.sum(F.when(post, F.col("n")))).alias("post_mean_um"),
        F.avg(F.when(post, F.col("spread"))).alias("nonrigid_spread_um"))
    out = out.where("pre_mean_um IS NOT NULL AND post_mean_um IS NOT NULL")
    out = out.withColumn("step_um", F.abs(F.col("post_mean_um") - F.col("pre_mean_um")))
    p = F.lit(pitch).cast("double")
    return out.withColumns({
        "step_in_row_pitch": F.col("step_um") / p, "step_in_sig_interp": F.col("step_um") / F.lit(sig_interp),
        "verdict": verdict("step_um", sig_interp, p)})
