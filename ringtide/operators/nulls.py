"""Seeded null distributions and how an observed value is judged against one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import _ALL


def draw_shifts(n: int, low: int, high: int, seed: int = 0) -> list[int]:
    """`n` shifts in [low, high) from a seeded generator."""
    return [int(x) for x in np.random.default_rng(seed).integers(low, high, size=n)]


def shifts_by_size(n: int, least: int, seed: int = 0) -> Callable[[Column], Column]:
    """`n` shifts in [least, size - least) for every size in a column, each drawn by a generator of its own from the seed.

    A size without room for a shift, or none, gives null.
    """

    @F.pandas_udf("array<bigint>")
    def drawn(sizes: pd.Series) -> pd.Series:
        return pd.Series([draw_shifts(n, least, int(x) - least, seed) if pd.notna(x) and 2 * least < x else None for x in sizes], dtype=object)

    return drawn


def draw_orders(n: int, size: int, seed: int = 0) -> list[list[int]]:
    """`n` permutations of ``range(size)`` from one seeded generator."""
    rng = np.random.default_rng(seed)
    return [[int(x) for x in rng.permutation(size)] for _ in range(n)]


def lower_is_better(metric: str) -> bool:
    """Errors are better small, everything else large."""
    return "error" in metric or "rmse" in metric


def judge(null: DataFrame, observed: DataFrame, keys: list[str], metric: str, value: str = "value") -> DataFrame:
    """Permutation p, null mean and spread, z-score per key.

    `observed` holds one row per key with column `value`; `null` one row per key
    and shuffle.
    """
    group = list(keys) or [_ALL]
    if not keys:
        null, observed = null.withColumn(_ALL, F.lit(0)), observed.withColumn(_ALL, F.lit(0))
    seen = observed.select(*group, F.col(value).alias("observed"))
    both = null.select(*group, F.col(value).alias("__null")).join(seen, group)
    hit = F.col("__null") <= F.col("observed") if lower_is_better(metric) else F.col("__null") >= F.col("observed")
    out = both.groupBy(*group).agg(
        F.first("observed").alias("observed"), F.count("*").cast("bigint").alias("n_shuffles"),
        F.sum(hit.cast("bigint")).alias("hits"), F.avg("__null").alias("null_mean"),
        F.stddev_pop("__null").alias("null_sd"))
    z = F.when(F.col("null_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_sd"))
    return out.select(
        *keys, F.lit(metric).alias("metric"), "observed", "n_shuffles", "null_mean", "null_sd",
        ((1 + F.col("hits")) / (F.col("n_shuffles") + 1)).alias("p_value"), z.alias("z_score"),
        F.lit("lower" if lower_is_better(metric) else "higher").alias("better"))
