"""Exact quantiles by rank, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import ALL as _ALL
from .scan import running_sum, scan


def finite(x: Column | str) -> Column:
    """True where a double is neither null, NaN nor infinite."""
    c = F.col(x) if isinstance(x, str) else x
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def corr_or_null(a: str, b: str) -> Column:
    """Pearson r of the rows that hold both, as an aggregate; null if either side is flat.

    ``F.corr`` divides by zero there, which ANSI mode refuses even under a ``F.when``.
    """
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
              chunks=None) -> DataFrame:
    """Linear-interpolation quantiles of each key, one column per name in `probs`.

    Equal values are counted together before the sort, so a value that fills a
    third of the table costs one row.
    """
    work = df.where(finite(value)).select(*keys, F.col(value).cast("double").alias("__v"))
    group = list(keys) or [_ALL]
    if not keys:
        work = work.withColumn(_ALL, F.lit(0))
    counted = work.groupBy(*group, "__v").agg(F.count("*").alias("__n"))
    ranked = scan(counted, group, ["__v"], {"__upto": running_sum("__n")}, chunks)
    totals = counted.groupBy(*group).agg(F.sum("__n").alias("__total"))
    ranked = ranked.join(totals, group)
    at = {}
    for i, p in enumerate(probs.values()):
        rank = F.lit(float(p)) * (F.col("__total") - 1)
        for side, k in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            inside = (F.col("__upto") - F.col("__n") <= k) & (k < F.col("__upto"))
            at[f"__{side}{i}"] = F.max(F.when(inside, F.col("__v")))
        at[f"__frac{i}"] = F.max(rank - F.floor(rank))
    picked = ranked.groupBy(*group).agg(
        F.max("__total").alias("__total"), *[c.alias(n) for n, c in at.items()])
    out = [
        (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__frac{i}")).alias(name)
        for i, name in enumerate(probs)
    ]
    return picked.select(*keys, F.col("__total").cast("bigint").alias("n_values"), *out)


def average_rank(df: DataFrame, keys: list[str], value: str, name: str = "avg_rank",
                 chunks=None) -> DataFrame:
    """Add the rank of each row's value from 1, ties sharing their mean rank."""
    group = list(keys) or [_ALL]
    work = df if keys else df.withColumn(_ALL, F.lit(0))
    counted = work.groupBy(*group, value).agg(F.count("*").alias("__n"))
    ranked = scan(counted, group, [value], {"__upto": running_sum("__n")}, chunks)
    ranked = ranked.select(*group, value, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(name))
    out = work.join(ranked, [*group, value])
    return out.select(*df.columns, name)
