"""Cuts read off a distribution: two-mode splits, fences, two-level traces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import cut_lineage
from .quantiles import _ALL, finite, quantiles
from .scan import following, running_sum, scan


def otsu_table(df: DataFrame, keys: list[str], value: str, chunks=None) -> DataFrame:
    """Per key the split of sorted values with the largest between-group variance.

    Ties are never split and the cut is the midpoint of the gap; keys with fewer
    than two distinct values get no row.
    """
    group = list(keys) or [_ALL]
    work = df.where(finite(value)).select(*keys, F.col(value).cast("double").alias("v"))
    if not keys:
        work = work.withColumn(_ALL, F.lit(0))
    counted = work.groupBy(*group, "v").agg(F.count("*").alias("n"))
    counted = counted.withColumn("s", F.col("v") * F.col("n"))
    sums = scan(counted, group, ["v"], {
        "k": running_sum("n"), "low": running_sum("s"), "v_next": following("v")}, chunks)
    totals = counted.groupBy(*group).agg(F.sum("n").alias("total"), F.sum("s").alias("total_sum"))
    sums = sums.join(totals, group).where("v_next IS NOT NULL")
    share = F.col("k") / F.col("total")
    gap = F.col("low") / F.col("k") - (F.col("total_sum") - F.col("low")) / (F.col("total") - F.col("k"))
    sums = sums.withColumn("between", share * (1 - share) * gap * gap)
    best = sums.groupBy(*group).agg(
        F.max_by((F.col("v") + F.col("v_next")) / 2, F.struct(F.round("between", 12), -F.col("v"))).alias("cutoff"),
        F.max_by("k", F.struct(F.round("between", 12), -F.col("v"))).cast("bigint").alias("n_low"),
        F.max("total").cast("bigint").alias("n_values"),
    )
    return best.select(*keys, "cutoff", "n_low", "n_values")


def find_bimodal_threshold(df: DataFrame, value: str) -> float:
    """The split of one column as a number; refuses fewer than two distinct values."""
    row = otsu_table(df, [], value).first()
    if row is None:
        raise ValueError("need at least two distinct finite values")
    return float(row["cutoff"])


def upper_fence(df: DataFrame, keys: list[str], value: str, log: bool = False, k: float = 1.5) -> DataFrame:
    """Tukey's Q3 + k IQR per key, on log10 of the positive values if `log`; null below 10 values."""
    work = df.where(finite(value))
    if log:
        work = work.where(F.col(value) > 0).withColumn(value, F.log10(F.col(value).cast("double")))
    q = quantiles(work, keys, value, {"q1": 0.25, "q3": 0.75})
    fence = F.col("q3") + k * (F.col("q3") - F.col("q1"))
    fence = F.pow(F.lit(10.0), fence) if log else fence
    return q.select(*keys, "n_values", F.when(F.col("n_values") >= 10, fence).alias("fence"))


BROADCAST_KEYS = 100_000  # parameter rows that still go to every task; more are joined by a shuffle


def _settle(state: DataFrame, measure: bool = True) -> tuple[DataFrame, bool]:
    """Cut an iteration's parameters from their history, and see whether they are few enough to broadcast."""
    state = cut_lineage(state)
    return state, measure and state.count() <= BROADCAST_KEYS


def gaussian_pair(df: DataFrame, keys: list[str], value: str, iterations: int = 20) -> DataFrame:
    """Two-Gaussian mixture per key by expectation-maximisation.

    Deterministic: the components start at the quartiles with the pooled
    variance and equal weights, and run a fixed number of iterations. Each
    iteration is one grouped sum over the counted values, so no key is ever
    gathered in a task.
    """
    group = list(keys) or [_ALL]
    work = df.where(finite(value)).select(*keys, F.col(value).cast("double").alias("x"))
    if not keys:
        work = work.withColumn(_ALL, F.lit(0))
    counted = work.groupBy(*group, "x").agg(F.count("*").alias("n")).persist()
    try:
        q = quantiles(work, group, "x", {"m1": 0.25, "m2": 0.75})
        s = counted.groupBy(*group).agg(
            F.sum("n").alias("total"), F.sum(F.col("n") * F.col("x")).alias("sx"),
            F.sum(F.col("n") * F.col("x") * F.col("x")).alias("sxx"),
            F.min("x").alias("lo"), F.max("x").alias("hi"))
        var = F.col("sxx") / F.col("total") - F.pow(F.col("sx") / F.col("total"), 2)
        start = q.join(s, group).withColumns({"v": F.greatest(var, F.lit(1e-12))})
        state = start.select(*group, "total", "lo", "hi", "m1", "m2",
                             F.col("v").alias("v1"), F.col("v").alias("v2"), F.lit(0.5).alias("w1"))
        state, few = _settle(state)

        def density(m, v):
            return F.exp(-F.pow(F.col("x") - F.col(m), 2) / (2 * F.col(v))) / F.sqrt(F.col(v))

        a = F.col("w1") * density("m1", "v1")
        b = (1 - F.col("w1")) * density("m2", "v2")
        nearer = F.when(F.abs(F.col("x") - F.col("m1")) <= F.abs(F.col("x") - F.col("m2")), 1.0).otherwise(0.0)
        r = F.when(a + b > 0, a / (a + b)).otherwise(nearer)
        x, n = F.col("x"), F.col("n")
        for _ in range(iterations):
            step = counted.join(F.broadcast(state) if few else state, group).withColumn("r", r)
            sums = step.groupBy(*group).agg(
                *[F.first(c).alias(c) for c in ("total", "lo", "hi", "m1", "m2", "v1", "v2")],
                F.sum(n * F.col("r")).alias("r1"), F.sum(n * F.col("r") * x).alias("x1"),
                F.sum(n * F.col("r") * x * x).alias("xx1"), F.sum(n * (1 - F.col("r"))).alias("r2"),
                F.sum(n * (1 - F.col("r")) * x).alias("x2"), F.sum(n * (1 - F.col("r")) * x * x).alias("xx2"))
            new = {}
            for i in ("1", "2"):
                some = F.col("r" + i) > 0
                mean = F.col("x" + i) / F.when(some, F.col("r" + i))
                new["m" + i] = F.coalesce(mean, F.col("m" + i))
                new["v" + i] = F.coalesce(F.greatest(F.col("xx" + i) / F.when(some, F.col("r" + i)) - mean * mean, F.lit(1e-12)), F.col("v" + i))
            state, _ = _settle(sums.select(
                *group, "total", "lo", "hi", *[c.alias(k) for k, c in new.items()], (F.col("r1") / F.col("total")).alias("w1")), False)
        return state.drop(*([] if keys else [_ALL]))
    finally:
        counted.unpersist()


def bimodality_score(df: DataFrame, keys: list[str], value: str, min_values: int = 50) -> DataFrame:
    """Distance of the two mixture means in pooled standard deviations; null if it cannot be fitted."""
    fit = gaussian_pair(df, keys, value)
    pooled = F.sqrt((F.col("v1") + F.col("v2")) / 2)
    score = F.abs(F.col("m1") - F.col("m2")) / F.greatest(pooled, F.lit(1e-12))
    ok = (F.col("total") >= min_values) & (F.col("hi") > F.col("lo"))
    return fit.select(*keys, F.col("total").cast("bigint").alias("n_values"), F.when(ok, score).alias("score"))


def crossing(row, n_grid: int = 1000, median: float | None = None) -> float:
    """First point of an even grid between the means where the other component takes over."""
    (lo, v_lo, w_lo), (hi, v_hi, w_hi) = sorted(
        [(row["m1"], row["v1"], row["w1"]), (row["m2"], row["v2"], 1 - row["w1"])])
    if math.isclose(lo, hi, rel_tol=1e-5, abs_tol=1e-8):
        return median
    last = None
    for i in range(n_grid):
        x = lo + (hi - lo) * i / (n_grid - 1)
        a = math.log(max(w_lo, 1e-300)) - 0.5 * math.log(v_lo) - (x - lo) ** 2 / (2 * v_lo)
        b = math.log(max(w_hi, 1e-300)) - 0.5 * math.log(v_hi) - (x - hi) ** 2 / (2 * v_hi)
        sign = (a > b) - (a < b)
        if last is not None and sign != last:
            return lo + (hi - lo) * (i - 1) / (n_grid - 1)
        last = sign
    return median


def bimodal_threshold(df: DataFrame, value: str, n_grid: int = 1000) -> float:
    """Split a column at the trough between its two modes; the median if it has one mode only."""
    mid = quantiles(df, [], value, {"m": 0.5}).first()
    if mid is None or not mid["n_values"]:
        return 0.0
    if mid["n_values"] < 10:
        return float(mid["m"])
    return float(crossing(gaussian_pair(df, [], value).first(), n_grid, mid["m"]))


def bimodal_thresholds(df: DataFrame, keys: list[str], value: str, n_grid: int = 1000) -> DataFrame:
    """`bimodal_threshold` of every key at once: ``keys, n_values, threshold``. A task looks for the crossing in each key's own row."""
    fit = gaussian_pair(df, keys, value)
    mid = quantiles(df, keys, value, {"m": 0.5})
    both = fit.join(mid, keys) if keys else fit.withColumns({"m": mid.select("m").scalar(), "n_values": mid.select("n_values").scalar()})
    types = {f.name: f.dataType.simpleString() for f in both.schema}

    def work(frames):
        for pdf in frames:
            out = pdf[[*keys, "n_values"]].copy()
            out["threshold"] = [float(r["m"]) if r["n_values"] < 10 else float(crossing(r, n_grid, r["m"])) for r in pdf.to_dict("records")]
            yield out

    schema = "".join(f"{k} {types[k]}, " for k in keys) + "n_values bigint, threshold double"
    return both.select(*keys, "n_values", "m", "m1", "m2", "v1", "v2", "w1").mapInPandas(work, schema)


def movement_thresholds(df: DataFrame, keys: list[str], speed: str, floor: float = 1e-3) -> DataFrame:
    """`movement_threshold` of every key: ``keys, n_values, threshold`` (log10 of the speed), null below ten values."""
    work = df.where(finite(speed)).select(*keys, F.log10(F.greatest(F.col(speed).cast("double"), F.lit(floor))).alias("x"))
    found = bimodal_thresholds(work, keys, "x")
    return found.withColumn("threshold", F.when(F.col("n_values") >= 10, F.col("threshold")))


def automatic_thresholds(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``keys, threshold``: a cut read off each key's own values; null where there are too few.

    A least speed lies between the two modes of its logarithm. Any other limit is
    the upper fence, of the logarithm unless it limits an elevation.
    """
    if name == "min_speed_mm_s":
        return movement_thresholds(df, keys, value).select(*keys, F.pow(F.lit(10.0), "threshold").alias("threshold"))
    return upper_fence(df, keys, value, log=name != "max_elevation_deg").select(*keys, F.col("fence").alias("threshold"))


def movement_threshold(df: DataFrame, speed: str, floor: float = 1e-3) -> float | None:
    """Two-mode split of log10 speed; None with fewer than ten values."""
    work = df.where(finite(speed)).select(
        F.log10(F.greatest(F.col(speed).cast("double"), F.lit(floor))).alias("x"))
    if work.limit(10).count() < 10:
        return None
    return bimodal_threshold(work, "x")


def two_level_thresholds(df: DataFrame, keys: list[str], value: str, max_iter: int = 50) -> DataFrame:
    """Midpoint between the means above and below it, iterated to rest; null for a flat trace.

    Starts halfway between the extremes. All keys step together and each step is
    one grouped aggregate.
    """
    counted = df.where(finite(value)).groupBy(*keys, F.col(value).cast("double").alias("x")).agg(
        F.count("*").alias("n")).persist()
    try:
        spans = counted.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        middle = F.when(F.col("hi") > F.col("lo"), (F.col("lo") + F.col("hi")) / 2)
        state, few = _settle(spans.withColumns({"threshold": middle, "done": middle.isNull()}))
        x, n = F.col("x"), F.col("n")
        above = x > F.col("threshold")
        for _ in range(max_iter):
            if state.where("NOT done").isEmpty():
                break
            sums = counted.join(F.broadcast(state) if few else state, keys).groupBy(*keys).agg(
                *[F.first(c).alias(c) for c in ("lo", "hi", "threshold", "done")],
                (F.sum(F.when(above, n * x)) / F.sum(F.when(above, n))).alias("high"),
                (F.sum(F.when(~above, n * x)) / F.sum(F.when(~above, n))).alias("low"))
            new = (F.col("high") + F.col("low")) / 2
            # at rest: the last threshold stands once a step changes it by a rounding error
            still = F.abs(new - F.col("threshold")) <= 1e-8 + 1e-5 * F.abs("threshold")
            done = F.col("done") | F.coalesce(still, F.lit(True))
            state, _ = _settle(sums.select(*keys, "lo", "hi", F.when(done, F.col("threshold")).otherwise(new).alias("threshold"), done.alias("done")), False)
        return state.drop("done")
    finally:
        counted.unpersist()


__all__ = ["otsu_table", "find_bimodal_threshold", "upper_fence", "gaussian_pair", "bimodality_score",
           "bimodal_threshold", "bimodal_thresholds", "movement_threshold", "movement_thresholds", "automatic_thresholds", "two_level_thresholds"]
