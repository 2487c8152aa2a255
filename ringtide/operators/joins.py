"""As-of, interval and nearest joins, planned as sorts or equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import last_valid, running_max, scan


def _stack(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str,
           payload: list[str], tie: str | None) -> DataFrame:
    """Left and right rows in one table, right rows first at equal times."""
    left_row = F.struct(*left.columns)
    left_type = left.select(left_row.alias("x")).schema["x"].dataType
    right_row = F.struct(*payload)
    right_type = right.select(right_row.alias("x")).schema["x"].dataType
    tie_type = right.schema[tie].dataType if tie else None
    # a row without a time comes before nothing
    a = right.where(F.col(right_on).isNotNull()).select(
        *by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"),
        (F.col(tie) if tie else F.lit(0)).alias("__tie"),
        right_row.alias("__right"), F.lit(None).cast(left_type).alias("__left"),
    )
    b = left.select(
        *by, F.col(left_on).alias("__t"), F.lit(1).alias("__side"),
        (F.lit(None).cast(tie_type) if tie else F.lit(0)).alias("__tie"),
        F.lit(None).cast(right_type).alias("__right"), left_row.alias("__left"),
    )
    return a.unionByName(b)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str,
              payload: list[str], tie: str | None = None, chunks=None) -> DataFrame:
    """For each left row the latest right row with ``right_on <= left_on``; nulls if none.

    One sort of both sides: linear in the rows, and a hot key is cut into chunks.
    """
    stacked = _stack(left, right, by, left_on, right_on, payload, tie)
    out = scan(stacked, by, ["__t", "__side", "__tie"], {"__hit": last_valid("__right")}, chunks)
    out = out.where("__side = 1")
    return out.select(
        *[F.col("__left")[c].alias(c) for c in left.columns],
        *[F.col("__hit")[c].alias(c) for c in payload],
    )


def running_max_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str,
                     right_on: str, value: str, out_name: str, chunks=None) -> DataFrame:
    """For each left row the largest `value` of all right rows with ``right_on <= left_on``."""
    stacked = _stack(left, right, by, left_on, right_on, [value], None)
    stacked = stacked.withColumn("__value", F.col("__right")[value])
    out = scan(stacked, by, ["__t", "__side", "__tie"], {"__hit": running_max("__value")}, chunks)
    out = out.where("__side = 1")
    return out.select(
        *[F.col("__left")[c].alias(c) for c in left.columns], F.col("__hit").alias(out_name)
    )


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], t: str, start: str,
                  stop: str, width: float, how: str = "inner") -> DataFrame:
    """Every (point, span) with ``start <= t < stop``, as an equi-join on time buckets.

    Each span is copied into the buckets of `width` it touches, so pick a width
    near the usual span length; a busy bucket is an ordinary skewed join key.
    """
    bucket = F.floor(F.col(t) / width).cast("bigint")
    p = points.withColumn("__bucket", bucket)
    first = F.floor(F.col(start) / width).cast("bigint")
    last = F.floor((F.col(stop)) / width).cast("bigint")
    s = spans.where(F.col(stop) > F.col(start)).withColumn("__bucket", F.explode(F.sequence(first, last)))
    condition = [p[c] == s[c] for c in [*by, "__bucket"]]
    joined = None
    for c in condition:
        joined = c if joined is None else joined & c
    joined = joined & (p[t] >= s[start]) & (p[t] < s[stop])
    out = p.join(s, joined, how)
    for c in by:
        out = out.drop(s[c])
    if how in ("left_semi", "left_anti"):
        return out.drop("__bucket")
    return out.drop(p["__bucket"]).drop(s["__bucket"])


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], a_start: str, a_stop: str,
                 b_start: str, b_stop: str, width: float) -> DataFrame:
    """Every pair of overlapping half-open spans, with the clipped span ``lo``..``hi``."""
    def buckets(lo, hi):
        return F.sequence(F.floor(F.col(lo) / width).cast("bigint"),
                          F.floor(F.col(hi) / width).cast("bigint"))

    x = a.withColumn("__bucket", F.explode(buckets(a_start, a_stop)))
    y = b.withColumn("__bucket", F.explode(buckets(b_start, b_stop)))
    out = x.join(y, [*by, "__bucket"])
    lo = F.greatest(F.col(a_start), F.col(b_start))
    hi = F.least(F.col(a_stop), F.col(b_stop))
    # a pair sharing several buckets is kept only in the bucket where its overlap begins
    return (out.withColumn("lo", lo).withColumn("hi", hi).where("hi > lo")
            .where(F.col("__bucket") == F.floor(F.col("lo") / width)).drop("__bucket"))


def near_sites(sites: DataFrame, reference: DataFrame, x: str, y: str, ref_key: str,
               tolerance: float) -> DataFrame:
    """Pairs of a site and a reference site within `tolerance`, through a grid of that pitch.

    Only the nine neighbouring cells are looked at, so no all-pairs product arises.
    """
    cell = max(float(tolerance), 1e-9)
    a = sites.withColumns({
        "__cx": F.floor(F.col(x) / cell).cast("bigint"),
        "__cy": F.floor(F.col(y) / cell).cast("bigint"),
    })
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                       for i in (-1, 0, 1) for j in (-1, 0, 1)])
    r = (reference.select(F.col(ref_key), F.col(x).alias("__rx"), F.col(y).alias("__ry"))
         .withColumn("__n", F.explode(around))
         .withColumns({
             "__cx": (F.floor(F.col("__rx") / cell) + F.col("__n.i")).cast("bigint"),
             "__cy": (F.floor(F.col("__ry") / cell) + F.col("__n.j")).cast("bigint"),
         }).drop("__n"))
    d = F.sqrt((F.col(x) - F.col("__rx")) ** 2 + (F.col(y) - F.col("__ry")) ** 2)
    hits = a.join(r, ["__cx", "__cy"]).withColumn("distance", d).where(F.col("distance") <= tolerance)
    return hits.drop("__cx", "__cy", "__rx", "__ry")


def pick(*columns) -> Column:
    """First non-null of several columns."""
    return F.coalesce(*[F.col(c) if isinstance(c, str) else c for c in columns])
