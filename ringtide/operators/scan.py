"""Ordered scans that stay correct when one key holds most of the rows.

A plain window ``PARTITION BY key ORDER BY t`` puts a whole key into one task.
Here the order column is first cut at its own quantiles into chunks, the window
runs inside ``(key, chunk)``, and what crosses a chunk border travels through a
carry table holding one row per ``(key, chunk)``. The result is the one a plain
window gives.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..scale import chunk_count

CHUNK = "__chunk"
ALL = "__all"  # the key of what has none
#: Rows drawn for each piece into which the rows of one leading value are cut; the draw moves cuts only.
TIE_SAMPLE = 100


@dataclass(frozen=True)
class Spec:
    """One output column of a scan: what to carry forward over which expression."""

    kind: str
    expr: Column | None = None


def previous(expr) -> Spec:
    """Value of the row before."""
    return Spec("previous", F.col(expr) if isinstance(expr, str) else expr)


def following(expr) -> Spec:
    """Value of the row after."""
    return Spec("following", F.col(expr) if isinstance(expr, str) else expr)


def running_sum(expr) -> Spec:
    """Sum up to and including the row."""
    return Spec("running_sum", F.col(expr) if isinstance(expr, str) else expr)


def running_max(expr) -> Spec:
    """Largest value up to and including the row."""
    return Spec("running_max", F.col(expr) if isinstance(expr, str) else expr)


def last_valid(expr) -> Spec:
    """Latest non-null value up to and including the row."""
    return Spec("last_valid", F.col(expr) if isinstance(expr, str) else expr)


def next_valid(expr) -> Spec:
    """Earliest non-null value from the row onwards."""
    return Spec("next_valid", F.col(expr) if isinstance(expr, str) else expr)


def position() -> Spec:
    """Zero-based position of the row inside its key."""
    return Spec("position", F.lit(1).cast("bigint"))


@dataclass(frozen=True)
class Cuts:
    """Where an order is cut; shared by the scans of one operator.

    `points` cut the axis of the leading column. An axis value that fills whole
    chunks by itself is in `ties` with the points that cut its rows: values of
    all order columns, compared as the order compares them.
    """

    points: tuple[float, ...] = ()
    ties: tuple[tuple[float, tuple[tuple, ...]], ...] = ()


def _exact(df: DataFrame, column: str) -> Column:
    """A value that is ordered as the column is and that a literal can hold."""
    kind, c = df.schema[column].dataType.simpleString(), F.col(column)
    if _is_numeric(df, column) or kind in ("boolean", "string", "binary"):
        return c
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    if kind == "date":
        return F.date_diff(c, F.lit("1970-01-01").cast("date"))
    raise TypeError(f"rows cannot be ordered by {column} of type {kind}")


def _axis(df: DataFrame, column: str) -> Column:
    """A number that never falls where `column` rises, null where it is null; what cuts are made on.

    Values that differ may share a number: long whole numbers, and texts that begin alike.
    """
    kind, c = df.schema[column].dataType.simpleString(), _exact(df, column)
    if kind in ("string", "binary"):  # the first six bytes
        raw = F.encode(c, "UTF-8") if kind == "string" else c
        return F.conv(F.rpad(F.hex(F.substring(raw, 1, 6)), 12, "0"), 16, 10).cast("double")
    return (c.cast("int") if kind == "boolean" else c).cast("double")


def _quantile_points(df: DataFrame, column: str, n: int) -> list[float]:
    return (
        df.select(_axis(df, column).alias("x")).where(F.col("x").isNotNull())
        .approxQuantile("x", [i / n for i in range(1, n)], min(0.05, 0.25 / n))
    )


def _is_numeric(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType.simpleString()
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


def plan_cuts(df: DataFrame, order: str | list[str], chunks: int | Cuts | None = None, keyless: bool = False) -> Cuts:
    """Cut points along `order`; quantile-sketch jobs, and only when there is enough to cut. `keyless` scans are cut finer."""
    if isinstance(chunks, Cuts):
        return chunks
    order = [order] if isinstance(order, str) else list(order)
    for column in order:
        _exact(df, column)  # refuses, cut or not
    n = chunk_count(df, chunks, keyless)
    if n <= 1:
        return Cuts()
    found = _quantile_points(df, order[0], n)
    points, ties = set(found), []
    for value in sorted(points):
        share = found.count(value)
        if share > 1:  # the value spans several chunks: give it its own and cut it further
            ties.append((value, _tie_points(df, order, value, share + 1)))
            points.add(math.nextafter(value, math.inf))
    return Cuts(tuple(sorted(points)), tuple(ties))


def _tie_points(df: DataFrame, order: list[str], value: float, pieces: int) -> tuple[tuple, ...]:
    """Rows that cut those of one axis value into about equal parts, from a bounded number of them."""
    names = [f"__c{i}" for i in range(len(order))]
    same = df.where(_axis(df, order[0]) == value).select(*[_exact(df, c).alias(n) for c, n in zip(order, names, strict=True)])
    drawn = same.orderBy(F.xxhash64(*names)).limit(TIE_SAMPLE * pieces).orderBy(*names)
    rows = [tuple(r) for r in drawn.collect()]
    return tuple(dict.fromkeys(rows[len(rows) * i // pieces] for i in range(1, pieces))) if rows else ()


def _bucket(df: DataFrame, column: str, points: tuple[float, ...], name: str) -> DataFrame:
    splits = [float("-inf"), *points, float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="__order", outputCol=name, handleInvalid="keep")
    out = cutter.transform(df.withColumn("__order", _axis(df, column)))
    # null sorts before all values; NaN, which sorts behind them, has a last chunk of its own
    return out.withColumn(name, F.when(F.col("__order").isNull(), 0).otherwise(F.col(name).cast("int"))).drop("__order")


def _reaches(df: DataFrame, order: list[str], point: tuple) -> Column:
    """Whether a row stands at `point` or behind it; nulls come first and NaN last, as in the order."""
    own = F.struct(*[_exact(df, c).alias(f"c{i}") for i, c in enumerate(order)])
    kinds = [f.dataType for f in df.select(*[_exact(df, c).alias(f"c{i}") for i, c in enumerate(order)]).schema]
    return own >= F.struct(*[F.lit(v).cast(k).alias(f"c{i}") for i, (v, k) in enumerate(zip(point, kinds, strict=True))])


def with_chunks(df: DataFrame, order: str | list[str], cuts: Cuts) -> tuple[DataFrame, int]:
    """Add the chunk number of each row along `order`."""
    if not cuts.points:
        return df.withColumn(CHUNK, F.lit(0)), 1
    order = [order] if isinstance(order, str) else list(order)
    out = _bucket(df, order[0], cuts.points, CHUNK)
    width = 1
    if cuts.ties:
        width = max(len(p) for _, p in cuts.ties) + 1
        inner = F.lit(0)
        for value, points in cuts.ties:
            if points:
                at = sum((_reaches(df, order, p).cast("int") for p in points), F.lit(0))
                inner = F.when(_axis(df, order[0]) == value, at).otherwise(inner)
        out = out.withColumn(CHUNK, F.col(CHUNK) * width + inner)
    return out, (len(cuts.points) + 1) * width


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    specs: dict[str, Spec],
    chunks: int | Cuts | None = None,
) -> DataFrame:
    """Add ordered columns to `df`; `order` must order the rows of a key totally."""
    temporary = {f"__in_{i}": s.expr for i, s in enumerate(specs.values()) if s.expr is not None}
    work = df.withColumns({k: v for k, v in temporary.items()})
    work, n = with_chunks(work, order, plan_cuts(df, order, chunks, keyless=keys in ([], [ALL])))
    inside = W.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    onward = inside.rowsBetween(0, W.unboundedFollowing)

    local, summary, carry = {}, [], {}
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(1, W.unboundedFollowing)
    step = W.partitionBy(*keys).orderBy(CHUNK)
    rank = F.struct(*order)  # a struct is not null where its first value is
    for i, (name, spec) in enumerate(specs.items()):
        x, s, c = f"__in_{i}", f"__sum_{i}", f"__carry_{i}"
        value = F.col(x)
        if spec.kind == "previous":
            local[name] = F.lag(F.struct(value.alias("v"))).over(inside)
            summary.append(F.max_by(F.struct(value.alias("v")), rank).alias(s))
            carry[c] = F.lag(s).over(step)
        elif spec.kind == "following":
            local[name] = F.lead(F.struct(value.alias("v"))).over(inside)
            summary.append(F.min_by(F.struct(value.alias("v")), rank).alias(s))
            carry[c] = F.lead(s).over(step)
        elif spec.kind in ("running_sum", "position"):
            local[name] = F.sum(x).over(upto)
            summary.append(F.sum(x).alias(s))
            carry[c] = F.sum(s).over(before)
        elif spec.kind == "running_max":
            local[name] = F.max(x).over(upto)
            summary.append(F.max(x).alias(s))
            carry[c] = F.max(s).over(before)
        elif spec.kind == "last_valid":
            local[name] = F.last(x, ignorenulls=True).over(upto)
            summary.append(F.max_by(value, F.when(value.isNotNull(), rank)).alias(s))
            carry[c] = F.last(s, ignorenulls=True).over(before)
        elif spec.kind == "next_valid":
            local[name] = F.first(x, ignorenulls=True).over(onward)
            summary.append(F.min_by(value, F.when(value.isNotNull(), rank)).alias(s))
            carry[c] = F.first(s, ignorenulls=True).over(after)
        else:
            raise ValueError(f"unknown scan {spec.kind!r}")

    out = work.withColumns(local)
    if n > 1:
        carried = work.groupBy(*keys, CHUNK).agg(*summary).withColumns(carry)
        carried = carried.select(*keys, CHUNK, *carry)
        out = out.join(carried, [*keys, CHUNK], "left")

    final = []
    for i, (name, spec) in enumerate(specs.items()):
        value = F.col(name)
        if n > 1:
            c = F.col(f"__carry_{i}")
            if spec.kind in ("running_sum", "position"):
                value = F.when(value.isNull(), c).otherwise(value + F.coalesce(c, F.lit(0)))
            elif spec.kind == "running_max":
                value = F.greatest(value, c)
            else:
                value = F.coalesce(value, c)
        if spec.kind in ("previous", "following"):
            value = value["v"]
        elif spec.kind == "position":
            value = (value - 1).cast("bigint")
        final.append(value.alias(name))
    kept = [F.col(c) for c in df.columns if c not in specs]
    return out.select(*kept, *final)


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str,
                chunks: int | Cuts | None = None) -> DataFrame:
    """Number the rows of each key from 0 along `order`."""
    return scan(df, keys, order, {name: position()}, chunks)


def with_halo(df: DataFrame, index: str, block: int, halo: int) -> DataFrame:
    """Copy each row of an integer grid into every block whose halo reaches it.

    Adds ``__block`` and ``__core``; a window over ``(key, __block)`` then sees
    at most ``block + 2*halo`` grid steps, and rows with ``__core`` false are the
    copies to drop afterwards.
    """
    i = F.col(index)
    first = F.floor((i - halo) / block).cast("bigint")
    last = F.floor((i + halo) / block).cast("bigint")
    out = df.withColumn("__block", F.explode(F.sequence(first, last)))
    return out.withColumn("__core", F.col("__block") == F.floor(i / block))


def centred(df: DataFrame, keys: list[str], index: str, halo: int,
            columns: dict, block: int | None = None, reach: tuple[int, int] | None = None) -> DataFrame:
    """Evaluate windowed columns over ``index-halo .. index+halo`` of a sparse grid.

    `columns` maps a new name to a function of a window spec; `reach` narrows the
    window to one that is not symmetric.
    """
    low, high = reach or (-halo, halo)
    block = block or max(4096, 8 * halo)
    work = with_halo(df, index, block, halo)
    spec = W.partitionBy(*keys, "__block").orderBy(F.col(index).cast("bigint")).rangeBetween(low, high)
    work = work.withColumns({name: make(spec) for name, make in columns.items()})
    return work.where("__core").drop("__block", "__core")
