"""Interleaving sources to target weights by Pfair scheduling (operator 5).

All sources flow at the same time, each in proportion to its weight, and one that
has nothing left leaves its share to the others. A source's k-th block has its
release at the slot in which the flow begins with it, and its deadline at the end
of the slot in which the flow is through with it. Earliest deadline first among
released blocks meets all deadlines, so a source is never a whole block ahead of
its flow or behind it. Weights are exact fractions; every source has its own.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running, shared_folder

#: Rows of a block.
BLOCK_ROWS = 32
#: Blocks of the plan that the driver holds before it writes them.
PIECE = 1 << 18


def numerators(weights: dict[str, float]) -> dict[str, int]:
    """The exact weights as whole numbers over one denominator; null or non-positive weights count as the least."""
    sound = {s: Fraction(w) for s, w in weights.items() if w and w > 0 and math.isfinite(w)}
    least = min(sound.values(), default=Fraction(1))
    scale = math.lcm(*(w.denominator for w in sound.values()))
    return {s: int(sound.get(s, least) * scale) for s in weights}


class Flow:
    """The flow of all sources: how many slots have passed when a source's flow has come to block k."""

    def __init__(self, blocks: dict[str, int], weights: dict[str, int]):
        self.weights = weights
        leaving = sorted((Fraction(n, weights[s]), s) for s, n in blocks.items())
        self.ends, self.gone, self.left = [e for e, _ in leaving], [0], [sum(weights.values())]
        for _, s in leaving:
            self.gone.append(self.gone[-1] + blocks[s])
            self.left.append(self.left[-1] - weights[s])

    def at(self, source: str, k: int, phase: int) -> tuple[int, int, int]:
        """Slots passed, rounded down and up, and the number of sources that have left, no fewer than `phase`."""
        w = self.weights[source]
        if phase < len(self.ends) and k * self.ends[phase].denominator > self.ends[phase].numerator * w:
            phase = bisect.bisect_left(self.ends, Fraction(k, w), phase)
        whole = self.left[phase] * k
        return self.gone[phase] + whole // w, self.gone[phase] - -whole // w, phase


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[int, str, int, int]]:
    """(slot, source, block, sources that had left at its release) for all blocks, slot by slot.

    Holds one block of every source. Ties go to the name that comes first.
    """
    blocks = {s: n for s, n in blocks.items() if n}
    flow = Flow(blocks, numerators({s: weights[s] for s in blocks}))
    waiting = [(0, s, 0, 0) for s in sorted(blocks)]
    ready: list = []
    for slot in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= slot:
            _, s, k, phase = heapq.heappop(waiting)
            release, deadline, later = flow.at(s, k + 1, phase)
            heapq.heappush(ready, (deadline, s, k, phase, release, later))
        deadline, s, k, phase, release, later = heapq.heappop(ready)
        assert deadline > slot
        yield slot, s, k, phase
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (release, s, k + 1, later))


PLAN = "__source string, __block long, __slot long, __phase int"


def write_plan(spark: SparkSession, found: Iterator[tuple[int, str, int, int]]) -> DataFrame:
    """The schedule as a table, piece by piece."""
    path, any_piece = shared_folder(spark, "plan"), False
    while piece := list(islice(found, PIECE)):
        slot, source, block, phase = zip(*piece, strict=True)
        table = pa.table({"__source": pa.array(source, pa.string()), "__block": pa.array(block, pa.int64()), "__slot": pa.array(slot, pa.int64()), "__phase": pa.array(phase, pa.int32())})
        spark.createDataFrame(table).write.mode("append").parquet(path)
        any_piece = True
    return spark.read.schema(PLAN).parquet(path) if any_piece else spark.createDataFrame([], PLAN)


def square_roots(rows: dict[str, int]) -> dict[str, float]:
    """Weights that lift small sources: the square root of the rows."""
    return {s: math.sqrt(n) for s, n in rows.items()}


def mixed(docs: DataFrame, weights=square_roots, source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`docs` with `__key` (its source), `__block`, `__phase` (sources that had left), `__slot` and `__at`, its place in the mixed order.

    `weights` turns rows by source into weights by source; sources are named
    by "s" and the value, a null source by "null". Every row is placed once;
    none is dropped when a source runs out. A source's rows keep the order in
    which they are read. Empty tables stay empty. The plan has a row per block
    and is joined by source and block, so that a hot source is spread; the
    driver holds the sources' names and counts and a piece of the plan at a time.
    """
    spark = docs.sparkSession
    source = F.col(f"`{source_col}`").cast("string")
    named = F.when(source.isNull(), "null").otherwise(F.concat(F.lit("s"), source))
    numbered = running(docs.withColumn("__source", named).withColumn("__one", F.lit(1).cast("long")), "__source", "__one", "mixing", compression="zstd")
    rows = {r["__source"]: r["n"] for r in numbered.groupBy("__source").agg(F.sum("__one").alias("n")).collect()}
    plan = write_plan(spark, schedule({s: math.ceil(n / block_rows) for s, n in rows.items()}, weights(rows) if rows else {}))
    placed = numbered.withColumn("__block", F.floor(F.col("__before") / block_rows)).join(plan, ["__source", "__block"])
    at = F.col("__slot") * block_rows + F.col("__before") % block_rows
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__source").alias("__key"), "__block", "__phase", "__slot", at.alias("__at"))


def mix(docs: DataFrame, weights=square_roots, source_col: str = "source", block_rows: int = BLOCK_ROWS, position: str | None = None) -> DataFrame:
    """All rows of `docs` in the mixed order: partitions and rows within them follow it.

    With `position` the rows stay where they are and the column of that name
    keeps their place. Columns of `docs` that begin with two underscores, or
    have the name of `position`, are refused.
    """
    if any(c.startswith("__") or c == position for c in docs.columns):
        raise ValueError(f"columns of docs may not begin with two underscores or be named {position}")
    placed = mixed(docs, weights, source_col, block_rows).select("__at", *[F.col(f"`{c}`") for c in docs.columns])
    if position:
        return placed.withColumnRenamed("__at", position)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, "__at").sortWithinPartitions("__at").drop("__at")
