"""Helpers that several operators share: tables in the shared folder, Arrow tasks, running sums."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..scale import cut_lineage

#: White space of the word definitions: U+0020 and U+0009 to U+000D.
SPACES = r"\x20\x09-\x0D"


#: Rows of a batch that a worker turns into Python objects, or passes on, at a time.
SLICE = 256

#: What operators keep in a Python worker between tasks, by operator: functions that forget it.
_HELD: dict[str, Callable[[], None]] = {}


def holds(operator: str, forget: Callable[[], None]) -> None:
    """Announce what `operator` keeps in a worker; what others kept there, which Spark uses again, is forgotten."""
    if others := [name for name in _HELD if name != operator]:
        for other in others:
            _HELD.pop(other)()
        give_back()
    _HELD[operator] = forget


def give_back() -> None:
    """Return freed memory to the system. Objects in cycles, Arrow's pool and the allocator would keep it in a worker that waits."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`task` for mapInArrow; what it has freed goes back to the system when it ends, not with the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of SLICE rows, which bound what a worker holds of it beside Arrow's own buffers."""
    for start in range(0, batch.num_rows, SLICE):
        yield batch.slice(start, SLICE)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once, kept in the folder of ``spark.checkpoint.dir``, which survives lost executors."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the checkpoint folder, for tables that executors write and read."""
    cut = spark.sparkContext._jsc.sc().getCheckpointDir()
    if cut.isEmpty():
        cut_lineage(spark.range(1))  # sets the folder from the session, or a test's own
        cut = spark.sparkContext._jsc.sc().getCheckpointDir()
    return f"{cut.get()}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_task(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict], sliced: bool = False) -> DataFrame:
    """`work` on every Arrow batch of `df`, or on its `slices`; it returns columns by name, in the order of `schema`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch) if sliced else [batch] if batch.num_rows else []:
                out = work(part)
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=list(out))

    return df.mapInArrow(frugal(task), schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def sums_before(totals: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Sum of `value` over the rows before, inside `by`.

    For tables with some rows per partition of a job, never for tables of documents.
    """
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long"))


def running(df: DataFrame, key: str, value: str, purpose: str, **options: str) -> DataFrame:
    """`df` with `__part`, its partition, and `__before`: the sum of `value` (not null) over earlier rows of `key`.

    Rows keep their partitions and order, whatever these are. Each task adds up
    its own rows; a row for each key and task then gives what earlier tasks
    hold. The result is a table in the shared folder, so that partitions are
    numbered once. `key` is a string or whole number with few values or sorted rows.
    """
    place, amount = df.columns.index(key), df.columns.index(value)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("running", lambda: None)
        part, sums = TaskContext.get().partitionId(), {}
        for batch in batches:
            before = []
            for k, v in zip(batch.column(place).to_pylist(), batch.column(amount).to_pylist(), strict=True):
                done = sums.get(k, 0)
                before.append(done)
                sums[k] = done + v
            columns = [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__part", "__here"])

    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__here", T.LongType())])
    local = written(df.mapInArrow(frugal(task), schema), purpose, **options)
    totals = local.groupBy(F.col(key).alias("__k"), F.col("__part").alias("__p")).agg(F.sum(value).alias("__v"))
    base = checkpointed(sums_before(totals, ["__k"], ["__p"], "__v", "__base").select("__k", "__p", "__base"))
    joined = local.join(base, local[key].eqNullSafe(base["__k"]) & (local["__part"] == base["__p"]))
    return joined.withColumn("__before", F.col("__base") + F.col("__here")).drop("__k", "__p", "__base", "__here")


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; others, whatever their names, cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
