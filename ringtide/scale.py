"""Size checks that decide between a one-task plan and a split plan.

Every operator that orders rows inside a key asks here how many pieces the key
must be cut into. The answer comes from Catalyst's own size estimate, so no job
runs to find it out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES_CONF = "spark.ringtide.scan.chunkBytes"
DEFAULT_CHUNK_BYTES = 128 << 20
#: A scan without keys sorts whole chunks in one task each, and rows take tens of times their bytes in compressed files.
KEYLESS_SHARE = 32
#: Estimates from here on stand for a size that is not known.
UNKNOWN = 1 << 60


def _leaf_bytes(leaf) -> int:
    """Size of one source of a plan; a checkpoint or local list has no statistics and is counted."""
    if leaf.getClass().getSimpleName() == "LogicalRDD":
        return int(leaf.rdd().count()) * int(leaf.schema().defaultSize())
    return int(str(leaf.stats().sizeInBytes()))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the rows' size, held to four times what the plan reads.

    Without column statistics a join is estimated as the product of its sides.
    No job is run, except to count the rows of checkpoints and of plans whose
    size is unknown.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(_leaf_bytes(leaves.apply(i)) for i in range(leaves.size()))
    found = min(int(str(plan.stats().sizeInBytes())), 4 * read)
    if found >= UNKNOWN:  # a cached plan that nobody has computed yet says so
        found = df.count() * int(df._jdf.schema().defaultSize())
    return found


def chunk_count(df: DataFrame, chunks: int | None = None, keyless: bool = False) -> int:
    """How many ordered pieces to cut `df` into so that one task holds a bounded part; smaller ones if no key deals the rows out."""
    if chunks is not None:
        return max(1, int(chunks))
    conf = df.sparkSession.conf
    target = int(conf.get(CHUNK_BYTES_CONF, str(DEFAULT_CHUNK_BYTES)))
    if keyless:
        target = max(1, target // KEYLESS_SHARE)
    return max(1, math.ceil(estimated_bytes(df) / target))


def cut_lineage(df: DataFrame, fallback_dir: str | None = None) -> DataFrame:
    """Checkpoint into the folder the cluster names in ``spark.checkpoint.dir``.

    A session without that setting (a test) gets `fallback_dir`, or a new
    temporary folder when it runs on the local master.
    """
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or fallback_dir
        if shared is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            import tempfile

            shared = tempfile.mkdtemp(prefix="ringtide-checkpoint-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """`df` computed once, as a Parquet table in the shared folder, read again."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the checkpoint folder, which every executor reaches."""
    import uuid

    sc = spark.sparkContext._jsc.sc()
    if sc.getCheckpointDir().isEmpty():
        cut_lineage(spark.range(1))  # sets the folder that the session names, or a test's own
    return f"{sc.getCheckpointDir().get()}/{purpose}-{uuid.uuid4().hex}"
