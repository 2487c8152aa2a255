"""Tables whose recordings are rewritten one by one, with every earlier version kept.

A table is a folder of Parquet files by ``session`` and ``version``. Writing adds
folders for the sessions written and touches no others; reading takes the latest
version of each session, or an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import cut_lineage

KEY, VERSION = "session", "version"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _read(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.option("mergeSchema", "true").parquet(path)
    return table.withColumns({KEY: F.col(KEY).cast("string"), VERSION: F.col(VERSION).cast("int")})


def versions(spark: SparkSession, path: str) -> DataFrame:
    """``session, version`` of everything that was written."""
    return _read(spark, path).select(KEY, VERSION).distinct()


def save_version(rows: DataFrame, path: str) -> None:
    """Write `rows` as the next version of each session they hold; other sessions' files stay as they are."""
    spark = rows.sparkSession
    rows = cut_lineage(rows.withColumn(KEY, F.col(KEY).cast("string")))  # may stem from the folder that is written to
    if _exists(spark, path):
        last = cut_lineage(versions(spark, path).groupBy(KEY).agg(F.max(VERSION).alias("__last")))
        rows = rows.join(last, KEY, "left").withColumn(VERSION, F.coalesce("__last", F.lit(0)) + 1).drop("__last")
    else:
        rows = rows.withColumn(VERSION, F.lit(1))
    rows.repartition(KEY, VERSION).write.mode("append").partitionBy(KEY, VERSION).parquet(path)


def load_version(spark: SparkSession, path: str, sessions: list[str] | None = None, version: int | None = None) -> DataFrame:
    """The latest rows of every session (or those of `version`), with the session and version they are of."""
    table = _read(spark, path)
    if sessions is not None:
        table = table.where(F.col(KEY).isin([str(s) for s in sessions]))
    if version is not None:
        return table.where(F.col(VERSION) == version)
    last = table.groupBy(KEY).agg(F.max(VERSION).alias(VERSION))
    return table.join(last, [KEY, VERSION], "left_semi")
