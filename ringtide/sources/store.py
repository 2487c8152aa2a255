"""Tables in and out: tuning stores, scorings, splits, matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(value) -> Column:
    """Null in place of a number JSON cannot hold."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def prepare_output(spark, path: str, overwrite: bool = False) -> None:
    """Refuse a folder that already holds something, unless it may be overwritten."""
    jvm = spark._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and len(fs.listStatus(target)) and not overwrite:
        raise ValueError(f"{path} is not empty; pass overwrite=True to replace what it holds")


def save_samples(samples: DataFrame, path: str, overwrite: bool = False) -> None:
    """Concatenated traces, one folder per session, in frame order inside each file."""
    frames = samples.sortWithinPartitions("session", "frame")
    frames.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("session").parquet(path)


def load_samples(spark, path: str, slots: dict[str, int] | None = None) -> DataFrame:
    """Stored traces, or the named channels of them only."""
    samples = spark.read.parquet(path)
    if slots is None:
        return samples
    return samples.select("session", "frame", *[F.col("v")[i].alias(n) for n, i in slots.items()])


def save_hd_tuning(path: str, stats: DataFrame, curves: DataFrame, depths: DataFrame, overwrite: bool = False) -> None:
    """Units that have a curve, a statistic and a depth, with a JSON twin of the statistics."""
    mode = "overwrite" if overwrite else "errorifexists"
    whole = stats.join(curves.select("unit_id").distinct(), "unit_id", "left_semi").join(depths, "unit_id")
    whole.write.mode(mode).parquet(f"{path}/stats")
    curves.join(whole.select("unit_id"), "unit_id", "left_semi").write.mode(mode).parquet(f"{path}/curves")
    doubles = {f.name for f in whole.schema if f.dataType.simpleString() in ("double", "float")}
    readable = whole.select(*[plain(c).alias(c) if c in doubles else F.col(c) for c in whole.columns])
    readable.write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/stats_json")


# Columns a tuning store written earlier may lack.
LATER_COLUMNS = {"weakly_tuned": "boolean", "mvl_cutoff": "double", "too_quiet": "boolean"}


def load_hd_tuning(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Statistics and curves; newer columns an old store lacks come back null."""
    stats = spark.read.option("mergeSchema", "true").parquet(f"{path}/stats")
    for name, kind in LATER_COLUMNS.items():
        if name not in stats.columns:
            stats = stats.withColumn(name, F.lit(None).cast(kind))
    return stats, spark.read.parquet(f"{path}/curves")


def save_splits(spikes: DataFrame, states: DataFrame, path: str, overwrite: bool = False) -> None:
    """Spikes and state spans of every session, one folder per session."""
    mode = "overwrite" if overwrite else "errorifexists"
    spikes.withColumn("unit_id", F.col("unit_id").cast("string")).write.mode(mode).partitionBy("session").parquet(f"{path}/spikes")
    states.write.mode(mode).partitionBy("session").parquet(f"{path}/states")


def save_scoring(bins: DataFrame, summary: DataFrame, path: str, overwrite: bool = False) -> None:
    """Per-bin signals and codes as parquet, the summary as JSON."""
    mode = "overwrite" if overwrite else "errorifexists"
    bins.write.mode(mode).partitionBy("session").parquet(f"{path}/bins")
    summary.write.mode(mode).json(f"{path}/summary")


def load_scoring(spark, path: str, session: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Bins and summary of one session; several without a name given are refused."""
    summary = spark.read.json(f"{path}/summary")
    names = sorted(str(r[0]) for r in summary.select("session").distinct().collect())
    if session is None:
        if len(names) != 1:
            raise ValueError(f"{path} holds sessions {names}: name one")
        session = names[0]
    if str(session) not in names:
        raise ValueError(f"{path} has no session {session!r}, only {names}")
    one = F.col("session").cast("string") == str(session)
    return spark.read.parquet(f"{path}/bins").where(one), summary.where(one)


def save_matches(candidates: DataFrame, wide: DataFrame, rotations: DataFrame, path: str, overwrite: bool = False) -> None:
    """Candidate, match and wide tables as CSV, rotations as JSON."""
    mode = "overwrite" if overwrite else "errorifexists"
    candidates.write.mode(mode).csv(f"{path}/candidates", header=True)
    candidates.where("chosen").write.mode(mode).csv(f"{path}/matches", header=True)
    wide.write.mode(mode).csv(f"{path}/wide", header=True)
    rotations.write.mode(mode).json(f"{path}/rotations")


def save_pair_scores(prob: DataFrame, path: str, threshold: float = 0.5, overwrite: bool = False) -> None:
    """The sparse score table and the pairs above a threshold."""
    mode = "overwrite" if overwrite else "errorifexists"
    prob.write.mode(mode).parquet(f"{path}/scores")
    prob.where(F.col("p") > threshold).write.mode(mode).parquet(f"{path}/pairs")


def read_label_table(spark, path: str, numeric: list[str]) -> DataFrame:
    """A label table read as text, ids as numbers where all are, listed columns as doubles."""
    table = spark.read.csv(path, header=True, inferSchema=False)
    for c in numeric:
        if c in table.columns:
            table = table.withColumn(c, F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    text = [f.name for f in table.schema if f.dataType.simpleString() == "string" and f.name != "unit_id"]
    table = table.withColumns({c: F.coalesce(c, F.lit("")) for c in text})
    whole = table.where(F.expr("try_cast(unit_id AS BIGINT)").isNull()).isEmpty()
    return table.withColumn("unit_id", F.col("unit_id").cast("bigint")) if whole else table
