"""Scored recordings whose movement veto is taken back and applied anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.states import apply_movement_veto, veto_summary
from ..operators.thresholds import movement_thresholds
from ..scale import cut_lineage
from ..sources.versions import load_version, save_version

KEYS = ["session"]


def attach_movement(bins: DataFrame, speed: DataFrame, index: str = "bin") -> DataFrame:
    """`bins` with the `speed` of ``session, index, speed`` in place of any they had; null where there is none."""
    return bins.drop("speed").join(speed.select(F.col("session").cast("string").alias("session"), index, "speed"), [*KEYS, index], "left")


def rescore_movement(spark: SparkSession, path: str, speed: DataFrame, step: float, min_duration: float = 6.0, veto: tuple[str, ...] = ("NREM", "REM"),
                     threshold_log10: float | None = None, index: str = "bin", write: bool = True) -> tuple[DataFrame, DataFrame]:
    """New bins and what the veto did, for the sessions of `speed`; written as their next version.

    The codes start again from ``code_before``, what the signals alone decided,
    so a second veto does not build on the first. Each session has its own
    threshold unless one is given; one without enough movement keeps its codes.
    Sessions that were scored without ``code_before`` are refused.
    """
    names = [r[0] for r in speed.select(F.col("session").cast("string")).distinct().collect()]
    bins = load_version(spark, path, names).drop("version")
    found = {r[0] for r in bins.select("session").distinct().collect()}
    if missing := sorted(set(names) - found):
        raise ValueError(f"{path} has no sessions {missing}")
    if "code_before" not in bins.columns or not bins.where("code_before IS NULL").isEmpty():
        raise ValueError(f"{path}: sessions scored without code_before cannot be undone; score them again")
    moved = cut_lineage(attach_movement(bins, speed, index).drop("code", "moving").withColumnRenamed("code_before", "code"))
    if threshold_log10 is None:
        cuts = movement_thresholds(moved, KEYS, "speed").select(*KEYS, F.col("threshold").alias("threshold_log10"))
        moved = moved.join(cuts, KEYS, "left")
    else:
        moved = moved.withColumn("threshold_log10", F.lit(float(threshold_log10)))
    out = apply_movement_veto(moved, KEYS, index, "code", "speed", F.col("threshold_log10"), step, min_duration, veto)
    # without a threshold there is no veto at all, and nothing to smooth either
    out = out.withColumn("code_after", F.when(F.col("threshold_log10").isNull(), F.col("code_before")).otherwise(F.col("code_after")))
    out = cut_lineage(out)
    summary = veto_summary(out, KEYS, "speed").join(out.groupBy(*KEYS).agg(F.first("threshold_log10").alias("threshold_log10")), KEYS)
    summary = summary.withColumn("applied", F.col("threshold_log10").isNotNull())
    rows = out.drop("code", "threshold_log10").withColumnRenamed("code_after", "code")
    if write:
        save_version(rows, path)
    return rows, summary


def undo_rescore(spark: SparkSession, path: str, sessions: list[str], version: int = 1) -> None:
    """Make an earlier version of some sessions the latest again; what came between stays readable."""
    save_version(load_version(spark, path, sessions, version).drop("version"), path)
