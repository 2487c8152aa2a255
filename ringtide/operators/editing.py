"""Manual edits of a scoring: painted spans over automatic codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paint(bins: DataFrame, edits: DataFrame, by: list[str], time: str, auto: str, width) -> DataFrame:
    """Code of each bin after edits ``edit_id, lo, hi, code``; the latest edit wins, null clears.

    Edit spans are closed at both ends. Adds ``code`` and ``painted``.
    """
    bucket = F.floor(F.col(time) / width).cast("bigint")
    spans = edits.withColumn("__bucket", F.explode(F.sequence(
        F.floor(F.col("lo") / width).cast("bigint"), F.floor(F.col("hi") / width).cast("bigint"))))
    spans = spans.withColumnRenamed("code", "__code")
    hits = bins.select(*by, time).withColumn("__bucket", bucket).join(spans, [*by, "__bucket"])
    hits = hits.where((F.col(time) >= F.col("lo")) & (F.col(time) <= F.col("hi")))
    last = hits.groupBy(*by, time).agg(F.max_by("__code", "edit_id").alias("__manual"))
    out = bins.join(last, [*by, time], "left")
    return out.withColumns({"code": F.coalesce("__manual", auto), "painted": F.col("__manual").isNotNull()}).drop("__manual")
