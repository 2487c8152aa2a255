"""Tables of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minimal_cover(paths: DataFrame, path: str) -> DataFrame:
    """Distinct paths with no other path of the table above them.

    Every path names its own ancestors and is dropped if one of them is in the
    table: an equi-join, where comparing prefixes would need all pairs.
    """
    known = paths.select(F.rtrim(F.col(path), F.lit("/")).alias(path)).distinct()
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    listed = known.select(F.col(path), F.explode(F.when(F.size(parts) > 1, above).otherwise(F.array())).alias("__above"))
    covered = listed.join(known.select(F.col(path).alias("__above")), "__above", "left_semi").select(path)
    return known.join(covered.distinct(), path, "left_anti")
