"""Motion-capture exports: eight header rows, then one row per frame."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_ROWS = 8
# The header rows that say what a column is.
TYPE_ROW, NAME_ROW, KIND_ROW, AXIS_ROW = 2, 3, 6, 7
AXES = {("Rotation", "X"): "qx", ("Rotation", "Y"): "qy", ("Rotation", "Z"): "qz", ("Rotation", "W"): "qw",
        ("Position", "X"): "px", ("Position", "Y"): "py", ("Position", "Z"): "pz"}
BODY = "Rigid Body"


def read_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The header rows as lists of cells."""
    lines = [r[0] for r in spark.read.text(path).limit(HEADER_ROWS).collect()]
    if len(lines) < HEADER_ROWS:
        raise ValueError(f"{path}: {len(lines)} rows, too few for the header")
    rows = list(csv.reader(lines))
    width = max(len(r) for r in rows)
    return [r + [""] * (width - len(r)) for r in rows]


def body_columns(header: list[list[str]]) -> dict[str, dict[str, int]]:
    """Column of each axis of each rigid body; marker columns are left out."""
    out: dict[str, dict[str, int]] = {}
    for i, kind in enumerate(header[TYPE_ROW]):
        axis = AXES.get((header[KIND_ROW][i].strip(), header[AXIS_ROW][i].strip()))
        if kind.strip() == BODY and axis:
            out.setdefault(header[NAME_ROW][i].strip(), {})[axis] = i
    return out


def rigid_body_names(spark: SparkSession, path: str) -> list[str]:
    """Rigid bodies in the order of their columns."""
    return list(body_columns(read_header(spark, path)))


def _body(spark: SparkSession, path: str, width: int) -> DataFrame:
    schema = ", ".join(f"_c{i} string" for i in range(width))
    raw = spark.read.csv(path, header=False, schema=schema)
    return raw.where(F.col("_c0").rlike("^[0-9]+$") & F.expr("try_cast(_c1 AS DOUBLE) IS NOT NULL"))


def load_tracking(spark: SparkSession, path: str) -> DataFrame:
    """``frames(body, frame, t, qx..qw, px..pz)``; an axis a body lacks is null."""
    header = read_header(spark, path)
    bodies = body_columns(header)
    if not bodies:
        raise ValueError(f"{path}: no rigid bodies")
    raw = _body(spark, path, len(header[0]))

    def number(i: int | None):
        return F.expr(f"try_cast(_c{i} AS DOUBLE)") if i is not None else F.lit(None).cast("double")

    entries = [F.struct(F.lit(name).alias("body"), *[number(axes.get(a)).alias(a) for a in AXES.values()])
               for name, axes in bodies.items()]
    rows = raw.select(F.col("_c0").cast("bigint").alias("frame"), F.col("_c1").cast("double").alias("t"),
                      F.explode(F.array(*entries)).alias("e"))
    return rows.select("e.body", "frame", "t", *[f"e.{a}" for a in AXES.values()])


def read_body_track(spark: SparkSession, path: str, body: str | None = None) -> DataFrame:
    """Positions of one body, reading only its three columns."""
    header = read_header(spark, path)
    bodies = body_columns(header)
    if body is None:
        if len(bodies) != 1:
            raise ValueError(f"{path} has bodies {sorted(bodies)}: name one")
        body = next(iter(bodies))
    if body not in bodies:
        raise ValueError(f"{path} has no body {body!r}, only {sorted(bodies)}")
    missing = [a for a in ("px", "py", "pz") if a not in bodies[body]]
    if missing:
        raise ValueError(f"{path}: body {body!r} lacks {missing}")
    raw = _body(spark, path, len(header[0]))
    axes = [F.expr(f"try_cast(_c{bodies[body][a]} AS DOUBLE)").alias(a) for a in ("px", "py", "pz")]
    return raw.select(F.col("_c0").cast("bigint").alias("frame"), F.col("_c1").cast("double").alias("t"), *axes)
