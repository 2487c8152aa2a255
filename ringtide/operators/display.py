"""Tidy tables behind the figures: broken lines, seams, rasters, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import asof_join
from .scan import previous, scan


def break_at(line: DataFrame, keys: list[str], x: str, y: str, broken: Column, threshold: float = 180.0) -> DataFrame:
    """The line with an empty point wherever it is cut: at a break, or where y jumps over the seam.

    `broken` says of a row whether the line is cut before it. Adds ``part``: 0
    for the empty point, 1 for the row itself.
    """
    work = scan(line, keys, [x], {"__before": previous(y)})
    cut = F.col("__before").isNotNull() & (F.coalesce(broken, F.lit(False)) | (F.abs(F.col(y) - F.col("__before")) > threshold))
    parts = F.when(cut, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    out = work.withColumn("part", F.explode(parts))
    return out.withColumn(y, F.when(F.col("part") == 1, F.col(y))).drop("__before")


def wrap_through(line: DataFrame, keys: list[str], x: str, y: str, broken: Column, top: float = 360.0) -> DataFrame:
    """The line with points on both sides of the seam where it crosses it.

    A crossing adds the point where the line leaves (``part`` 0), a gap
    (``part`` 1) and the point where it enters again (``part`` 2); ``part`` 3 is
    the row itself.
    """
    work = scan(line, keys, [x], {"__p": previous(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))})
    step = F.col(y) - F.col("__p.y")
    crosses = F.coalesce((F.abs(step) > top / 2) & ~F.coalesce(broken, F.lit(False)), F.lit(False))
    up = step < 0  # fell by more than half a turn: it went up through the top
    leave = F.when(up, F.lit(float(top))).otherwise(0.0)
    target = F.when(up, F.col(y) + top).otherwise(F.col(y) - top)
    share = (leave - F.col("__p.y")) / (target - F.col("__p.y"))
    at = F.col("__p.x") + (F.col(x) - F.col("__p.x")) * share
    parts = F.when(crosses, F.array(*[F.lit(i) for i in range(4)])).otherwise(F.array(F.lit(3)))
    out = work.withColumns({"__at": at, "__leave": leave}).withColumn("part", F.explode(parts))
    px = F.when(F.col("part") == 3, F.col(x)).otherwise(F.col("__at"))
    py = (F.when(F.col("part") == 3, F.col(y)).when(F.col("part") == 0, F.col("__leave"))
          .when(F.col("part") == 2, F.lit(float(top)) - F.col("__leave")))
    return out.withColumns({x: px, y: py}).drop("__p", "__at", "__leave")


def on_decoded_axis(spikes: DataFrame, bins: DataFrame, by: list[str], time: str) -> DataFrame:
    """Position of each spike on an axis that splices decoded bins together; others are dropped.

    `bins` has ``start, stop, axis`` (where the bin begins on the axis).
    """
    b = bins.select(*by, F.col("start").alias("__start"), F.col("stop").alias("__stop"), F.col("axis").alias("__axis"))
    hit = asof_join(spikes, b, by, time, "__start", ["__start", "__stop", "__axis"])
    hit = hit.where(F.col(time) < F.col("__stop"))
    return hit.withColumn("axis", F.col("__axis") + F.col(time) - F.col("__start")).drop("__start", "__stop", "__axis")


def unit_raster(spikes: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """Spikes of the listed units with their rows; ids meet as text, as files store them."""
    left = spikes.withColumn("__id", F.col(unit).cast("string"))
    right = units.withColumn("__id", F.col("unit_id").cast("string")).drop("unit_id")
    return left.join(right, "__id").drop("__id")


def closed_curves(curves: DataFrame, keys: list[str], n_bins: int, value: str) -> DataFrame:
    """Curves with equal points added at 0 and 360, halfway between the last and the first bin."""
    ends = curves.where(F.col("angle_bin").isin(0, n_bins - 1))
    seam = ends.groupBy(*keys).agg(F.avg(value).alias(value))
    width = 360.0 / n_bins
    inner = curves.select(*keys, ((F.col("angle_bin") + 0.5) * width).alias("deg"), value)
    both = seam.withColumn("deg", F.explode(F.array(F.lit(0.0), F.lit(360.0)))).select(*keys, "deg", value)
    return inner.unionByName(both)


def gaussian_cut(x, amplitude: float, centre: float, sigma: float, cut: float) -> Column:
    """Gaussian that is zero below a cut."""
    c = F.col(x) if isinstance(x, str) else x
    z = (c - centre) / sigma
    return F.when(c < cut, 0.0).otherwise(amplitude * F.exp(-0.5 * z * z))


def histogram(df: DataFrame, keys: list[str], value: str, n_bins: int) -> DataFrame:
    """Counts in equal bins from each key's smallest to largest value, the last bin closed."""
    span = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    work = df.join(span, keys)
    width = (F.col("__hi") - F.col("__lo")) / n_bins
    index = F.least(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(n_bins - 1)).cast("bigint")
    return work.where("__hi > __lo").groupBy(*keys, index.alias("bin")).agg(
        F.count("*").cast("bigint").alias("n"), F.first(F.col("__lo")).alias("low"), F.first(width).alias("width"))


def null_interval(null: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Percentile interval of a null; a key has one value per shuffle."""
    return null.groupBy(*keys).agg(
        F.percentile(value, low).alias("low"), F.percentile(value, high).alias("high"), F.avg(value).alias("mean"))
