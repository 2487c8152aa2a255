"""Statistics of angles as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import (circular_difference, heading_bin, length, mean_angle, resultant_length,
                                vector_angle)
from .quantiles import _ALL, finite, quantiles


def _grouped(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def circular_mean(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """Direction and length of the mean resultant per key."""
    return df.groupBy(*keys).agg(
        mean_angle(angle).alias("mean_deg"), resultant_length(angle).alias("resultant"),
        F.count(angle).cast("bigint").alias("n"))


def _trig_sums(a: Column, b: Column) -> dict[str, Column]:
    """Sums from which the correlation about the mean directions follows without a second pass."""
    x, y = F.radians(a), F.radians(b)
    sa, ca, sb, cb = F.sin(x), F.cos(x), F.sin(y), F.cos(y)
    return {
        "__sa": F.sum(sa), "__ca": F.sum(ca), "__sb": F.sum(sb), "__cb": F.sum(cb),
        "__sasb": F.sum(sa * sb), "__sacb": F.sum(sa * cb), "__casb": F.sum(ca * sb), "__cacb": F.sum(ca * cb),
        "__sasa": F.sum(sa * sa), "__saca": F.sum(sa * ca), "__caca": F.sum(ca * ca),
        "__sbsb": F.sum(sb * sb), "__sbcb": F.sum(sb * cb), "__cbcb": F.sum(cb * cb)}


def _correlation_of(sums_a: str = "__ma", sums_b: str = "__mb") -> Column:
    """Correlation of sin(a - mean a) and sin(b - mean b) from the sums and the mean directions."""
    ka, la = F.cos(F.col(sums_a)), F.sin(F.col(sums_a))
    kb, lb = F.cos(F.col(sums_b)), F.sin(F.col(sums_b))
    ab = F.col("__sasb") * ka * kb - F.col("__sacb") * ka * lb - F.col("__casb") * la * kb + F.col("__cacb") * la * lb
    aa = F.col("__sasa") * ka * ka - 2 * F.col("__saca") * ka * la + F.col("__caca") * la * la
    bb = F.col("__sbsb") * kb * kb - 2 * F.col("__sbcb") * kb * lb + F.col("__cbcb") * lb * lb
    scale = F.sqrt(aa * bb)
    return F.when(scale > 0, ab / scale)


def _with_means(sums: DataFrame) -> DataFrame:
    return sums.withColumns({"__ma": F.atan2("__sa", "__ca"), "__mb": F.atan2("__sb", "__cb")})


def circular_correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Correlation of the sines about each variable's mean direction, in one aggregate."""
    sums = df.where(finite(a) & finite(b)).groupBy(*keys).agg(
        *[c.alias(n) for n, c in _trig_sums(F.col(a), F.col(b)).items()], F.count("*").cast("bigint").alias("n"))
    return _with_means(sums).select(*keys, "n", _correlation_of().alias("r"))


def circular_r(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rotation-free circular correlation from eight trigonometric sums; null below three pairs."""
    x, y = F.radians(F.col(a)), F.radians(F.col(b))
    sums = df.where(finite(a) & finite(b)).groupBy(*keys).agg(
        F.count("*").cast("bigint").alias("n"),
        F.sum(F.cos(x) * F.cos(y)).alias("cc"), F.sum(F.sin(x) * F.sin(y)).alias("ss"),
        F.sum(F.cos(x) * F.sin(y)).alias("cs"), F.sum(F.sin(x) * F.cos(y)).alias("sc"),
        F.sum(F.cos(2 * x)).alias("c2a"), F.sum(F.sin(2 * x)).alias("s2a"),
        F.sum(F.cos(2 * y)).alias("c2b"), F.sum(F.sin(2 * y)).alias("s2b"))
    n2 = F.col("n") * F.col("n")
    spread = F.sqrt(
        (n2 - (F.col("c2a") * F.col("c2a") + F.col("s2a") * F.col("s2a")))
        * (n2 - (F.col("c2b") * F.col("c2b") + F.col("s2b") * F.col("s2b"))))
    cross = 4.0 * (F.col("cc") * F.col("ss") - F.col("cs") * F.col("sc"))
    return sums.select(*keys, "n", F.when((F.col("n") >= 3) & (spread > 0), cross / spread).alias("r"))


def decoding_metrics(decoded: DataFrame, keys: list[str], decoded_deg: str, actual_deg: str,
                     tolerance: float = 30.0) -> DataFrame:
    """Size, tail, correlation and constant offset of the decoding error, per key.

    One aggregate gives everything but the quantiles and what needs the offset;
    a second pass ranks raw and corrected errors together.
    """
    work, group = _grouped(decoded, keys)
    work = work.withColumn("__e", circular_difference(F.col(decoded_deg), F.col(actual_deg)))
    work = work.where(finite("__e"))
    size = F.abs("__e")
    base = work.groupBy(*group).agg(
        F.avg(size).alias("mean_abs_error_deg"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse_deg"),
        F.avg((size <= tolerance).cast("double")).alias("frac_within_deg"), mean_angle("__e").alias("__o"),
        F.count("*").cast("bigint").alias("n_bins"),
        *[c.alias(n) for n, c in _trig_sums(F.col(decoded_deg), F.col(actual_deg)).items()])
    base = _with_means(base).withColumns({
        "offset_deg": circular_difference(F.col("__o"), F.lit(0.0)), "circular_correlation": _correlation_of()})
    base = base.select(*group, "mean_abs_error_deg", "rmse_deg", "frac_within_deg", "n_bins", "offset_deg", "circular_correlation")
    both = work.select(*group, "__e").join(base.select(*group, "offset_deg"), group)
    corrected = F.abs(circular_difference(F.col("__e"), F.col("offset_deg")))
    kinds = F.explode(F.array(F.struct(F.lit("raw").alias("k"), size.alias("v")), F.struct(F.lit("corrected").alias("k"), corrected.alias("v"))))
    stacked = both.select(*group, kinds.alias("__x")).select(*group, F.col("__x.k").alias("__kind"), F.col("__x.v").alias("__v"))
    ranked = quantiles(stacked, [*group, "__kind"], "__v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    raw = F.col("__kind") == "raw"
    wide = ranked.groupBy(*group).agg(
        F.max(F.when(raw, F.col("q50"))).alias("median_abs_error_deg"),
        F.max(F.when(raw, F.col("q25"))).alias("q25_abs_error_deg"), F.max(F.when(raw, F.col("q75"))).alias("q75_abs_error_deg"),
        F.max(F.when(~raw, F.col("q50"))).alias("median_abs_error_corrected_deg"))
    within = both.groupBy(*group).agg(F.avg((corrected <= tolerance).cast("double")).alias("frac_within_corrected_deg"))
    out = base.join(wide, group).join(within, group)
    return out.select(
        *keys, "median_abs_error_deg", "mean_abs_error_deg", "rmse_deg", "frac_within_deg",
        F.lit(float(tolerance)).alias("tolerance_deg"), "circular_correlation", "offset_deg",
        "median_abs_error_corrected_deg", "frac_within_corrected_deg", "q25_abs_error_deg",
        "q75_abs_error_deg", "n_bins")


def align_angles(df: DataFrame, keys: list[str], angle: str, reference: str) -> DataFrame:
    """Best flip and rotation taking `angle` onto `reference`, by resultant length.

    ``offset_deg`` belongs to the winning orientation; ``margin`` is the winner's
    lead over the other. Without a flip wins a tie.
    """
    a, r = F.col(angle), F.col(reference)
    sums = df.where(finite(angle) & finite(reference)).groupBy(*keys).agg(
        F.count("*").cast("bigint").alias("n"),
        *[F.avg(f(F.radians(r - s * a))).alias(f"{n}{i}")
          for i, s in (("p", 1.0), ("m", -1.0)) for n, f in (("c", F.cos), ("s", F.sin))])
    straight, mirrored = length("cp", "sp"), length("cm", "sm")
    flip = mirrored > straight
    return sums.select(
        *keys, "n", flip.alias("flip"),
        F.when(flip, vector_angle("cm", "sm")).otherwise(vector_angle("cp", "sp")).alias("offset_deg"),
        F.greatest(straight, mirrored).alias("resultant"),
        F.least(straight, mirrored).alias("resultant_other"),
        F.abs(straight - mirrored).alias("margin"))


def error_histogram(decoded: DataFrame, keys: list[str], error: str, width: float = 5.0) -> DataFrame:
    """Errors counted in equal bins of [-180, 180], the last closed."""
    n = int(360 / width)
    index = F.least(F.floor((F.col(error) + 180.0) / width), F.lit(n - 1)).cast("bigint")
    return decoded.where(finite(error)).groupBy(*keys, index.alias("error_bin")).agg(
        F.count("*").cast("bigint").alias("n"))


def confusion(decoded: DataFrame, keys: list[str], decoded_deg: str, actual_deg: str,
              n_bins: int = 72) -> DataFrame:
    """Share of each decoded bin given the actual bin."""
    from pyspark.sql.window import Window as W

    cells = decoded.groupBy(
        *keys, heading_bin(F.col(actual_deg), n_bins).alias("actual_bin"),
        heading_bin(F.col(decoded_deg), n_bins).alias("decoded_bin")).agg(F.count("*").cast("bigint").alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys, "actual_bin"))
    return cells.withColumn("p", F.col("n") / total)
