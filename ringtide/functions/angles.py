"""Column functions for angles in degrees and for rounding results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def r6(x, digits: int = 6) -> Column:
    """Round to `digits` decimals, never returning a negative zero."""
    return F.round(_c(x), digits) + F.lit(0.0)


def wrap360(x) -> Column:
    """Angle in [0, 360)."""
    x = _c(x)
    return x - 360.0 * F.floor(x / 360.0)


def circular_difference(a, b) -> Column:
    """Signed difference a - b in [-180, 180)."""
    d = _c(a) - _c(b) + 180.0
    return d - 360.0 * F.floor(d / 360.0) - 180.0


def heading_bin(heading, n_bins: int) -> Column:
    """Index of one of `n_bins` equal bins of [0, 360]; the top edge falls in the last bin."""
    h = _c(heading)
    raw = F.floor(h / (360.0 / n_bins))
    index = F.least(F.greatest(raw, F.lit(0)), F.lit(n_bins - 1))
    return F.when(h.isNull() | F.isnan(h), F.lit(n_bins - 1)).otherwise(index).cast("bigint")


def bin_centre(index, n_bins: int) -> Column:
    """Centre in degrees of a heading bin."""
    return (_c(index).cast("double") + 0.5) * (360.0 / n_bins)


def vector_angle(x, y) -> Column:
    """Angle of a vector in [0, 360)."""
    return wrap360(F.degrees(F.atan2(_c(y), _c(x))))


def length(*parts) -> Column:
    """Euclidean length."""
    total = None
    for p in parts:
        square = _c(p) * _c(p)
        total = square if total is None else total + square
    return F.sqrt(total)


def mean_angle(angle) -> Column:
    """Aggregate: direction of the mean resultant, in [0, 360)."""
    a = F.radians(_c(angle))
    return vector_angle(F.avg(F.cos(a)), F.avg(F.sin(a)))


def resultant_length(angle) -> Column:
    """Aggregate: length of the mean resultant, in [0, 1]."""
    a = F.radians(_c(angle))
    return length(F.avg(F.cos(a)), F.avg(F.sin(a)))


def clockwise_sign(flip_direction: bool) -> int:
    """+1 if heading grows clockwise seen from above, which the flipped convention does."""
    return 1 if flip_direction else -1


def quaternion_apply(qx, qy, qz, qw, vector) -> tuple[Column, Column, Column]:
    """Rotate a constant vector by a unit quaternion held in four columns."""
    x, y, z, w = (_c(q) for q in (qx, qy, qz, qw))
    norm = F.sqrt(x * x + y * y + z * z + w * w)
    x, y, z, w = x / norm, y / norm, z / norm, w / norm
    a, b, c = (F.lit(float(v)) for v in vector)
    # v + 2w (u x v) + 2 u x (u x v)
    cx, cy, cz = y * c - z * b, z * a - x * c, x * b - y * a
    return (
        a + 2 * (w * cx + y * cz - z * cy),
        b + 2 * (w * cy + z * cx - x * cz),
        c + 2 * (w * cz + x * cy - y * cx),
    )


def heading_of(vx, vz, flip_direction: bool = False, offset_deg: float = 0.0) -> Column:
    """Azimuth of a direction in the horizontal plane, flipped and offset on request."""
    deg = F.degrees(F.atan2(_c(vx), _c(vz)))
    if flip_direction:
        deg = -deg
    return wrap360(deg + float(offset_deg))


def elevation_of(vy) -> Column:
    """Elevation of a unit direction in degrees."""
    return F.degrees(F.asin(F.greatest(F.least(_c(vy), F.lit(1.0)), F.lit(-1.0))))
