"""Posterior arrays over a ring of headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise(p) -> Column:
    """Array scaled to sum to one; an array with nothing in it becomes uniform."""
    a = _c(p)
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(total > 0, F.transform(a, lambda x: x / total)).otherwise(
        F.transform(a, lambda x: F.lit(1.0) / F.size(a)))


def entropy_bits(p) -> Column:
    """Entropy of a probability array in bits, counting 0 log 0 as 0."""
    return -F.aggregate(_c(p), F.lit(0.0), lambda acc, x: acc + F.when(x > 0, x * F.log2(x)).otherwise(0.0))
