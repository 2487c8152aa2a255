"""Bounded pieces of a dense grid for work that needs an array: filters, products, transforms.

A recording is cut into blocks of a fixed number of bins with a halo on both
sides. What one Python call sees is one block, however long the recording is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import with_halo


MATRICES_HELD = 64  # products of different keys a task keeps before passing them on


def block_rows(df: DataFrame, index: str, block: int, halo: int) -> DataFrame:
    """Rows copied to every block whose halo reaches them."""
    return with_halo(df, index, block, halo)


def dense(pdf: pd.DataFrame, index: str, column: str, start: int, length: int) -> np.ndarray:
    """Array column as a matrix over ``start .. start+length``, zero where a bin is missing."""
    rows = np.stack(pdf[column].to_numpy()) if len(pdf) else np.zeros((0, 0))
    out = np.zeros((length, rows.shape[1]))
    out[pdf[index].to_numpy() - start] = rows
    return out


def map_blocks(df: DataFrame, keys: list[str], index: str, block: int, halo: int,
               work: Callable[[tuple, pd.DataFrame, int, int], pd.DataFrame], schema: str) -> DataFrame:
    """Call ``work(key, rows, start, stop)`` on each block, whose core is ``start <= index < stop``."""
    size = int(block)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(key[-1]) * size
        return work(key[:-1], pdf, start, start + size)

    return block_rows(df, index, size, halo).groupBy(*keys, "__block").applyInPandas(run, schema)


def gaussian_kernel(sigma: float, truncate: float = 5.0) -> np.ndarray:
    """Normalised Gaussian weights at whole offsets."""
    if sigma <= 0:
        return np.ones(1)
    reach = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return w / w.sum()


def filter_rows(matrix: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlate every column with a kernel of odd length, zero outside."""
    reach = len(kernel) // 2
    padded = np.pad(matrix, ((reach, reach), (0, 0)))
    out = np.zeros_like(matrix)
    for k, w in enumerate(kernel):
        if w:
            out += w * padded[k:k + len(matrix)]
    return out


def smoothed_rates(bins: DataFrame, keys: list[str], index: str, counts: str, duration: str,
                   sigma_bins: float, block: int = 4096) -> DataFrame:
    """Gaussian-smoothed rates of all units per bin, over the whole grid before any mask.

    `counts` is an array column over an agreed unit order. Bins beyond the grid
    or missing from it count as zero.
    """
    kernel = gaussian_kernel(sigma_bins)
    rates = bins.withColumn("__x", F.transform(counts, lambda k: k.cast("double") / F.col(duration).cast("double")))
    if len(kernel) == 1:
        return rates.select(*bins.columns, F.col("__x").alias("rates"))
    halo = len(kernel) // 2
    types = {f.name: f.dataType.simpleString() for f in bins.schema}

    def work(key, pdf, start, stop):
        lo = start - halo
        x = dense(pdf, index, "__x", lo, stop - start + 2 * halo)
        y = filter_rows(x, kernel)
        core = pdf[pdf["__core"]]
        out = core[[*keys, index]].copy()
        out["rates"] = pd.Series(list(y[core[index].to_numpy() - lo]), index=out.index, dtype=object)
        return out

    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, index]) + ", rates array<double>"
    smoothed = map_blocks(rates.select(*keys, index, "__x"), keys, index, block, halo, work, schema)
    return bins.join(smoothed, [*keys, index])


def gram(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Sum over rows of the outer product of two array columns, as ``(key, i, j, s)``.

    Each partition adds up its own products and emits one row of sums per key
    and i, so the shuffle carries units squared per partition, not per bin.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def emit(sums):
        for key, s in sums.items():
            out = pd.DataFrame({k: [v] * len(s) for k, v in zip(keys, key)}, index=range(len(s)))
            out["i"] = np.arange(len(s), dtype=np.int64)
            out["row"] = list(s)
            yield out

    def partial(frames):
        sums: dict = {}
        for pdf in frames:
            groups = pdf.groupby(keys, dropna=False) if keys else [((), pdf)]
            for key, part in groups:
                x = np.stack(part["__a"].to_numpy())
                y = np.stack(part["__b"].to_numpy())
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums[key] + x.T @ y if key in sums else x.T @ y
            if len(sums) > MATRICES_HELD:  # partial sums may be handed on at any time
                yield from emit(sums)
                sums = {}
        yield from emit(sums)

    schema = "".join(f"{k} {types[k]}, " for k in keys) + "i bigint, row array<double>"
    pieces = df.select(*keys, F.col(a).alias("__a"), F.col(b).alias("__b")).mapInPandas(partial, schema)
    cells = pieces.select(*keys, "i", F.posexplode("row").alias("j", "s"))
    return cells.groupBy(*keys, "i", F.col("j").cast("bigint").alias("j")).agg(F.sum("s").alias("s"))
