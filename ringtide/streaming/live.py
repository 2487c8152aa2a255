"""Bins and causal headings while a recording is still arriving."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decoding import _likelihood, _unit


def binned_counts(spikes: DataFrame, time: str, width: str, by: list[str], late: str) -> DataFrame:
    """Spikes per key and tumbling bin; a bin closes once the watermark has passed it."""
    return (spikes.withWatermark(time, late).groupBy(F.window(time, width), *by)
            .agg(F.count("*").alias("n_spikes")).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *by, "n_spikes"))


def causal_heading(bins: DataFrame, key: str, index: str, counts: str, duration: str, rates: np.ndarray,
                   transition: np.ndarray, max_step: int = 1) -> DataFrame:
    """Heading per bin from the spikes so far; the belief of each key is the stream's state.

    The forward half of the decoder: after a hole of more than `max_step` bins
    the belief starts afresh. Bins must arrive in order from one micro-batch to
    the next. State per key is one number per heading bin.
    """
    n = len(transition)
    types = {f.name: f.dataType.simpleString() for f in bins.schema}

    def step(key_value, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(index)
        belief, last = None, None
        if state.exists:
            last, stored = state.get
            belief = np.asarray(stored)
        like = _likelihood(np.stack(rows[counts].to_numpy()).astype(float), rows[duration].to_numpy(dtype=float), rates)
        best, peak = [], []
        for i, row in zip(rows[index], like):
            fresh = belief is None or i - last > max_step
            prior = np.full(n, 1.0 / n) if fresh else belief @ transition
            belief, last = _unit(prior * row), int(i)
            best.append((belief.argmax() + 0.5) * 360.0 / n)
            peak.append(belief.max())
        state.update((last, [float(p) for p in belief]))
        out = rows[[key, index]].copy()
        yield out.assign(decoded_deg=best, posterior_max=peak)

    schema = f"{key} {types[key]}, {index} {types[index]}, decoded_deg double, posterior_max double"
    return bins.groupBy(key).applyInPandasWithState(step, schema, "last bigint, belief array<double>", "append", "NoTimeout")
