"""Which channels carry a two-moded signal: spectra on windows spread through a recording, scores, picks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lfp
from .channels import even_positions
from .joins import interval_join
from .scan import number_rows
from .thresholds import bimodality_score

SIGNALS = ("slow_wave", "theta")


def window_starts(total: int, n_window: int, n_windows: int = 240) -> list[int]:
    """First frames of evenly spaced windows; refused where two windows do not fit."""
    if total < 2 * n_window:
        raise ValueError(f"{total} frames are too few for windows of {n_window}")
    n = int(min(n_windows, max(total // n_window, 2)))
    return [int(s) for s in np.linspace(0, total - n_window - 1, n).astype(np.int64)]


def window_ranges(starts: list[int], n_window: int) -> list[tuple[int, int]]:
    """Frame ranges that the windows cover, for a source that reads by ranges."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s + n_window))
        else:
            out.append((s, s + n_window))
    return out


def sampled_spectra(samples: DataFrame, frame: str, traces: str, slots: list[int], starts: list[int], fs: float, n_window: int,
                    freq_range, n_freqs: int) -> DataFrame:
    """``window, slot, power`` at log-spaced frequencies for each window and channel slot.

    Windows with missing frames give no row. Hand in samples read by
    `window_ranges`, so that a source reads the windows only. A task holds one window.
    """
    freqs, grid, taper = lfp.log_frequencies(freq_range, n_freqs), np.fft.rfftfreq(n_window, 1.0 / fs), np.hanning(n_window)
    spans = samples.sparkSession.createDataFrame([(i, s, s + n_window) for i, s in enumerate(starts)], "window int, lo bigint, hi bigint")
    chosen = samples.select(frame, F.array(*[F.col(traces)[c].cast("double") for c in slots]).alias("x"))
    held = interval_join(chosen, F.broadcast(spans), [], frame, "lo", "hi", n_window)

    def work(key, pdf):
        if len(pdf) < n_window:
            return pd.DataFrame({"window": [], "slot": [], "power": []})
        x = np.stack(pdf.sort_values(frame)["x"].to_numpy())
        power = np.abs(np.fft.rfft(x * taper[:, None], axis=0)) ** 2
        return pd.DataFrame({"window": key[0], "slot": slots, "power": [np.interp(freqs, grid, power[:, c]) for c in range(len(slots))]})

    return held.groupBy("window").applyInPandas(work, "window int, slot int, power array<double>")


def derived_signal(spectra: DataFrame, freqs: np.ndarray, signal: str, slow_max: float, theta_band, theta_ref_band) -> DataFrame:
    """``slot, window, value``: the quantity that scoring would put a threshold on, by channel."""
    if signal == "slow_wave":
        return lfp.broadband_slow_wave(spectra, ["slot"], freqs, slow_max).select("slot", "window", F.col("broadband").alias("value"))
    if signal == "theta":
        ratio = lfp.theta_ratio("power", freqs, theta_band, theta_ref_band)
        return spectra.select("slot", "window", F.log10(F.greatest(ratio, F.lit(lfp.TINY))).alias("value"))
    raise ValueError(f"signal is one of {SIGNALS}, not {signal!r}")


def rank_channels(spectra: DataFrame, freqs: np.ndarray, signal: str, slow_max: float = 32.0, theta_band=(5, 10), theta_ref_band=(2, 15)) -> DataFrame:
    """``slot, score, position``: channels by the bimodality of their own signal, the best first, those without a score last."""
    values = derived_signal(spectra, freqs, signal, slow_max, theta_band, theta_ref_band)
    return positions(bimodality_score(values, ["slot"], "value").select("slot", "score"))


def positions(scores: DataFrame, score: Column | None = None) -> DataFrame:
    """Scores with their place from the largest down, ties by slot."""
    down = -(score if score is not None else F.col("score"))
    ordered = scores.withColumn("__o", F.coalesce(down, F.lit(float("inf"))))
    return number_rows(ordered, [], ["__o", "slot"], "position").drop("__o")


def candidates(n_channels: int, n: int, exclude: list[int] = (), step: int = 4) -> list[int]:
    """Slots to search: every `step`-th that is left, or all of these where that is too few."""
    left = [c for c in range(n_channels) if c not in set(exclude)]
    if not left:
        raise ValueError("no channels are left after excluding")
    if n >= len(left):
        return left
    strided = left[::max(int(step), 1)]
    return strided if len(strided) >= n else left


def pick_bimodal(ranked: DataFrame, n: int, n_channels: int, exclude: list[int] = ()) -> DataFrame:
    """The `n` best slots in probe order; evenly spread ones where fewer have a score."""
    left = [c for c in range(n_channels) if c not in set(exclude)]
    if n >= len(left):
        return ranked.sparkSession.createDataFrame([(c,) for c in left], "slot int")
    even = [left[i] for i in even_positions(len(left), n)]
    scored = ranked.where("score IS NOT NULL")
    best = scored.where(F.col("position") < n).select("slot")
    spread = ranked.sparkSession.createDataFrame([(c,) for c in even], "slot int")
    enough = scored.agg((F.count(F.lit(1)) >= n).alias("ok"))
    both = best.withColumn("ok", F.lit(True)).unionByName(spread.withColumn("ok", F.lit(False)))
    return both.join(F.broadcast(enough), "ok").select("slot").orderBy("slot")
