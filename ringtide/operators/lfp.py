"""State signals from field potentials: spectrogram, slow waves, theta, muscle tone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import gram, map_blocks
from .channels import even_positions
from .scan import centred

TINY = float(np.finfo(np.float32).tiny)


def log_frequencies(freq_range, n_freqs: int) -> np.ndarray:
    """Log-spaced frequencies, both ends included."""
    return np.logspace(np.log10(freq_range[0]), np.log10(freq_range[1]), int(n_freqs))


def _windows(samples: DataFrame, keys: list[str], frame: str, column: str, n_window: int, n_step: int, per_block: int, work,
             schema: str, pad: int = 0) -> DataFrame:
    """Call ``work(matrix, starts, lo)`` on the complete windows that start in each block."""
    size = per_block * n_step
    halo = n_window + pad
    types = {f.name: f.dataType.simpleString() for f in samples.schema}

    def run(key, pdf, start, stop):
        lo = start - halo
        rows = np.stack(pdf[column].to_numpy()) if len(pdf) else np.zeros((0, 1))
        rows = rows.reshape(len(pdf), -1).astype(float)
        x = np.zeros((stop - start + 2 * halo, rows.shape[1]))
        seen = np.zeros(len(x))
        at = pdf[frame].to_numpy() - lo
        x[at], seen[at] = rows, 1
        total = np.concatenate([[0], np.cumsum(seen)])
        starts = np.array([s for s in range(start, stop, n_step)
                           if total[s - lo + n_window] - total[s - lo] == n_window], dtype=int)
        out = work(x, starts - lo)
        out.insert(0, "window", starts // n_step)
        for name, v in reversed(list(zip(keys, key))):
            out.insert(0, name, v)
        return out

    head = "".join(f"{k} {types[k]}, " for k in keys) + "window bigint, "
    return map_blocks(samples, keys, frame, size, halo, run, head + schema)


def log_spectrogram(samples: DataFrame, keys: list[str], frame: str, value: str, fs: float, window_s: float, step_s: float,
                    freq_range, n_freqs: int, per_block: int = 512) -> DataFrame:
    """Power at log-spaced frequencies on sliding windows; window w starts at frame ``w*step``.

    A block holds a fixed number of windows. Only complete windows give a row.
    """
    n_window, n_step = round(window_s * fs), round(step_s * fs)
    freqs = log_frequencies(freq_range, n_freqs)
    grid = np.fft.rfftfreq(n_window, 1.0 / fs)
    taper = np.hanning(n_window)

    def work(x, starts):
        powers = [np.interp(freqs, grid, np.abs(np.fft.rfft(x[s:s + n_window, 0] * taper)) ** 2) for s in starts]
        return pd.DataFrame({"power": pd.Series(powers, dtype=object)})

    out = _windows(samples, keys, frame, value, n_window, n_step, per_block, work, "power array<double>")
    return out.withColumn("t", (F.col("window") * n_step + n_window / 2.0) / F.lit(float(fs)))


def band_power(power: Column | str, freqs: np.ndarray, band) -> Column:
    """Sum of the powers whose frequency lies in a closed band."""
    inside = np.flatnonzero((freqs >= band[0]) & (freqs <= band[1]))
    column = F.col(power) if isinstance(power, str) else power
    if not inside.size:
        return F.lit(0.0)
    part = F.slice(column, int(inside[0]) + 1, int(inside.size))
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + x)


def theta_ratio(power, freqs: np.ndarray, theta_band, ref_band) -> Column:
    """Theta power over reference power."""
    return band_power(power, freqs, theta_band) / F.greatest(band_power(power, freqs, ref_band), F.lit(TINY))


def broadband_slow_wave(spectra: DataFrame, keys: list[str], freqs: np.ndarray, slow_max: float = 32.0) -> DataFrame:
    """First principal component of the z-scored log spectrum, signed to rise with slow power.

    The frequencies' correlation matrix is summed over partitions; its leading
    vector weights each window's spectrum in place.
    """
    types = {f.name: f.dataType.simpleString() for f in spectra.schema}
    logs = spectra.withColumn("__l", F.transform("power", lambda p: F.log10(p + F.lit(TINY))))
    stats = logs.select(*keys, F.posexplode("__l").alias("f", "x")).groupBy(*keys, "f").agg(
        F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    packed = stats.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("f", "m", "s"))).alias("__stats"))
    work = logs.join(packed, keys) if keys else logs.withColumn("__stats", packed.scalar())
    work = work.withColumn("__z", F.zip_with("__l", "__stats", lambda x, q: (x - q["m"]) / (q["s"] + 1e-12)))
    cells = gram(work, keys, "__z", "__z")
    group = list(keys) or ["__all"]
    if not keys:
        cells = cells.withColumn("__all", F.lit(0))
        types["__all"] = "int"
    low = freqs <= slow_max

    def leading(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["i"].max()) + 1
        c = np.zeros((n, n))
        c[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["s"].to_numpy()
        values, vectors = np.linalg.eigh((c + c.T) / 2)
        w = vectors[:, -1]
        if w @ c @ low.astype(float) < 0:
            w = -w
        out = pd.DataFrame({g: [v] for g, v in zip(group, key)})
        out["w"] = [w]
        out["total"] = [float(values[-1])]
        return out

    schema = "".join(f"{g} {types[g]}, " for g in group) + "w array<double>, total double"
    vectors = cells.groupBy(*group).applyInPandas(leading, schema)
    counts = spectra.groupBy(*keys).agg(F.count("*").alias("__n"))
    if keys:
        work = work.join(vectors, keys).join(counts, keys)
    else:
        one = vectors.select(F.struct("w", "total").alias("v"))
        work = work.withColumn("__v", one.scalar()).withColumns({"w": F.col("__v.w"), "total": F.col("__v.total"), "__n": counts.scalar()}).drop("__v")
    score = F.aggregate(F.zip_with("__z", "w", lambda z, w: z * w), F.lit(0.0), lambda a, x: a + x)
    sd = F.sqrt(F.col("total") / F.col("__n"))
    return work.select(*spectra.columns, (score / (sd + 1e-12)).alias("broadband"))


def zero_phase_bandpass(x: np.ndarray, fs: float, band, order: int = 4) -> np.ndarray:
    """Forward-backward Butterworth band-pass of each column through its squared response."""
    n = len(x)
    size = 1 << int(np.ceil(np.log2(max(2 * n, 2))))
    warped = np.tan(np.pi * np.clip(np.fft.rfftfreq(size), 0, 0.4999999))
    lo, hi = np.tan(np.pi * band[0] / fs), np.tan(np.pi * band[1] / fs)
    with np.errstate(divide="ignore"):
        shape = (warped ** 2 - lo * hi) / ((hi - lo) * np.where(warped > 0, warped, np.nan))
    gain = np.nan_to_num(1.0 / (1.0 + shape ** (2 * order)))
    return np.fft.irfft(np.fft.rfft(x, size, axis=0) * gain[:, None], size, axis=0)[:n]


def emg_from_lfp(samples: DataFrame, keys: list[str], frame: str, traces: str, positions: list[tuple[float, float]], fs: float,
                 window_s: float, step_s: float, band=None, min_distance: float = 100.0, per_block: int = 256) -> DataFrame:
    """Mean correlation of distant channels per window, of the band-passed traces if a band is given.

    `traces` holds the chosen channels in the order of `positions`.
    """
    if band is not None and band[1] >= fs / 2:
        raise ValueError(f"band {band} reaches the Nyquist frequency of {fs / 2} Hz")
    xy = np.asarray(positions, dtype=float)
    apart = np.hypot(xy[:, 0, None] - xy[None, :, 0], xy[:, 1, None] - xy[None, :, 1])
    far = np.triu(apart >= min_distance, 1)
    if not far.any():
        raise ValueError(f"no pair of channels is {min_distance} apart")
    n_window, n_step = round(window_s * fs), round(step_s * fs)

    def work(x, starts):
        y = zero_phase_bandpass(x, fs, band) if band is not None else x
        scores = []
        for s in starts:
            with np.errstate(invalid="ignore", divide="ignore"):
                scores.append(np.nanmean(np.corrcoef(y[s:s + n_window], rowvar=False)[far]))
        return pd.DataFrame({"emg": np.asarray(scores, dtype=float)})

    pad = int(fs) if band is not None else 0
    return _windows(samples, keys, frame, traces, n_window, n_step, per_block, work, "emg double", pad)


def boxcar(bins: DataFrame, keys: list[str], index: str, columns: list[str], width: int) -> DataFrame:
    """Centred moving average with a constant divisor, so values fade towards the ends.

    An even width looks one bin further back than forward.
    """
    if width <= 1:
        return bins
    reach = (-(width // 2), (width - 1) // 2)
    made = {c: (lambda w, c=c: F.sum(F.col(c)).over(w) / F.lit(float(width))) for c in columns}
    return centred(bins, keys, index, width // 2, made, reach=reach)


def pick_slots(traces: str, n_available: int, n: int) -> Column:
    """Array of `n` channels spread evenly over the probe."""
    return F.array(*[F.col(traces)[i].cast("double") for i in even_positions(n_available, n)])
