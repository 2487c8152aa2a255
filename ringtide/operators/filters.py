"""Filter chains and resampling of traces, on blocks with a halo as wide as the whole chain.

Every filter has a kernel of finite length, so a block's result does not depend on
where the recording was cut. Outside the recording, and where frames are missing,
samples count as zero before every step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .blocks import map_blocks


@dataclass(frozen=True)
class Filter:
    """Convolution of every channel with its own kernel (columns), or all with the same; the middle tap is the frame itself."""

    kernel: np.ndarray

    @property
    def reach(self) -> int:
        return len(self.kernel) // 2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        size = 1 << (len(x) + len(self.kernel) - 2).bit_length()
        spectrum = np.fft.rfft(self.kernel.reshape(len(self.kernel), -1), size, axis=0)
        return np.fft.irfft(np.fft.rfft(x, size, axis=0) * spectrum, size, axis=0)[self.reach:self.reach + len(x)]


@dataclass(frozen=True)
class Reference:
    """Every frame less the median or mean of its channels."""

    kind: str = "median"
    reach = 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x - (np.median(x, axis=1, keepdims=True) if self.kind == "median" else x.mean(axis=1, keepdims=True)) if x.shape[1] else x


def zero_phase_kernel(fs: float, low: float | None, high: float | None, order: int = 5, reach: int | None = None) -> np.ndarray:
    """Symmetric kernel of a Butterworth response passed forward and backward, tapered to `reach` frames each way.

    Without `reach` it spans three periods of the lowest edge.
    """
    edges = [e for e in (low, high) if e]
    if not edges or any(e <= 0 or e >= fs / 2 for e in edges) or (low and high and low >= high):
        raise ValueError(f"edges {low}, {high} do not lie inside 0 to {fs / 2} Hz in order")
    reach = reach or math.ceil(3 * fs / min(edges))
    size = 1 << (16 * reach).bit_length()
    warped = np.tan(np.pi * np.clip(np.fft.rfftfreq(size), 0, 0.4999999))
    gain = np.ones(len(warped))
    if low:
        with np.errstate(divide="ignore"):
            gain = gain / (1.0 + (math.tan(math.pi * low / fs) / warped) ** (2 * order))
    if high:
        gain = gain / (1.0 + (warped / math.tan(math.pi * high / fs)) ** (2 * order))
    response = np.fft.irfft(gain, size)
    taper = np.cos(np.linspace(-np.pi / 2, np.pi / 2, 2 * reach + 3)[1:-1]) ** 2
    kernel = np.concatenate([response[-reach:], response[:reach + 1]]) * taper
    if low and not high:  # what the taper let through at rest goes back
        kernel -= kernel.sum() * taper / taper.sum()
    return kernel


def delay_kernels(shifts: list[float], reach: int = 16) -> np.ndarray:
    """Kernels that read each channel `shifts` frames later (a fraction of a frame)."""
    at = np.arange(reach, -reach - 1, -1)[:, None] - np.asarray(shifts, float)[None, :]
    return np.sinc(at) * np.cos(np.pi * np.clip(at / (reach + 1), -1, 1) / 2) ** 2


def steps_of(config: dict, fs: float, good: list[int]) -> list:
    """The chain that a configuration names, in its order.

    ``highpass_filter`` (freq_min), ``bandpass_filter`` (freq_min, freq_max),
    ``common_reference`` (operator: median or average), ``phase_shift`` (shifts:
    one for each channel of the recording). Anything else is refused.
    """
    steps: list = []
    for name, options in config.items():
        given = dict(options or {})
        if name == "highpass_filter":
            steps.append(Filter(zero_phase_kernel(fs, given.pop("freq_min", 300.0), None)))
        elif name == "bandpass_filter":
            steps.append(Filter(zero_phase_kernel(fs, given.pop("freq_min", 300.0), given.pop("freq_max", 6000.0))))
        elif name == "common_reference":
            kind = given.pop("operator", "median")
            if kind not in ("median", "average"):
                raise ValueError(f"no reference by {kind!r}")
            steps.append(Reference(kind))
        elif name == "phase_shift":
            shifts = given.pop("shifts")
            steps.append(Filter(delay_kernels([shifts[c] for c in good])))
        else:
            raise ValueError(f"no step {name!r}")
        if given:
            raise ValueError(f"{name}: {sorted(given)} not understood")
    return steps


def apply_chain(x: np.ndarray, seen: np.ndarray, steps: list) -> np.ndarray:
    """All steps one after another; what is outside the recording stays zero between them."""
    for step in steps:
        x = step(x) * seen[:, None]
    return x


def _block(pdf: pd.DataFrame, frame: str, traces: str, lo: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples of ``lo .. lo + length`` as a matrix, and which frames are there."""
    rows = np.stack(pdf[traces].to_numpy()).astype(float)
    x, seen = np.zeros((length, rows.shape[1])), np.zeros(length)
    at = pdf[frame].to_numpy() - lo
    x[at], seen[at] = rows, 1.0
    return x, seen


def apply_preprocessing(samples: DataFrame, keys: list[str], frame: str, traces: str, steps: list, good: list[int], block: int = 1 << 14) -> DataFrame:
    """`keys`, `frame` and `traces` (doubles) after `steps` over the slots `good`; other slots come out as they went in.

    A step sees the good channels only, so a broken channel takes no part in a
    reference. One block and the reach of the whole chain on both sides is what a task holds.
    """
    halo = sum(s.reach for s in steps)
    types = {f.name: f.dataType.simpleString() for f in samples.schema}

    def work(key, pdf, start, stop):
        lo = start - halo
        x, seen = _block(pdf, frame, traces, lo, stop - start + 2 * halo)
        out = x.copy()
        if good:
            out[:, good] = apply_chain(x[:, good], seen, steps)
        core = pdf[pdf["__core"]]
        found = core[[*keys, frame]].copy()
        found[traces] = pd.Series(list(out[core[frame].to_numpy() - lo]), index=found.index, dtype=object)
        return found

    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, frame]) + f", {traces} array<double>"
    return map_blocks(samples.select(*keys, frame, traces), keys, frame, max(block, 8 * halo), halo, work, schema)


def resampling_weights(ratio: Fraction, crossings: int = 10) -> tuple[int, np.ndarray]:
    """Reach in input frames, and the weights for each phase of the output grid (rows): a windowed low-pass at nine tenths of the new limit."""
    reach = math.ceil(crossings * ratio)
    phases = np.array([float((k * ratio) % 1) for k in range(ratio.denominator)])
    at = np.arange(-reach, reach + 1)[None, :] - phases[:, None]
    limit = 0.9 / float(ratio)
    w = np.sinc(at * limit) * np.cos(np.pi * np.clip(at / (reach + 1), -1, 1) / 2) ** 2
    return reach, w / w.sum(axis=1, keepdims=True)


def resample_to(samples: DataFrame, keys: list[str], frame: str, traces: str, fs: float, rate: float, outputs: int = 4096) -> tuple[DataFrame, float]:
    """Traces at `rate`, with the rate they have: they are thinned, never filled up.

    Frame k of the result lies at the time of input frame k * fs / rate. A block is
    a whole number of steps of both grids, so each output is made in one
    block; it exists where the input frame at or before it does. At or below
    `rate` the samples come back as they are.
    """
    if fs <= rate or math.isclose(fs, rate, rel_tol=1e-9):
        return samples, fs
    ratio = Fraction(fs).limit_denominator(10**6) / Fraction(rate).limit_denominator(10**6)
    p, q = ratio.numerator, ratio.denominator
    reach, weights = resampling_weights(ratio)
    cycles = max(1, outputs // q)
    types = {f.name: f.dataType.simpleString() for f in samples.schema}

    def work(key, pdf, start, stop):
        lo = start - reach - 1
        x, seen = _block(pdf, frame, traces, lo, stop - start + 2 * (reach + 1))
        first = start // p * q
        made, rows = [], []
        for k in range(first, first + cycles * q):
            at = k * p // q - lo
            if seen[at]:
                made.append(k)
                rows.append(weights[k % q] @ x[at - reach:at + reach + 1])
        out = pd.DataFrame({k: [v] * len(made) for k, v in zip(keys, key)}, index=range(len(made)))
        out[frame] = np.array(made, np.int64)
        out[traces] = pd.Series(rows, index=out.index, dtype=object)
        return out

    schema = "".join(f"{k} {types[k]}, " for k in keys) + f"{frame} bigint, {traces} array<double>"
    return map_blocks(samples.select(*keys, frame, traces), keys, frame, cycles * p, reach + 1, work, schema), rate
