"""Positions of spikes from one list handed to another, and fits of amplitude histograms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import number_rows

#: Fits in one array task, and rounds of one fit.
FITS, ROUNDS = 256, 120


def matched_locations(spikes: DataFrame, located: DataFrame, by: list[str], order: list[str], located_order: list[str], payload: list[str]) -> DataFrame:
    """`spikes` with the `payload` of the equal spike in `located`; equal means the same `by`.

    Spikes that are equal in `by` are numbered, here along `order` and there
    along `located_order`, and meet number by number, so every spike has one
    partner. Spikes or positions without a partner are refused.
    """
    left = number_rows(spikes, by, order, "__copy")
    right = number_rows(located, by, located_order, "__copy").select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__copy").alias("__other"), F.struct(*payload).alias("__payload"))
    same = F.col("__copy") == F.col("__other")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = left.join(right, same, "full")
    # one row without a partner stops the job that reads the result
    told = F.when(F.col("__copy").isNull() | F.col("__other").isNull(), F.raise_error(F.lit("the two lists do not hold the same spikes"))).otherwise(F.lit(True))
    return both.where(told).select(*spikes.columns, *[F.col("__payload")[c].alias(c) for c in payload])


def gaussian_cut_values(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Gaussians of parameters (amplitude, centre, sigma, cut) in the rows of `p` at `x`: zero below the cut."""
    z = (x - p[:, 1:2]) / p[:, 2:3]
    return np.where(x < p[:, 3:4], 0.0, p[:, 0:1] * np.exp(-0.5 * z * z))


def fit_many(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Damped Gauss-Newton steps inside bounds, for all rows together: parameters, and whether each came to rest.

    A small change of the cut changes nothing, so it is tried at its start, at its
    lower bound and between every two bins, and the best is kept; the other
    three parameters follow their derivatives.
    """
    best, best_cost, rest = start.copy(), np.full(len(start), np.inf), np.zeros(len(start), bool)
    for cut in np.column_stack([start[:, 3], low[:, 3], (x[:, 1:] + x[:, :-1]) / 2]).T:
        inside = (cut >= low[:, 3]) & (cut <= high[:, 3])
        if not inside.any():
            continue
        p = start.copy()
        p[:, 3] = np.clip(cut, low[:, 3], high[:, 3])
        damp, done = np.full(len(p), 1e-2), ~inside
        r = (y - gaussian_cut_values(x, p)) * weight
        cost, total = (r * r).sum(axis=1), ((y * weight) ** 2).sum(axis=1)
        for _ in range(ROUNDS):
            z = (x - p[:, 1:2]) / p[:, 2:3]
            g = np.where(x < p[:, 3:4], 0.0, np.exp(-0.5 * z * z)) * weight
            j = np.stack([g, p[:, 0:1] * g * z / p[:, 2:3], p[:, 0:1] * g * z * z / p[:, 2:3]], axis=2)
            pull = np.einsum("nbi,nb->ni", j, r)
            # a parameter that is pulled across the bound it stands at stays there
            held = (p[:, :3] <= low[:, :3]) & (pull < 0) | (p[:, :3] >= high[:, :3]) & (pull > 0)
            j, b = j * ~held[:, None, :], pull * ~held
            a = np.einsum("nbi,nbj->nij", j, j)
            scale = np.maximum(np.einsum("nii->ni", a), 1e-300)
            a = a + damp[:, None, None] * scale[:, :, None] * np.eye(3)
            trial = p.copy()
            trial[:, :3] = np.clip(p[:, :3] + np.linalg.solve(a, b[:, :, None])[:, :, 0], low[:, :3], high[:, :3])
            r_new = (y - gaussian_cut_values(x, trial)) * weight
            new = (r_new * r_new).sum(axis=1)
            better = (new < cost) & ~done
            still = (np.abs(trial[:, :3] - p[:, :3]) <= 1e-9 * (1e-9 + np.abs(p[:, :3]))).all(axis=1) | (better & (cost - new <= 1e-9 * cost)) | (damp > 1e12) | (new <= 1e-20 * total)
            p[better], r[better], cost[better] = trial[better], r_new[better], new[better]
            damp = np.where(better, damp / 4, damp * 4)
            done |= still
            if done.all():
                break
        take = inside & (cost < best_cost * (1 - 1e-12))
        best[take], best_cost[take], rest[take] = p[take], cost[take], done[take]
    return best, rest & np.isfinite(best_cost)


def fit_cut_gaussian(histograms: DataFrame, keys: list[str], centre: str, count: str, start: DataFrame) -> DataFrame:
    """`keys`, amplitude, centre, sigma, cut: a truncated Gaussian fitted to each key's histogram rows.

    `start` holds for each key the arrays ``p0, low, high`` of the four
    parameters. Many keys are fitted in one array task. A key with fewer bins
    than parameters, with bounds that exclude its start, or whose steps do not
    come to rest has nulls.
    """
    bins = histograms.where(F.col(count).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(centre).cast("double").alias("x"), F.col(count).cast("double").alias("y")))).alias("h"))
    rows = start.join(bins, keys, "left").select(*keys, "p0", "low", "high", F.transform("h", lambda b: b["x"]).alias("x"), F.transform("h", lambda b: b["y"]).alias("y"))
    names = ["amplitude", "centre", "sigma", "cut"]
    types = {f.name: f.dataType.simpleString() for f in start.schema}

    def work(frames):
        for whole in frames:
            for at in range(0, len(whole), FITS):
                pdf = whole.iloc[at:at + FITS]
                out = pdf[keys].copy()
                found = np.full((len(pdf), 4), np.nan)
                ok = np.array([x is not None and len(x) >= 4 and (np.asarray(a) <= np.asarray(p)).all() and (np.asarray(p) <= np.asarray(b)).all()
                               for x, p, a, b in zip(pdf["x"], pdf["p0"], pdf["low"], pdf["high"])])
                some = pdf[ok]
                if len(some):
                    width = max(map(len, some["x"]))
                    x, y, w = np.zeros((len(some), width)), np.zeros((len(some), width)), np.zeros((len(some), width))
                    for i, (xs, ys) in enumerate(zip(some["x"], some["y"])):
                        x[i, :len(xs)], y[i, :len(xs)], w[i, :len(xs)] = xs, ys, 1.0
                        x[i, len(xs):] = xs[-1]
                    fitted, rest = fit_many(x, y, w, *[np.stack(some[c].to_numpy()).astype(float) for c in ("p0", "low", "high")])
                    found[ok] = np.where(rest[:, None], fitted, np.nan)
                for n, name in enumerate(names):
                    out[name] = found[:, n]
                yield out

    schema = "".join(f"{k} {types[k]}, " for k in keys) + ", ".join(f"{n} double" for n in names)
    fitted = rows.mapInPandas(work, schema)
    return fitted.select(*keys, *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
