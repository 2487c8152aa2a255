"""Spike positions handed over one by one, and histogram fits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringtide.operators import locations


def test_locations_meet_one_to_one(spark):
    draw = random.Random(4)
    spikes = [(i, draw.randint(0, 200), draw.randint(0, 3)) for i in range(600)]  # many share sample and unit
    placed = sorted(spikes, key=lambda s: (s[1], draw.random()))  # detection order: ties in any order
    copies, rows = {}, []
    for n, (_, sample, unit) in enumerate(placed):
        k = copies[sample, unit] = copies.get((sample, unit), -1) + 1
        rows.append((n, sample, unit, float(10 * unit + k), float(sample)))
    a = spark.createDataFrame(spikes, "pos int, sample int, unit int").repartition(4)
    z = spark.createDataFrame(rows, "place int, sample int, unit int, x double, y double").repartition(3)
    found = locations.matched_locations(a, z, ["sample", "unit"], ["pos"], ["place"], ["x", "y"]).collect()
    assert sorted(r.pos for r in found) == list(range(600))
    seen = {}
    for r in sorted(found, key=lambda r: r.pos):
        k = seen[r.sample, r.unit] = seen.get((r.sample, r.unit), -1) + 1
        assert (r.x, r.y) == (10 * r.unit + k, r.sample)
    for left, right in ((a.where("pos <> 7"), z), (a, z.where("place <> 7")), (a.withColumn("unit", F.when(F.col("pos") == 5, 9).otherwise(F.col("unit"))), z)):
        with pytest.raises(Exception, match="same spikes"):
            locations.matched_locations(left, right, ["sample", "unit"], ["pos"], ["place"], ["x", "y"]).count()
            locations.matched_locations(left, right, ["sample", "unit"], ["pos"], ["place"], ["x", "y"]).collect()
    assert locations.matched_locations(a.limit(0), z.limit(0), ["sample", "unit"], ["pos"], ["place"], ["x", "y"]).count() == 0


def test_known_gaussians_are_found(spark):
    x = np.linspace(0, 10, 41)
    truth = [(100.0, 5.0, 1.5, 3.1), (40.0, 4.0, 2.0, -1.0), (70.0, 2.0, 1.0, 2.3), (55.0, 6.0, 0.8, 5.5)]
    rows, start = [], []
    for k, p in enumerate(truth):
        y = np.where(x < p[3], 0.0, p[0] * np.exp(-0.5 * ((x - p[1]) / p[2]) ** 2))
        rows += [(k, float(a), float(b)) for a, b in zip(x, y)]
        start.append((k, [float(y.max()), float(x[y.argmax()]), 1.2, float(x[0])], [0.0, -5.0, 0.05, -2.0], [1000.0, 15.0, 20.0, 9.0]))
    start += [(90, [1.0, 1.0, 1.0, 0.0], [0.0] * 4, [9.0] * 4), (91, [1.0, 1.0, 1.0, 0.0], [2.0] * 4, [9.0] * 4)]
    rows += [(91, 1.0, 2.0)]
    h = spark.createDataFrame(rows, "unit int, x double, n double").repartition(3)
    s = spark.createDataFrame(start, "unit int, p0 array<double>, low array<double>, high array<double>")
    got = {r.unit: r for r in locations.fit_cut_gaussian(h, ["unit"], "x", "n", s).collect()}
    for k, p in enumerate(truth):
        assert np.allclose([got[k].amplitude, got[k].centre, got[k].sigma], p[:3], rtol=1e-5), (k, got[k])
        assert (x < got[k].cut).sum() == (x < p[3]).sum()
    assert got[90].amplitude is None and got[91].cut is None  # no bins; a start outside its bounds


def test_noisy_histograms_cost_no_more_than_the_truth():
    draw = np.random.default_rng(0)
    x = np.tile(np.linspace(0, 20, 60), (30, 1))
    p = np.column_stack([draw.uniform(50, 200, 30), draw.uniform(5, 12, 30), draw.uniform(1, 4, 30), draw.uniform(0, 6, 30)])
    y = draw.poisson(locations.gaussian_cut_values(x, p)).astype(float)
    start = np.column_stack([y.max(axis=1), x[0, y.argmax(axis=1)], np.full(30, 2.0), np.zeros(30)])
    low, high = np.tile([0.0, -10, 0.1, -1], (30, 1)), np.tile([1e4, 40, 40, 15], (30, 1))
    found, rest = locations.fit_many(x, y, np.ones_like(x), start, low, high)
    assert rest.all() and ((found >= low) & (found <= high)).all()
    cost = lambda q: ((y - locations.gaussian_cut_values(x, q)) ** 2).sum(axis=1)
    assert (cost(found) <= cost(p) * (1 + 1e-9)).all()
