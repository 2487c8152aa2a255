"""What the review of round 3 found, small."""

import numpy as np

from ringtide import scale
from ringtide.operators import matching, pairs, scan, shifted, tuning


def _curve(spark, unit, values):
    return spark.createDataFrame([(unit, i, float(v)) for i, v in enumerate(values)], "unit_id long, angle_bin long, hz double")


def test_similarity_to_a_flat_curve_is_null(spark):
    flat, tuned = _curve(spark, 1, [3, 3, 3, 3]), _curve(spark, 2, [1, 2, 5, 2])
    wanted = spark.createDataFrame([(1, 2), (2, 2), (2, 1)], "ref_unit long, other_unit long")
    both = flat.unionByName(tuned)
    got = {(r.ref_unit, r.other_unit): r.similarity for r in matching.tuning_similarity(wanted, both, both, 4).collect()}
    assert got[1, 2] is None and got[2, 1] is None
    assert abs(got[2, 2] - 1) < 1e-12


def test_correlations_without_spread_are_null(spark):
    rows = [(0, 1.0, float(i)) for i in range(4)] + [(1, float(i * i), float(i)) for i in range(4)]
    df = spark.createDataFrame(rows + [(1, None, 900.0)], "k int, x double, y double")
    got = {r.k: r.r for r in pairs.pearson(df, ["k"], "x", "y").collect()}
    assert got[0] is None
    assert abs(got[1] - np.corrcoef([0, 1, 4, 9], [0, 1, 2, 3])[0, 1]) < 1e-12
    assert {r.k: r.rho for r in pairs.rank_correlation(df, ["k"], "x", "y").collect()} == {0: None, 1: 1.0}


def test_scans_without_keys_are_cut_finer(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(3000).selectExpr("id", "id % 4 AS k", "rand(1) AS x").write.parquet(path)
    df = spark.read.parquet(path)
    spark.conf.set(scale.CHUNK_BYTES_CONF, str(4 * scale.estimated_bytes(df)))
    try:
        whole = scan.number_rows(df, [], ["id"], "at")
        keyed = scan.number_rows(df, ["k"], ["id"], "at")
        labelled = scan.plan_cuts(df, "id", keyless=True)
    finally:
        spark.conf.unset(scale.CHUNK_BYTES_CONF)
    assert "__carry_0" in whole._jdf.queryExecution().toString() and labelled.points
    assert "__carry_0" not in keyed._jdf.queryExecution().toString()
    assert whole.count() == 3000 and whole.where("at <> id").isEmpty()


def test_shifted_curves_are_counted_by_block(spark):
    rng, n, n_bins, shifts = np.random.default_rng(2), 1000, 12, [1, 63, 64, 500, 990, 37]
    # unit 0 fires most of the time, unit 9 once; some frames have no unit
    units = [None if i % 97 == 0 else 9 if i == 998 else int(rng.choice([0, 0, 0, 0, 1, 2, 3])) for i in range(n)]
    headings = [float(x) for x in rng.uniform(0, 360, n)]
    frames = spark.createDataFrame([(u, i * 3, h, 2.0) for i, (u, h) in enumerate(zip(units, headings, strict=True))],
                                   "unit long, t long, heading double, d double")
    bins = [int(h // 30) for h in headings]
    spent = [2.0 * bins.count(i) for i in range(n_bins)]
    kernel = tuning.wrapped_kernel(1.0, n_bins)
    counts: dict = {}
    for i, u in enumerate(units):
        for k, s in enumerate(shifts):
            at = bins[(i - s) % n]
            counts[u, k, at] = counts.get((u, k, at), 0) + 1
    expected: dict = {}
    for (u, k, at), c in counts.items():
        for off, w in kernel:
            cell = u, k, (at + off) % n_bins
            expected[cell] = expected.get(cell, 0.0) + w * c / spent[at]
    rates = shifted.smoother(spent, kernel, 1.0)
    for block in (16, 64, 5000):
        cells = shifted.shifted_cells(frames, "unit", "heading", ["t"], n_bins, shifts, n, block)
        if block == 5000:
            assert {r["__dense"] for r in cells.select("__dense").distinct().collect()} == {True, False}
        bands = shifted.shifted_bands(cells, "unit", len(shifts), rates, n_bins)
        got = {(r.unit, k, r.angle_bin): hz for r in bands.collect() for k, hz in enumerate(r.hz) if hz is not None}
        assert got.keys() == expected.keys()
        assert max(abs(got[c] - expected[c]) for c in got) < 1e-12
        # no row for a spike and a shift
        assert "Generate" not in bands._jdf.queryExecution().executedPlan().toString()
    curves = tuning.shifted_curves(frames, "unit", "heading", "d", ["t"], n_bins, 30.0, shifts, n)
    got = {(r.unit, r.shuffle, r.angle_bin): r.hz for r in curves.collect()}
    assert got.keys() == expected.keys() and max(abs(got[c] - expected[c]) for c in got) < 1e-12


def test_null_band_skips_shuffles_without_a_value(spark):
    null = spark.createDataFrame([(1, 0, [3.0, None, 1.0, 2.0]), (1, 1, [None, 5.0, None, None])], "u long, angle_bin long, hz array<double>")
    got = {r.angle_bin: r.band for r in tuning.null_band(null, "u", (0.0, 25.0, 50.0, 100.0)).collect()}
    assert got == {0: [1.0, 1.5, 2.0, 3.0], 1: [5.0] * 4}


def test_significance_takes_one_pass_over_the_counts(spark):
    rng, n, n_bins, shifts = np.random.default_rng(5), 400, 12, [30, 77, 200, 351]
    units = [None if i % 50 == 0 else int(rng.choice([0, 0, 0, 1, 2])) for i in range(n)]
    headings = [float(x) for x in rng.uniform(0, 360, n)]
    frames = spark.createDataFrame([(u, i, h, 2.0) for i, (u, h) in enumerate(zip(units, headings, strict=True))],
                                   "unit long, t long, heading double, d double")
    stats, band = tuning.hd_significance(frames, "unit", "heading", "d", ["t"], n_bins, 30.0, min_shift=1.0, alpha=0.25, shifts=shifts)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    # no curve is spread over its kernel row by row, and no unit is looked up again
    assert "Generate" not in plan and "Join" not in plan
    bins = [int(h // 30) for h in headings]
    spent = np.array([2.0 * bins.count(i) for i in range(n_bins)])
    spread = np.zeros((n_bins, n_bins))
    for off, w in tuning.wrapped_kernel(1.0, n_bins):
        spread[np.arange(n_bins), (np.arange(n_bins) + off) % n_bins] += w
    theta = np.radians((np.arange(n_bins) + 0.5) * 30)

    def curve(unit, shift):
        k = np.bincount([bins[(i - shift) % n] for i, u in enumerate(units) if u == unit], minlength=n_bins)
        hz = (k / spent) @ spread
        return hz, np.hypot(hz @ np.cos(theta), hz @ np.sin(theta)) / hz.sum(), np.degrees(np.arctan2(hz @ np.sin(theta), hz @ np.cos(theta))) % 360

    got = {r.unit: r for r in stats.collect()}
    assert got.keys() == {0, 1, 2}
    for unit, r in got.items():
        hz, size, angle = curve(unit, 0)
        null = [curve(unit, s)[1] for s in shifts]
        assert r.n_spikes == units.count(unit) and abs(r.mean_rate_hz - r.n_spikes / (2.0 * n)) < 1e-12
        assert abs(r.mean_vector_length - size) < 1e-12 and abs(r.preferred_direction_deg - angle) < 1e-9 and abs(r.peak_rate_hz - hz.max()) < 1e-12
        assert r.p_value == (1 + sum(x >= size for x in null)) / 5 and abs(r.mvl_threshold - np.quantile(null, 0.75)) < 1e-12
    # the unit's own curve is none of its nulls
    for r in band.where("unit = 1").collect():
        assert len(r.hz) == len(shifts)
        assert max(abs(hz - curve(1, s)[0][r.angle_bin]) for hz, s in zip(r.hz, shifts, strict=True)) < 1e-12


def test_tuning_counts_compute_the_frames_once(spark, tmp_path):
    path = str(tmp_path / "frames")
    rows = [(None if i % 11 == 0 else i % 3, float(i * 7 % 360), 2.0 + i % 5) for i in range(500)]
    spark.createDataFrame(rows, "unit long, heading double, d double").write.parquet(path)
    counts = tuning.tuning_counts(spark.read.parquet(path), "unit", "heading", "d", 12)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "heading" not in plan and counts._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    expected: dict = {}
    spent = [0.0] * 12
    for unit, heading, d in rows:
        spent[int(heading // 30)] += d
        expected[unit, int(heading // 30)] = expected.get((unit, int(heading // 30)), 0) + (unit is not None)
    got = {(r.unit, r.angle_bin): r for r in counts.collect()}
    assert got.keys() == {(u, i) for u in (None, 0, 1, 2) for i in range(12)}
    # as a join of keys has it, spikes without a unit are counted for none
    assert all(r.n_spikes == expected.get(k, 0) and r.occupancy == spent[k[1]] for k, r in got.items())


def test_smoothing_takes_an_array_per_key(spark):
    values = {(1, 0): 2.0, (1, 5): 1.0, (2, 11): 4.0, (None, 3): 1.0}
    cells = spark.createDataFrame([(k, i, v) for (k, i), v in values.items()] + [(3, 1, None)], "k long, i long, v double")
    kernel = tuning.wrapped_kernel(1.0, 12, 1.0)
    expected: dict = {}
    for (k, i), v in values.items():
        for off, w in kernel:
            expected[k, (i + off) % 12] = expected.get((k, (i + off) % 12), 0.0) + v * w
    smooth = tuning.smooth_ring(cells, ["k"], "i", "v", 12, 30.0, "out", 1.0)
    got = {(r.k, r.i): r.out for r in smooth.collect()}
    assert got.keys() == expected.keys() and max(abs(got[c] - expected[c]) for c in got) < 1e-12
    # what is gathered are the values, not a row for each value and weight
    plan = smooth._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and plan.count("Generate") == 1
