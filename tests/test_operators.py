"""Operators against brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ringtide.operators import decoding as de
from ringtide.operators import lfp, matching, pairs, ring, states
from ringtide.operators.joins import asof_join
from ringtide.operators.scan import (following, last_valid, next_valid, plan_cuts, position, previous, running_max,
                                     running_sum, scan, with_chunks)
from ringtide.operators.thresholds import find_bimodal_threshold
from ringtide.plans.ring_session import fit_ring


def _skewed(spark, n=3000, seed=0):
    """A third of the rows under one key."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 20, n))
    t = rng.permutation(n)
    x = rng.normal(size=n).round(3)
    rows = [(int(k), int(a), float(v) if rng.random() > 0.3 else None) for k, a, v in zip(key, t, x)]
    return spark.createDataFrame(rows, "k int, t bigint, x double")


@pytest.mark.parametrize("chunks", [1, 7])
def test_scan_equals_plain_window(spark, chunks):
    df = _skewed(spark)
    got = scan(df, ["k"], ["t"], {
        "p": previous("x"), "f": following("x"), "s": running_sum("x"), "m": running_max("x"),
        "l": last_valid("x"), "n": next_valid("x"), "i": position()}, chunks).toPandas()
    w = W.partitionBy("k").orderBy("t")
    upto, onward = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    want = df.select(
        "k", "t", "x", F.lag("x").over(w).alias("p"), F.lead("x").over(w).alias("f"), F.sum("x").over(upto).alias("s"),
        F.max("x").over(upto).alias("m"), F.last("x", True).over(upto).alias("l"), F.first("x", True).over(onward).alias("n"),
        (F.row_number().over(w) - 1).cast("bigint").alias("i")).toPandas()
    order = ["k", "t"]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True))


@pytest.mark.parametrize("chunks", [1, 5])
def test_asof_join(spark, chunks):
    df = _skewed(spark)
    left, right = df.where("t % 2 = 0"), df.where("t % 3 = 1").withColumnRenamed("t", "rt")
    got = asof_join(left.select("k", "t"), right, ["k"], "t", "rt", ["rt"], "rt", chunks).toPandas()
    r = right.toPandas()
    for row in got.sample(200, random_state=0).itertuples():
        earlier = r[(r.k == row.k) & (r.rt <= row.t)].rt
        assert (pd.isna(row.rt) and earlier.empty) or row.rt == earlier.max()


def test_scan_cuts_ties_by_the_next_column(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b)) for a, b in zip(np.where(rng.random(4000) < 0.5, 7, rng.integers(0, 50, 4000)), rng.permutation(4000))]
    df = spark.createDataFrame(rows, "t bigint, u bigint")
    cuts = plan_cuts(df, ["t", "u"], 8)
    assert cuts.ties
    marked, _n = with_chunks(df, ["t", "u"], cuts)
    assert max(r["count"] for r in marked.groupBy("__chunk").count().collect()) < 1200
    got = scan(df, [], ["t", "u"], {"i": position()}, cuts).orderBy("i").toPandas()
    want = sorted(rows)
    assert list(zip(got.t, got.u)) == want and got.i.tolist() == list(range(4000))


def _shortest_first(codes, minimum):
    codes = list(codes)
    while True:
        runs = []
        for i, c in enumerate(codes):
            if runs and runs[-1][2] == c:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1, c])
        short = [(b - a, n) for n, (a, b, _c) in enumerate(runs) if b - a < minimum]
        if not short or len(runs) == 1:
            return codes
        _, n = min(short)
        near = [m for m in (n - 1, n + 1) if 0 <= m < len(runs)]
        take = max(near, key=lambda m: (runs[m][1] - runs[m][0], -m))
        a, b, _ = runs[n]
        codes[a:b] = [runs[take][2]] * (b - a)


@pytest.mark.parametrize("seed", range(3))
def test_enforce_min_duration(spark, seed):
    rng = np.random.default_rng(seed)
    rows, want = [], {}
    for session in range(4):
        codes = np.repeat(rng.choice([1, 3, 5], 60), rng.integers(1, 9, 60))
        rows += [(session, i, int(c)) for i, c in enumerate(codes)]
        want[session] = _shortest_first(codes.tolist(), 4)
    bins = spark.createDataFrame(rows, "session int, bin bigint, code int")
    out = states.enforce_min_duration(bins, ["session"], "bin", "code", 1.0, 4.0, chunks=3).orderBy("session", "bin").toPandas()
    for session, codes in want.items():
        assert out[out.session == session].code_smoothed.tolist() == codes


def test_select_partners_is_the_greedy_walk(spark):
    rng = np.random.default_rng(3)
    rows = [(0, int(a), int(b), float(p)) for a in range(30) for b in range(20) if (p := round(rng.random(), 2)) > 0.6]
    c = spark.createDataFrame(rows, "recording int, ref_unit bigint, other_unit bigint, p_avg double")
    c = matching.with_candidate_counts(c, ["recording"])
    got = matching.select_partners(c, ["recording"]).toPandas()
    free_a, free_b, taken = set(), {}, {}
    why = {}
    for _, a, b, p in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if a in free_a:
            why[a, b] = "not needed"
        elif b in free_b:
            why[a, b] = f"lost to unit {free_b[b]}"
        else:
            free_a.add(a)
            free_b[b] = a
            taken[a] = b
    chosen = got[got.chosen]
    assert dict(zip(chosen.ref_unit, chosen.other_unit)) == taken
    rest = got[~got.chosen]
    assert {(r.ref_unit, r.other_unit): r.reason for r in rest.itertuples()} == why


def test_otsu(spark):
    df = spark.createDataFrame([(v,) for v in [0.1, 0.12, 0.12, 0.2, 0.8, 0.82, 0.9]], "v double")
    assert find_bimodal_threshold(df, "v") == pytest.approx(0.5)
    with pytest.raises(ValueError):
        find_bimodal_threshold(df.where("v > 0.85"), "v")


def _ring_session(spark, n_bins=3000, n_units=16, seed=0):
    rng = np.random.default_rng(seed)
    heading = np.cumsum(rng.normal(0, 12, n_bins)) % 360
    preferred = np.arange(n_units) * 360 / n_units
    rate = 0.5 + 20 * np.exp(4 * (np.cos(np.radians(heading[:, None] - preferred)) - 1))
    counts = rng.poisson(rate * 0.1)
    rows = [(i, [int(x) for x in c], float(h), 0.1) for i, (c, h) in enumerate(zip(counts, heading))]
    bins = spark.createDataFrame(rows, "bin bigint, counts array<bigint>, heading double, dur double")
    return bins.withColumn("session", F.lit(1)), preferred, counts, heading


def test_decode_recovers_heading_and_chunks_agree(spark):
    bins, _p, counts, heading = _ring_session(spark, 900)
    model = de.fit_encoding_model(bins, ["session"], "counts", "heading", "dur", 36, 10.0, 0.1)
    t = de.ring_transition(36, 144.0)
    whole = de.decode(bins, model, ["session"], "bin", "counts", "dur", "heading", F.lit(True), t).orderBy("bin").toPandas()
    parts = de.decode(bins, model, ["session"], "bin", "counts", "dur", "heading", F.lit(True), t, chunk_bins=100).orderBy("bin").toPandas()
    assert parts["chunk"].nunique() == 9
    assert (whole.decoded_deg == parts.decoded_deg).all()
    np.testing.assert_allclose(whole.posterior_max, parts.posterior_max, atol=1e-9)
    assert np.median(np.abs(whole.error_deg)) < 12
    assert whole.n_spikes.tolist() == counts.sum(axis=1).tolist()


def test_pairwise_correlations_and_ring(spark):
    bins, preferred, counts, _h = _ring_session(spark)
    bins = bins.withColumn("kept", F.lit(True))
    got = pairs.pairwise_correlations(bins, ["session"], "bin", "counts", "dur", "kept", 0.0, 60, 30, block=500).toPandas()
    x = counts / 0.1
    zero = np.corrcoef(x, rowvar=False)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    shoulder = []
    for lag in range(30, 61):
        c = z[lag:].T @ z[:-lag] / (len(z) - lag)
        shoulder += [c, c.T]
    base = np.mean(shoulder, axis=0)
    for r in got.itertuples():
        assert r.zero_lag == pytest.approx(zero[r.i, r.j], abs=1e-9)
        assert r.baseline == pytest.approx(base[r.i, r.j], abs=1e-9)
    out = fit_ring(bins, ["session"], "bin", "counts", "dur", "kept", 0.0, 60, 30, k_neighbors=4, min_partner_snr=None)
    units = out["units"].toPandas().sort_values("unit")
    direct = np.abs(np.exp(1j * np.radians(units.angle_deg - preferred)).mean())
    mirrored = np.abs(np.exp(1j * np.radians(units.angle_deg + preferred)).mean())
    assert max(direct, mirrored) > 0.95
    assert (units.split_half_r > 0.5).all() and (units.coupling > 0).all()


def test_mds_recovers_points():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(12, 2))
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    q, values = ring.classical_mds(d)
    np.testing.assert_allclose(np.hypot(*(q[:, None] - q[None]).transpose(2, 0, 1)), d, atol=1e-9)
    assert values[0] >= values[1] > 0


def test_broadband_is_the_first_component(spark):
    rng = np.random.default_rng(0)
    latent = rng.normal(size=200)
    power = 10 ** (latent[:, None] * np.linspace(1, 0.2, 8) + rng.normal(0, 0.2, (200, 8)))
    s = spark.createDataFrame([(1, i, p.tolist()) for i, p in enumerate(power)], "session int, window bigint, power array<double>")
    out = lfp.broadband_slow_wave(s, ["session"], np.arange(1.0, 9.0), 3.0).orderBy("window").toPandas().broadband.to_numpy()
    z = (np.log10(power) - np.log10(power).mean(axis=0)) / np.log10(power).std(axis=0)
    w = np.linalg.svd(z, full_matrices=False)[2][0]
    pc = z @ w * np.sign(np.corrcoef(z @ w, z[:, :3].mean(axis=1))[0, 1])
    np.testing.assert_allclose(out, pc / pc.std(), atol=1e-6)


def test_bandpass_keeps_the_band():
    t = np.arange(4000) / 1000.0
    x = np.stack([np.sin(2 * np.pi * 50 * t), np.sin(2 * np.pi * 5 * t)], axis=1)
    y = lfp.zero_phase_bandpass(x, 1000.0, (30, 80))[1000:3000]
    np.testing.assert_allclose(y[:, 0], x[1000:3000, 0], atol=0.02)
    assert np.abs(y[:, 1]).max() < 1e-3


def test_spectrogram_blocks_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "frame bigint, x double")
    many = lfp.log_spectrogram(s, [], "frame", "x", 50.0, 2.0, 0.5, (1, 20), 6, per_block=3).orderBy("window").toPandas()
    one = lfp.log_spectrogram(s, [], "frame", "x", 50.0, 2.0, 0.5, (1, 20), 6, per_block=500).orderBy("window").toPandas()
    assert len(many) == 1 + (500 - 100) // 25
    np.testing.assert_allclose(np.stack(many.power), np.stack(one.power))


def test_causal_stream_matches_batch(spark, tmp_path):
    from ringtide.streaming.live import causal_heading

    bins, *_ = _ring_session(spark, 200)
    model = de.fit_encoding_model(bins, ["session"], "counts", "heading", "dur", 36, 10.0, 0.1)
    m = model.orderBy("unit", "angle_bin").toPandas()
    rates = m.rate_hz.to_numpy().reshape(-1, 36)
    t = de.ring_transition(36, 144.0)
    batch = de.decode(bins, model, ["session"], "bin", "counts", "dur", "heading", F.lit(True), t, acausal=False).orderBy("bin").toPandas()
    source = str(tmp_path / "in")
    for lo in (0, 100):
        bins.where((F.col("bin") >= lo) & (F.col("bin") < lo + 100)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(bins.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = (causal_heading(stream, "session", "bin", "counts", "dur", rates, t).writeStream.format("memory").queryName("live")
         .option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    live = spark.table("live").orderBy("bin").toPandas()
    assert live.decoded_deg.tolist() == batch.decoded_deg.tolist()
    np.testing.assert_allclose(live.posterior_max, batch.posterior_max, atol=1e-9)
