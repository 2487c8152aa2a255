"""Decodes beside their nulls: shifts by recording, units left out, transfers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringtide.operators.decoding import default_variance, exchanged_models, shifted_bins
from ringtide.operators.nulls import draw_orders, draw_shifts, shifts_by_size
from ringtide.plans.decode_session import held_out, read_out, reference_decode, run_decoder, train_decoder, transfer_decoder
from ringtide.operators.decoding import ring_transition

NAMES = (["s"], "bin", "counts", "dur", "heading")


@pytest.fixture(scope="module")
def bins(spark):
    """Two recordings of unlike length; units 0 to 3 follow the heading, unit 4 does not."""
    rows = []
    for s, n in (("long", 400), ("short", 130)):
        rng = np.random.default_rng(n)
        heading = np.cumsum(rng.normal(0, 12, n)) % 360
        for i, h in enumerate(heading):
            rates = [0.3 + 6 * np.exp(3 * (np.cos(np.deg2rad(h - 90 * u)) - 1)) for u in range(4)] + [2.0]
            rows.append((s, i, [int(x) for x in rng.poisson(rates)], 1.0, float(h), i % 13 != 5))
    return spark.createDataFrame(rows, "s string, bin bigint, counts array<int>, dur double, heading double, wake boolean").repartition(3).cache()


def test_shifts_by_recording(bins):
    got = {(r.s, r.shuffle, r.bin): list(r.counts) for r in shifted_bins(bins, ["s"], "bin", "counts", shifts_by_size(5, 40, 3)).collect()}
    rows = {(r.s, r.bin): list(r.counts) for r in bins.collect()}
    want = {}
    for s, n in (("long", 400), ("short", 130)):
        for k, d in enumerate(draw_shifts(5, 40, n - 40, 3)):
            assert 40 <= d < n - 40
            want |= {(s, k, i): rows[s, (i - d) % n] for i in range(n)}
    assert got == want
    assert {r.s for r in shifted_bins(bins, ["s"], "bin", "counts", shifts_by_size(2, 65, 0)).collect()} == {"long"}


def test_refuses_recordings_without_room(bins):
    with pytest.raises(ValueError, match="short"):
        run_decoder(bins, *NAMES, F.col("wake"), {}, 24, 15.0, 0.1, 200.0, 20.0, n_shuffles=2, min_shift=65)


def test_exchanged_models_stay_inside_a_recording(spark):
    model = spark.createDataFrame([(s, u, a, float(10 * u + a)) for s, n in (("a", 5), ("b", 3)) for u in range(n) for a in range(2)],
                                  "s string, unit bigint, angle_bin bigint, rate_hz double")
    got = {(r.s, r.shuffle, r.unit, r.angle_bin): r.rate_hz for r in exchanged_models(model, ["s"], 4, 7).collect()}
    want = {(s, k, p, a): 10.0 * q + a for s, n in (("a", 5), ("b", 3)) for k, o in enumerate(draw_orders(4, n, 7)) for p, q in enumerate(o) for a in range(2)}
    assert got == want


def test_units_left_out_say_nothing(bins):
    """A decode with some units equals one of bins that hold only these units' counts."""
    full = held_out(bins, ["s"], "bin", "dur", F.col("wake"), 20.0).cache()
    curves = train_decoder(full, ["s"], "counts", "heading", "dur", 24, 15.0)
    sleep = {"REM": ~F.col("wake")}
    some = reference_decode(full, curves, curves.where("unit IN (0, 2)"), *NAMES, sleep, 24, 200.0, n_shuffles=3, min_shift=10, max_gap=40.0, min_run=0.0)
    only = full.withColumn("counts", F.array(F.col("counts")[0], F.col("counts")[2]))
    fewer = curves.where("unit IN (0, 2)").withColumn("unit", (F.col("unit") / 2).cast("bigint"))
    plain = read_out(only, fewer, *NAMES, F.coalesce("is_test", F.lit(False)), sleep, ring_transition(24, 200.0), 3, 10, max_gap=40.0, min_run=0.0)
    named = ["s", "state", "observed", "null_mean", "null_sd", "p_value", "n_bins"]
    got, want = (sorted((r.s, r.state, *[round(x, 9) for x in r[2:]]) for r in d.select(*named).collect()) for d in (some, plain))
    assert got == want and len(got) == 4
    assert {(r.label, r.n_units) for r in some.collect()} == {("baseline", 2)}


def test_transfer(bins):
    full = held_out(bins, ["s"], "bin", "dur", F.col("wake"), 20.0).cache()
    curves = train_decoder(full, ["s"], "counts", "heading", "dur", 24, 15.0)
    base = curves.where("s = 'long'").drop("s")
    pairs = bins.sparkSession.createDataFrame([("short", u, u) for u in range(4)], "s string, unit bigint, ref_unit bigint")
    got = transfer_decoder(base, pairs, bins.where("s = 'short'"), *NAMES, F.col("wake"), {}, 24, 200.0, n_shuffles=4, min_shift=20, min_run=0.0).collect()
    assert [(r.s, r.state, r.label, r.n_units, r.n_bins) for r in got] == [("short", "WAKE", "transfer", 4, 120)]
    assert got[0].observed < 40 < got[0].null_mean


def test_default_variance():
    assert default_variance(0.01) == 2.0 and abs(default_variance(1 / 60) - 10 / 3) < 1e-12
