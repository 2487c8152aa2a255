"""Streams, stamps, the flat writer, filter chains, resampling and the channel search, against plain arrays."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringtide.operators import channel_search as cs
from ringtide.operators import filters
from ringtide.plans import preprocess as pre
from ringtide.sources import streams
from ringtide.sources.flat_writer import write_traces

DRAW = np.random.default_rng(3)


def meta_folder(root, name="run_t0.imec0.ap", channels=5, n=4000, fs=30000.0, sites=True, gain=500):
    data = DRAW.integers(-400, 400, (n, channels)).astype("<i2")
    data.tofile(root / f"{name}.bin")
    names = [f"AP{i}" for i in range(channels - 1)] + ["SY0"]
    lines = ["typeThis=imec", f"nSavedChans={channels}", f"imSampRate={fs}", "imAiRangeMax=0.6", "imMaxInt=512",
             "~snsChanMap=(4,1,1)" + "".join(f"({c};{i}:{i})" for i, c in enumerate(names)),
             "~imroTbl=(0,384)" + "".join(f"({i} 0 0 {gain} 250 1)" for i in range(channels - 1))]
    if sites:
        lines.append("~snsGeomMap=(NP1000,1,0,70)" + "".join(f"(0:{27 + 32 * (i % 2)}:{20 * i}:1)" for i in range(channels - 1)))
    (root / f"{name}.meta").write_text("\n".join(lines) + "\n")
    return data


def structured_folder(root, n=3000, channels=4, stamps=None, name="Acq.ProbeA"):
    place = root / "rec" / "continuous" / name
    place.mkdir(parents=True)
    data = DRAW.integers(-400, 400, (n, channels)).astype("<i2")
    data.tofile(place / "continuous.dat")
    if stamps is not None:
        np.save(place / "timestamps.npy", stamps)
    rows = [{"channel_name": f"CH{i}", "bit_volts": 0.195, "position": [0.0, 20.0 * i]} for i in range(channels)]
    (root / "rec" / "structure.oebin").write_text(json.dumps({"continuous": [{"folder_name": name + "/", "sample_rate": 1000.0, "channels": rows}]}))
    return data


def as_array(df):
    rows = df.orderBy("frame").collect()
    assert [r.frame for r in rows] == list(range(len(rows)))
    return np.array([r.v for r in rows]), np.array([r.t for r in rows]) if "t" in df.columns else None


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_meta_stream(spark, tmp_path, scheme):
    data = meta_folder(tmp_path)
    stream = streams.find_stream(scheme + str(tmp_path))
    assert stream.name == "imec0.ap" and stream.channels[-1] == "SY0" and stream.fs == 30000
    got, t = as_array(streams.open_stream(spark, stream, frames_per_partition=700))
    assert (got == data).all() and np.allclose(t, np.arange(4000) / 30000, atol=0)
    table = {r.channel_id: r for r in streams.channel_table(spark, stream).collect()}
    assert math.isclose(table["AP0"].gain, 1e6 * 0.6 / 512 / 500) and table["AP1"].x == 59 and table["SY0"].gain is None and table["SY0"].x is None
    some = streams.open_stream(spark, stream).where("frame < 3").select(streams.microvolts(stream).alias("u")).first().u
    assert some[-1] is None and math.isclose(some[0], data[0, 0] * table["AP0"].gain)
    assert streams.find_stream(str(tmp_path), band="adc") is None
    with pytest.raises(ValueError, match="named"):
        streams.find_stream(str(tmp_path), "other")


def test_ranges_and_filters_narrow_what_is_read(spark, tmp_path):
    data = meta_folder(tmp_path)
    stream = streams.find_stream(str(tmp_path))
    some = streams.open_stream(spark, stream, ranges=[(10, 20), (3990, 5000)])
    assert some.rdd.getNumPartitions() == 2
    assert [r.frame for r in some.orderBy("frame").collect()] == [*range(10, 20), *range(3990, 4000)]
    filtered = streams.open_stream(spark, stream, frames_per_partition=500).where("frame >= 1400 AND frame < 1600")
    assert filtered.rdd.getNumPartitions() == 1 and [r.v for r in filtered.orderBy("frame").collect()] == data[1400:1600].tolist()
    assert streams.open_stream(spark, stream).where("frame > 4000").count() == 0
    with open(stream.binary, "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="whole frames"):
        streams.open_stream(spark, stream).count()


def test_structured_stream_and_stamps(spark, tmp_path):
    stamps = np.cumsum(DRAW.uniform(0.0009, 0.0011, 3000)) + 77
    data = structured_folder(tmp_path, stamps=stamps)
    stream = streams.find_stream(str(tmp_path))
    got, t = as_array(streams.open_stream(spark, stream, frames_per_partition=999))
    assert (got == data).all() and (t == stamps).all()
    assert as_array(streams.open_stream(spark, stream, "uniform"))[1][5] == 0.005
    assert [r.t for r in streams.stream_timestamps(spark, stream).orderBy("frame").collect()] == stamps.tolist()
    both = streams.concatenated_sync_times(spark, [stream, stream], [3000, 3000])
    assert [r.t for r in both.orderBy("frame").collect()] == [*stamps, *stamps] and both.agg(F.max("frame")).first()[0] == 5999
    assert streams.concatenated_sync_times(spark, [stream, stream], [3000, 2999]) is None
    assert streams.concatenated_sync_times(spark, [stream], [3000, 1]) is None and streams.concatenated_sync_times(spark, [], []) is None
    np.save(stream.times, stamps[:-1])
    with pytest.raises(Exception, match="2999 stamps"):
        streams.open_stream(spark, stream).count()
    bare = tmp_path / "bare"
    bare.mkdir()
    structured_folder(bare)
    assert streams.stream_timestamps(spark, streams.find_stream(str(bare))) is None
    with pytest.raises(ValueError, match="no recording layout"):
        (tmp_path / "void").mkdir()
        streams.find_stream(str(tmp_path / "void"))


def test_array_headers(tmp_path):
    for x in (np.arange(7, dtype="i8"), np.arange(5, dtype="f4"), np.zeros(0)):
        np.save(tmp_path / "x.npy", x)
        f = streams.NpyFile(str(tmp_path / "x.npy"))
        assert f.length == len(x) and (f.read(0, len(x)) == x).all()
    for bad in (np.zeros((2, 2)), np.array(["a"]), np.arange(3, dtype=">i4")):
        np.save(tmp_path / "y.npy", bad)
        with pytest.raises(ValueError, match="no vector"):
            streams.NpyFile(str(tmp_path / "y.npy"))
    np.save(tmp_path / "z.npy", np.arange(100.0))
    whole = (tmp_path / "z.npy").read_bytes()
    (tmp_path / "z.npy").write_bytes(whole[:-9])
    with pytest.raises(ValueError, match="ends before"):
        streams.NpyFile(str(tmp_path / "z.npy"))


def samples_of(spark, x, parts=5):
    return spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "frame long, v array<double>").repartition(parts)


def test_flat_writer(spark, tmp_path):
    x = DRAW.integers(-32768, 32768, (5000, 3)).astype("<i2")
    path = tmp_path / "out" / "flat.bin"
    write_traces(samples_of(spark, x), str(path), 3)
    assert (np.fromfile(path, "<i2").reshape(-1, 3) == x).all()
    with pytest.raises(Exception, match="exists"):
        write_traces(samples_of(spark, x), str(path), 3)
    write_traces(samples_of(spark, x[:10] + 0.5), str(path), 3, overwrite=True)
    assert (np.fromfile(path, "<i2").reshape(-1, 3) == np.clip(np.rint(x[:10] + 0.5), -32768, 32767)).all()
    write_traces(samples_of(spark, x[:0]), "file://" + str(tmp_path / "none.bin"), 3)
    assert (tmp_path / "none.bin").stat().st_size == 0
    whole = samples_of(spark, x[:100])
    for rows, why in ((whole.where("frame <> 40"), "40 is missing"), (whole.union(whole.where("frame = 7")), "twice"),
                      (whole.withColumn("v", F.when(F.col("frame") == 9, F.slice("v", 1, 2)).otherwise(F.col("v"))), "without 3"),
                      (whole.withColumn("frame", F.col("frame") + 1), "0 is missing")):
        with pytest.raises(Exception, match=why):
            write_traces(rows, str(tmp_path / "bad.bin"), 3)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none.bin", "out"]
    with pytest.raises(Exception, match="mounted"):
        write_traces(whole, "s3://x/y", 3)


def plain_chain(x, steps):
    for s in steps:
        if isinstance(s, filters.Filter):
            k = np.broadcast_to(s.kernel.reshape(len(s.kernel), -1), (len(s.kernel), x.shape[1]))
            x = np.stack([np.convolve(x[:, c], k[:, c])[s.reach:s.reach + len(x)] for c in range(x.shape[1])], axis=1)
        else:
            x = x - (np.median(x, axis=1) if s.kind == "median" else x.mean(axis=1))[:, None]
    return x


@pytest.mark.parametrize("block", [64, 1000, 1 << 14])
def test_chain_equals_plain_arrays(spark, block):
    x = DRAW.normal(0, 100, (2600, 6)) + 3000
    x[:, 4] = -30690  # a broken channel
    good = [0, 1, 2, 3, 5]
    steps = filters.steps_of({"phase_shift": {"shifts": [0, 0.2, 0.4, 0.6, 0.8, 0.1]}, "highpass_filter": {"freq_min": 60.0}, "common_reference": {}}, 1000.0, good)
    steps.append(filters.Filter(filters.zero_phase_kernel(1000.0, 50.0, 200.0)))
    both = samples_of(spark, x).withColumn("session", F.lit("a")).union(samples_of(spark, x[:700]).withColumn("session", F.lit("b")))
    out = filters.apply_preprocessing(both, ["session"], "frame", "v", steps, good, block)
    for session, raw in (("a", x), ("b", x[:700])):
        got, _ = as_array(out.where(F.col("session") == session))
        assert (got[:, 4] == -30690).all()
        assert np.allclose(got[:, good], plain_chain(raw[:, good], steps), atol=1e-7)


def test_filter_responses_and_refusals():
    t = np.arange(6000) / 1000.0
    fast, slow = np.sin(2 * np.pi * 150 * t), np.sin(2 * np.pi * 5 * t) + 9
    high = filters.Filter(filters.zero_phase_kernel(1000.0, 60.0, None))
    y = high((fast + slow)[:, None])[500:-500, 0]
    assert np.abs(y - fast[500:-500]).max() < 0.03
    shifted = filters.Filter(filters.delay_kernels([0.3]))(np.sin(2 * np.pi * 20 * t)[:, None])[100:-100, 0]
    assert np.abs(shifted - np.sin(2 * np.pi * 20 * (t + 0.0003))[100:-100]).max() < 1e-3
    for bad in ({"other": {}}, {"common_reference": {"operator": "max"}}, {"highpass_filter": {"freq": 3}}, {"highpass_filter": {"freq_min": 600.0}}):
        with pytest.raises(ValueError):
            filters.steps_of(bad, 1000.0, [0])


@pytest.mark.parametrize(("fs", "rate", "outputs"), [(3000.0, 125.0, 7), (1000.0, 300.0, 4096), (2500.0, 1250.0, 64)])
def test_resampling(spark, fs, rate, outputs):
    from fractions import Fraction

    n = 2900
    t = np.arange(n) / fs
    x = np.stack([np.sin(2 * np.pi * 0.2 * rate * t), np.sin(2 * np.pi * 0.8 * rate * t), np.ones(n)], axis=1)
    out, got_rate = filters.resample_to(samples_of(spark, x), [], "frame", "v", fs, rate, outputs)
    got, _ = as_array(out)
    ratio = Fraction(fs) / Fraction(rate)
    reach, weights = filters.resampling_weights(ratio)
    padded = np.pad(x, ((reach, reach), (0, 0)))
    want = np.array([weights[k % ratio.denominator] @ padded[int(k * ratio):int(k * ratio) + 2 * reach + 1] for k in range(math.floor((n - 1) / ratio) + 1)])
    assert got_rate == rate and got.shape == want.shape and np.allclose(got, want, atol=1e-9)
    inner = slice(15, -15)
    k = np.arange(len(got))
    assert np.abs(got[inner, 0] - np.sin(2 * np.pi * 0.2 * k)[inner]).max() < 0.02  # passed
    assert np.abs(got[inner, 1]).max() < 0.02 and np.allclose(got[inner, 2], 1)  # no alias, level kept
    same, kept = filters.resample_to(samples_of(spark, x), [], "frame", "v", fs, fs * 2)
    assert kept == fs and same.count() == n  # never filled up


def test_channel_search(spark, tmp_path):
    """A stream whose channels 2 and 5 alternate between two states; only the windows are read."""
    fs, n = 100, 60_000
    t = np.arange(n) / fs
    state = (t // 60) % 2
    x = DRAW.normal(0, 100, (n, 8))
    for c in (2, 5):
        x[:, c] += 1500 * state * np.sin(2 * np.pi * 3 * t + c)
    np.clip(np.rint(x), -32768, 32767).astype("<i2").tofile(tmp_path / "a.bin")
    stream = streams.Stream("a", str(tmp_path / "a.bin"), fs, [f"c{i}" for i in range(8)], [1.0] * 8, [0.0] * 8)
    n_window = 2 * fs
    starts = cs.window_starts(n, n_window, 60)
    assert len(starts) == 60 and starts[0] == 0 and starts[-1] == n - n_window - 1
    ranges = cs.window_ranges(starts, n_window)
    samples = streams.open_stream(spark, stream, ranges=ranges)
    assert samples.count() == 60 * n_window < n  # what the tasks read
    slots = cs.candidates(8, 2, exclude=[0], step=1)
    freqs = cs.lfp.log_frequencies((1.0, 40.0), 20)
    spectra = cs.sampled_spectra(samples, "frame", "v", slots, starts, fs, n_window, (1.0, 40.0), 20).cache()
    rows = {(r.window, r.slot): r.power for r in spectra.collect()}
    raw = np.fromfile(tmp_path / "a.bin", "<i2").reshape(-1, 8)
    for w, c in ((0, 1), (17, 2), (59, 7)):
        power = np.abs(np.fft.rfft(raw[starts[w]:starts[w] + n_window, c] * np.hanning(n_window))) ** 2
        assert np.allclose(rows[w, c], np.interp(freqs, np.fft.rfftfreq(n_window, 1 / fs), power))
    ranked = cs.rank_channels(spectra, freqs, "slow_wave", 10.0).cache()
    assert {r.slot for r in ranked.where("position < 2").collect()} == {2, 5} and ranked.count() == 7
    assert [r.slot for r in cs.pick_bimodal(ranked, 2, 8, [0]).collect()] == [2, 5]
    assert [r.slot for r in cs.pick_bimodal(ranked.withColumn("score", F.lit(None).cast("double")), 3, 8, [0]).collect()] == [1, 4, 7]
    theta = cs.rank_channels(spectra, freqs, "theta", theta_band=(2, 4), theta_ref_band=(1, 12))
    assert {r.slot for r in theta.where("position < 2").collect()} == {2, 5}
    with pytest.raises(ValueError, match="signal"):
        cs.rank_channels(spectra, freqs, "other")
    with pytest.raises(ValueError, match="too few"):
        cs.window_starts(100, 60)
    assert cs.candidates(8, 20) == list(range(8)) and cs.candidates(8, 3, step=4) == list(range(8)) and cs.candidates(8, 2, step=4) == [0, 4]


def test_preprocess_and_load(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    one, two = meta_folder(tmp_path / "a", n=1200, fs=1000.0), meta_folder(tmp_path / "b", n=900, fs=1000.0)
    found = [streams.find_stream(str(tmp_path / f)) for f in "ab"]
    info = pre.preprocess(spark, found, str(tmp_path / "out"), {"highpass_filter": {"freq_min": 60.0}, "common_reference": {}}, bad=["AP2"])
    assert info.channels == ["AP0", "AP1", "AP2", "AP3"] and info.removed_sync == ["SY0"] and info.num_samples == [1200, 900]
    samples, loaded = pre.load_concatenated(spark, str(tmp_path / "out"))
    got, t = as_array(samples)
    assert loaded == info and t[2000] == 2.0
    steps = filters.steps_of(info.steps, 1000.0, [0, 1, 3])
    want = np.concatenate([one[:, :4], two[:, :4]]).astype(float)
    for span in (slice(0, 1200), slice(1200, 2100)):
        want[span][:, [0, 1, 3]] = plain_chain(want[span][:, [0, 1, 3]], steps)
    assert np.abs(got - want).max() <= 0.5 + 1e-6 and (got[:, 2] == want[:, 2]).all()
    (tmp_path / "c").mkdir()
    meta_folder(tmp_path / "c", fs=1000.0, gain=250)
    for others, why in (([found[0], streams.find_stream(str(tmp_path / "c"))], "gains"), ([], "nothing")):
        with pytest.raises(ValueError, match=why):
            pre.preprocess(spark, others, str(tmp_path / "no"))
    with pytest.raises(ValueError, match="no channels"):
        pre.preprocess(spark, found, str(tmp_path / "no"), bad=["XX"])
    stamps = np.arange(3000) * 0.001 + 5
    (tmp_path / "d").mkdir()
    structured_folder(tmp_path / "d", stamps=stamps)
    probe = streams.find_stream(str(tmp_path / "d"))
    pre.preprocess(spark, [probe, probe], str(tmp_path / "out2"))
    again, _ = pre.load_concatenated(spark, str(tmp_path / "out2"))
    assert (as_array(again)[1] == np.concatenate([stamps, stamps])).all()
