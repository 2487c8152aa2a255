"""Readers and writers, against files built here."""

import numpy as np
import pytest

from ringtide.operators.paths import minimal_cover
from ringtide.sources import catalog, store
from ringtide.sources.binary import read_traces
from ringtide.sources.tracking_csv import load_tracking, read_body_track, rigid_body_names


def test_binary_ranges(spark, tmp_path):
    data = np.random.default_rng(0).integers(-3000, 3000, (5000, 6)).astype("<i2")
    path = tmp_path / "traces.bin"
    data.tofile(path)
    samples = read_traces(spark, str(path), 6, 100.0, frames_per_partition=700)
    assert samples.count() == 5000
    rows = samples.where("frame >= 1234 AND frame < 1300").orderBy("frame").collect()
    assert [r["frame"] for r in rows] == list(range(1234, 1300))
    assert rows[0]["v"] == data[1234].tolist() and rows[0]["t"] == 12.34
    with pytest.raises(Exception, match="whole frames"):
        read_traces(spark, str(path), 7, 100.0).count()


def _tracking(path, bodies, n=12, markers=True):
    types, names, kinds, axes = ["", ""], ["", ""], ["", ""], ["Frame", "Time (Seconds)"]
    for body, parts in bodies.items():
        for kind, letters in parts.items():
            for a in letters:
                types.append("Rigid Body"), names.append(body), kinds.append(kind), axes.append(a)
    if markers:
        types.append("Rigid Body Marker"), names.append("m1"), kinds.append("Position"), axes.append("X")
    values = np.random.default_rng(1).normal(0, 100, (n, len(types) - 2)).round(6)
    rows = [["Format Version", "1.23"], [], types, names, ["", ""], ["", ""], kinds, axes]
    rows += [[str(i), f"{i / 100}", *map(str, v)] for i, v in enumerate(values)]
    path.write_text("\n".join(",".join(r) for r in rows) + "\n")
    return values


def test_tracking_csv(spark, tmp_path):
    path = tmp_path / "take.csv"
    full = {"Rotation": "XYZW", "Position": "XYZ"}
    values = _tracking(path, {"head": full, "box": {"Position": "XYZ"}})
    assert rigid_body_names(spark, str(path)) == ["head", "box"]
    rows = load_tracking(spark, str(path)).where("body = 'head'").orderBy("frame").collect()
    assert len(rows) == 12
    assert [rows[3][c] for c in ("qx", "qw", "px", "pz")] == [values[3][i] for i in (0, 3, 4, 6)]
    box = read_body_track(spark, str(path), "box").orderBy("frame").collect()
    assert box[5]["py"] == values[5][8]
    with pytest.raises(ValueError, match="name one"):
        read_body_track(spark, str(path))
    with pytest.raises(ValueError, match="no body"):
        read_body_track(spark, str(path), "tail")


def test_catalog():
    names = ["imec0.ap", "imec0.lf", "nidq", "imec0.ap-SYNC"]
    assert catalog.only_stream(names, "meta") == "imec0.ap"
    assert catalog.only_stream(names, "meta", "adc") == "nidq"
    other = ["x.ProbeA", "x.ProbeA-LFP", "x.ProbeA-ADC", "y.PXIe"]
    assert catalog.only_stream(other, "structured") == "x.ProbeA"
    assert catalog.only_stream(other, "structured", "lf") == "x.ProbeA-LFP"
    assert catalog.only_stream(["y.PXIe"], "structured", "lf") is None
    with pytest.raises(ValueError):
        catalog.only_stream(["a.ap", "b.ap"], "meta")


def test_tuning_store(spark, tmp_path):
    stats = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, 0.1)], "unit_id bigint, mean_vector_length double")
    curves = spark.createDataFrame([(1, 0, 2.0), (2, 0, 1.0)], "unit_id bigint, angle_bin bigint, hz double")
    depths = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "unit_id bigint, depth double")
    path = str(tmp_path / "tuning")
    store.save_hd_tuning(path, stats, curves, depths)
    loaded, c = store.load_hd_tuning(spark, path)
    assert sorted(r["unit_id"] for r in loaded.collect()) == [1, 2]
    assert loaded.select("weakly_tuned").first()[0] is None and c.count() == 2
    twin = {r["unit_id"]: r["mean_vector_length"] for r in spark.read.json(path + "/stats_json").collect()}
    assert twin == {1: 0.5, 2: None}
    with pytest.raises(ValueError, match="not empty"):
        store.prepare_output(spark, path)


def test_scoring_store(spark, tmp_path):
    bins = spark.createDataFrame([("a", 0, 1), ("b", 0, 3)], "session string, bin bigint, code int")
    summary = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "session string, step_s double")
    path = str(tmp_path / "scoring")
    store.save_scoring(bins, summary, path)
    one, _ = store.load_scoring(spark, path, "b")
    assert [r["code"] for r in one.collect()] == [3]
    with pytest.raises(ValueError, match="name one"):
        store.load_scoring(spark, path)


def test_label_table(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("unit_id,auto_label,prob\n3,good,0.5\n10,,x\n")
    rows = {r["unit_id"]: r for r in store.read_label_table(spark, str(path), ["prob"]).collect()}
    assert rows[3]["prob"] == 0.5 and rows[10]["prob"] is None and rows[10]["auto_label"] == ""


def test_minimal_cover(spark):
    paths = spark.createDataFrame([("/a/b",), ("/a/b/c",), ("/a/bc",), ("/x",), ("/x/y/z",)], "p string")
    assert sorted(r[0] for r in minimal_cover(paths, "p").collect()) == ["/a/b", "/a/bc", "/x"]
