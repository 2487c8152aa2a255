"""Movement vetoes taken back and applied anew, and thresholds by recording."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringtide.operators import thresholds as th
from ringtide.plans.rescore import rescore_movement, undo_rescore
from ringtide.sources.versions import load_version, save_version, versions


def files(path):
    return {os.path.join(r, f): os.stat(os.path.join(r, f)).st_mtime_ns for r, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows_of(df):
    return sorted((r.session, r.bin, r.code, r.code_before) for r in df.collect())


def test_veto_is_undone_and_applied_again(spark, tmp_path):
    path = str(tmp_path / "scoring")
    bins = spark.createDataFrame([(s, i, 3, 3, None) for s in "ab" for i in range(300)], "session string, bin bigint, code int, code_before int, speed double")
    save_version(bins, path)
    before, other = rows_of(load_version(spark, path)), {f: t for f, t in files(path).items() if "session=b" in f}
    late = spark.createDataFrame([("a", i, 200.0 if 150 <= i < 250 else 0.01) for i in range(300)], "session string, bin bigint, speed double")
    right = spark.createDataFrame([("a", i, 200.0 if 100 <= i < 200 else 0.01) for i in range(300)], "session string, bin bigint, speed double")
    rescore_movement(spark, path, late, 1.0, 6.0)
    _, told = rescore_movement(spark, path, right, 1.0, 6.0)  # the second does not build on the first
    now = {(s, i): c for s, i, c, _ in rows_of(load_version(spark, path))}
    assert [i for i in range(300) if now["a", i] == 1] == list(range(100, 200)) and {now["b", i] for i in range(300)} == {3}
    assert told.count() == 1 and told.first().n_reassigned == 100 and told.first().applied
    assert {f: t for f, t in files(path).items() if "session=b" in f} == other
    assert sorted(map(tuple, versions(spark, path).collect())) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert rows_of(load_version(spark, path, version=1)) == before
    undo_rescore(spark, path, ["a"])
    assert rows_of(load_version(spark, path)) == before
    still = late.withColumn("speed", F.lit(None).cast("double"))
    _, told = rescore_movement(spark, path, still, 1.0)
    assert rows_of(load_version(spark, path)) == before and not told.first().applied and told.first().threshold_log10 is None
    kept, _ = rescore_movement(spark, path, late, 1.0, write=False)
    assert rows_of(load_version(spark, path)) == before and kept.where("code = 1").count() == 100
    with pytest.raises(ValueError, match="no sessions"):
        rescore_movement(spark, path, late.withColumn("session", F.lit("z")), 1.0)
    save_version(bins.where("session = 'a'").withColumn("code_before", F.lit(None).cast("int")), path)
    with pytest.raises(ValueError, match="code_before"):
        rescore_movement(spark, path, late, 1.0)


def test_thresholds_by_recording(spark):
    draw = random.Random(1)
    rows = [(s, draw.gauss(m, 0.3) if draw.random() < 0.5 else draw.gauss(m + d, 0.2)) for s, m, d in (("a", 0, 3), ("b", -2, 5), ("c", 1, 0)) for _ in range(400)]
    rows += [("few", float(i)) for i in range(4)] + [("flat", 2.0)] * 30 + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "s string, x double")
    found = {r.s: r.threshold for r in th.bimodal_thresholds(df, ["s"], "x").collect()}
    assert found["b"] == pytest.approx(th.bimodal_threshold(df.where("s = 'b'"), "x"), abs=1e-9)
    assert 0.6 < found["a"] < 2.4 and -1.4 < found["b"] < 2.4 and found["few"] == 1.5 and found["flat"] == 2.0
    speeds = df.withColumn("v", F.pow(F.lit(10.0), "x"))
    cuts = {r.s: r.threshold for r in th.automatic_thresholds(speeds, ["s"], "v", "min_speed_mm_s").collect()}
    assert cuts["few"] is None and cuts["a"] == pytest.approx(10 ** found["a"], rel=1e-6)
    a = np.array([x for s, x in rows if s == "a" and x is not None and x == x])
    fences = {r.s: r.threshold for r in th.automatic_thresholds(speeds, ["s"], "v", "max_turn").collect()}
    q1, q3 = np.percentile(a, [25, 75])
    assert fences["a"] == pytest.approx(10 ** (q3 + 1.5 * (q3 - q1)), rel=1e-9) and fences["few"] is None
    plain = {r.s: r.threshold for r in th.automatic_thresholds(df, ["s"], "x", "max_elevation_deg").collect()}
    assert plain["a"] == pytest.approx(q3 + 1.5 * (q3 - q1), rel=1e-9)
