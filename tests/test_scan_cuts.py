"""Scans give the same answers however often their order is cut."""

import datetime as dt
import decimal
import math

import pytest

from ringtide import scale
from ringtide.operators import decoding, joins, masks, scan

DAY = dt.date(2020, 1, 1)
ORDERS = {
    "double": [None, *[i / 3 for i in range(60)], math.nan],
    "bigint": [None, *range(-30, 31)],
    "string": [None, "", *[f"key{i % 7}{chr(97 + i % 26)}{i}" for i in range(60)], "é", "日本"],
    "date": [None, *[DAY + dt.timedelta(days=i) for i in range(60)]],
    "timestamp": [None, *[dt.datetime(2020, 1, 1) + dt.timedelta(minutes=7 * i) for i in range(60)]],
    "timestamp_ntz": [None, *[dt.datetime(2020, 1, 1) + dt.timedelta(minutes=7 * i) for i in range(60)]],
    "boolean": [None, False, True],
}


@pytest.mark.parametrize("kind", ORDERS)
def test_cut_and_uncut_agree(spark, kind):
    values = ORDERS[kind]
    rows = [(i % 2, v, i, None if i % 3 else i) for i, v in enumerate(values)] + [(0, values[len(values) // 2], 1000 + i, i) for i in range(40 if kind == "bigint" else 0)]
    df = spark.createDataFrame(rows, f"k int, t {kind}, id bigint, x bigint").repartition(5)
    specs = {"before": scan.previous("x"), "after": scan.following("x"), "last": scan.last_valid("x"), "next": scan.next_valid("x"), "at": scan.position()}
    found = [sorted(map(str, scan.scan(df, ["k"], ["t", "id"], specs, chunks).collect())) for chunks in (1, 4, 64)]
    assert found[0] == found[1] == found[2]
    if kind != "boolean":
        single = df.where("id < 1000")
        found = [sorted(map(str, scan.scan(single, ["k"], ["t"], specs, chunks).collect())) for chunks in (1, 4, 64)]
        assert found[0] == found[1] == found[2]


TIED = {
    "string": [f"session-{i:03d}" for i in range(20)] + ["session-", "session-é", None],
    "binary": [f"session-{i:03d}".encode() for i in range(20)] + [b"", None],
    "timestamp_ntz": [dt.datetime(2020, 1, 1, 0, 0, 5, i * 40_000) for i in range(20)] + [None],
    "timestamp": [dt.datetime(2020, 1, 1, 0, 0, 5, i * 40_000) for i in range(20)],
    "bigint": [2**60 + i for i in range(20)] + [-(2**62), None],
    "decimal(38,0)": [decimal.Decimal(10**30 + i) for i in range(20)],
}


@pytest.mark.parametrize("second", ["string", "double"])
@pytest.mark.parametrize("kind", TIED)
def test_values_that_share_a_place_on_the_axis(spark, kind, second):
    """Leading values that a cut cannot tell apart, and a second column that runs against them."""
    make = {"bigint": lambda i: -i, "string": lambda i: f"same prefix {999 - i}", "double": lambda i: math.nan if i % 7 == 0 else -i / 3,
            "timestamp_ntz": lambda i: dt.datetime(2021, 1, 1) - dt.timedelta(milliseconds=i)}[second]
    rows = [(i % 2, v, None if n == 3 else make(n * 40 + i), n * 40 + i) for i, v in enumerate(TIED[kind]) for n in range(10)]
    df = spark.createDataFrame(rows, f"k int, t {kind}, u {second}, id bigint").repartition(5)
    specs = {"before": scan.previous("id"), "after": scan.following("id"), "sum": scan.running_sum("id"), "at": scan.position()}
    found = [sorted(map(str, scan.scan(df, ["k"], ["t", "u", "id"], specs, chunks).collect())) for chunks in (1, 16)]
    assert found[0] == found[1]
    cuts = scan.plan_cuts(df, ["t", "u", "id"], 16)
    sizes = [r["count"] for r in scan.with_chunks(df, ["t", "u", "id"], cuts)[0].groupBy(scan.CHUNK).count().collect()]
    assert max(sizes) < len(rows) / 3  # the tied values do not stay in one piece


@pytest.mark.parametrize("chunks", [1, 4])
def test_other_second_orders_are_refused(spark, chunks):
    df = spark.createDataFrame([(1, 2, [2]), (1, 2, [3])], "k int, t int, u array<int>")
    with pytest.raises(TypeError):
        scan.scan(df, ["k"], ["t", "u"], {"at": scan.position()}, chunks)


@pytest.mark.parametrize("chunks", [1, 4])
def test_other_orders_are_refused(spark, chunks):
    df = spark.createDataFrame([(1, [2]), (1, [3])], "k int, t array<int>")
    with pytest.raises(TypeError):
        scan.scan(df, ["k"], ["t"], {"at": scan.position()}, chunks)


@pytest.mark.parametrize("chunks", [1, 4])
def test_times_before_any_span(spark, chunks):
    points = spark.createDataFrame([(0, float(t)) for t in (1, 10, 15, 20, 26, 40)] + [(0, None)], "s int, t double")
    spans = spark.createDataFrame([(0, 10.0, 20.0), (0, 12.0, 13.0), (0, 25.0, 30.0), (0, None, 99.0)], "s int, start double, stop double")
    got = {r.t: r.since for r in masks.seconds_since(points, spans, ["s"], "t", chunks=chunks).collect()}
    assert got == {1.0: None, 10.0: 0.0, 15.0: 0.0, 20.0: 0.0, 26.0: 0.0, 40.0: 10.0, None: None}
    hit = joins.asof_join(points, spans, ["s"], "t", "start", ["stop"], chunks=chunks).collect()
    assert {r.t: r.stop for r in hit}[1.0] is None


def test_frames_per_bin(spark):
    rows = [(0, i * 0.01) for i in range(50)] + [(1, i / 120) for i in range(50)] + [(2, i * 3.0) for i in range(9)]
    frames = spark.createDataFrame(rows, "s int, t double")
    found = {r.s: r.per_bin for r in decoding.frames_per_bin(frames, ["s"], "t", 0.0499).collect()}
    assert found == {0: 5, 1: 6, 2: 1}


def test_cached_rows_of_unknown_size_are_counted(spark):
    df = spark.range(1000).withColumn("x", scan.F.col("id") * 2).cache()
    assert scale.chunk_count(df) == 1  # nothing has filled the cache, so there is no estimate
    assert scan.number_rows(df, [], ["id"], "at").where("at <> id").isEmpty()
