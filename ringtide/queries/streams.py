"""Queries: flat recordings written and read back, stamps, filter chains, resampling, sampled spectra, spike positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.angles import r6
from ..operators import channel_search as cs
from ..operators import filters, locations
from ..operators.scan import number_rows
from ..operators.traces import mean_trace
from ..plans.preprocess import load_concatenated, preprocess
from ..scale import shared_folder
from ..sources.flat_writer import write_stamps, write_traces
from ..sources.streams import Stream, concatenated_sync_times, microvolts, open_stream
from . import bindings as b
from .registry import query
from .signals import CHANNELS, FREQS, N_FREQS, RANGE, _inside, _interpolation

FS, GAIN = 32.0, 0.25
COUNTS = "list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1000) AS BIGINT))"
_FRAMES = f"fr AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS frame, vec_id, label, {COUNTS} AS v FROM embeddings)"


def frames(spark, sf):
    """Embeddings as frames 0 to n-1 of whole numbers."""
    e = b.table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)).alias("v"))
    return number_rows(e, [], ["vec_id"], "frame")


def stored(spark, sf) -> Stream:
    """The frames as a flat file of all channels, written by tasks."""
    path = f"{shared_folder(spark, 'stream')}/traces.bin"
    write_traces(frames(spark, sf), path, CHANNELS)
    return Stream("probe", path, FS, [f"AP{i}" for i in range(CHANNELS)], [GAIN] * CHANNELS, [0.0] * CHANNELS, [((i % 2) * 32.0, (i // 2) * 20.0) for i in range(CHANNELS)])


@query("open_stream", f"""WITH {_FRAMES} SELECT frame, frame / {FS}::DOUBLE AS t, c.range AS channel, v[c.range + 1] * {GAIN}::DOUBLE AS uv FROM fr, range({CHANNELS}) c""")
def _(spark, sf):
    stream = stored(spark, sf)
    return open_stream(spark, stream).select("frame", "t", F.posexplode(microvolts(stream)).alias("channel", "uv")).withColumn("channel", F.col("channel").cast("bigint"))


@query("concatenated_sync_times", f"""WITH {b.SPIKES} SELECT row_number() OVER (ORDER BY session, us, event_id) - 1 AS frame, us / 1000000.0::DOUBLE AS t FROM sp""")
def _(spark, sf):
    s = number_rows(b.spikes(spark, sf), ["session"], ["us", "event_id"], "frame").select("session", "frame", (F.col("us") / F.lit(1e6)).alias("t"))
    folder = shared_folder(spark, "stamps")
    counts = {r["session"]: r["n"] for r in s.groupBy("session").agg(F.count("*").alias("n")).collect()}
    streams = []
    for session in sorted(counts):
        write_stamps(s.where(F.col("session") == session), f"{folder}/{session}.npy")
        streams.append(Stream(str(session), "", 1.0, ["c"], [None], [0.0], times=f"{folder}/{session}.npy"))
    return concatenated_sync_times(spark, streams, [counts[k] for k in sorted(counts)])


BAD = [3, 10]
_GOOD = [i for i in range(CHANNELS) if i not in BAD]


@query("common_reference", f"""WITH {_FRAMES}, m AS (SELECT frame, v, list_aggregate(list_transform({[i + 1 for i in _GOOD]}, lambda i: v[i]::DOUBLE), 'median') AS m FROM fr)
SELECT frame, c.range AS channel, CASE WHEN c.range IN ({', '.join(map(str, BAD))}) THEN v[c.range + 1]::DOUBLE ELSE v[c.range + 1] - m END AS x FROM m, range({CHANNELS}) c""")
def _(spark, sf):
    steps = filters.steps_of({"common_reference": {"operator": "median"}}, FS, _GOOD)
    out = filters.apply_preprocessing(frames(spark, sf), [], "frame", "v", steps, _GOOD, 128)
    return out.select("frame", F.posexplode("v").alias("channel", "x")).withColumn("channel", F.col("channel").cast("bigint"))


@query("preprocess", f"""WITH {_FRAMES}, n AS (SELECT count(*) AS n FROM fr), r AS (SELECT frame + k.range * n AS frame, v, list_aggregate(list_transform({[i + 1 for i in _GOOD]}, lambda i: v[i]::DOUBLE), 'avg') AS m FROM fr, n, range(2) k)
SELECT frame, frame / {FS}::DOUBLE AS t, c.range AS channel, CASE WHEN c.range IN ({', '.join(map(str, BAD))}) THEN v[c.range + 1] ELSE CAST(round_even(v[c.range + 1] - m, 0) AS BIGINT) END AS x FROM r, range({CHANNELS}) c""")
def _(spark, sf):
    stream, folder = stored(spark, sf), shared_folder(spark, "concatenated")
    preprocess(spark, [stream, stream], folder, {"common_reference": {"operator": "average"}}, bad=[f"AP{i}" for i in BAD])
    samples, _info = load_concatenated(spark, folder)
    return samples.select("frame", "t", F.posexplode("v").alias("channel", "x")).select("frame", "t", F.col("channel").cast("bigint").alias("channel"), F.col("x").cast("bigint").alias("x"))


RATIO, REACH = 4, 40


@query("resample_to", f"""WITH {_FRAMES}, x AS (SELECT frame, list_sum(v)::DOUBLE / {CHANNELS} AS x FROM fr), tp AS (SELECT t.range AS k, 0.9 * t.range / {RATIO} AS a FROM range(-{REACH}, {REACH + 1}) t),
w AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE sin(pi() * a) / (pi() * a) END * pow(cos(pi() * k / {REACH + 1} / 2), 2) AS w FROM tp), nw AS (SELECT k, w / (SELECT sum(w) FROM w) AS w FROM w)
SELECT o.frame // {RATIO} AS frame, round(sum(x.x * w), 6) + 0.0 AS x FROM x o, nw JOIN x ON x.frame = o.frame + k WHERE o.frame % {RATIO} = 0 GROUP BY 1""")
def _(spark, sf):
    x = mean_trace(frames(spark, sf), "v").select("frame", F.array("mean").alias("x"))
    out, _rate = filters.resample_to(x, [], "frame", "x", FS, FS / RATIO, 32)
    return out.select("frame", r6(F.col("x")[0]).alias("x"))


SLOTS, N_WINDOW, MOST = [0, 5, 9], 64, 6
_WINDOWS = f"""n AS (SELECT count(*) AS n FROM fr), nn AS (SELECT n, least({MOST}, greatest(n // {N_WINDOW}, 2)) AS m FROM n WHERE n >= {2 * N_WINDOW}),
wn AS (SELECT w.range AS win, CASE WHEN w.range = m - 1 THEN n - {N_WINDOW} - 1 ELSE CAST(trunc(w.range * ((n - {N_WINDOW} - 1) / (m - 1)::DOUBLE)) AS BIGINT) END AS lo FROM nn, range({MOST}) w WHERE w.range < m)"""
_SAMPLED = f"""WITH {_FRAMES}, {_WINDOWS},
sg AS (SELECT win, c.slot, frame - lo AS k, v[c.slot + 1] * (0.5 - 0.5*cos(2*pi()*(frame - lo)/{N_WINDOW - 1})) AS v FROM wn JOIN fr ON frame >= lo AND frame < lo + {N_WINDOW}, (VALUES {', '.join(f'({c})' for c in SLOTS)}) c(slot)),
ft AS (SELECT win, slot, q.range AS f, pow(sum(v*cos(2*pi()*k*q.range/{N_WINDOW})), 2) + pow(sum(v*sin(2*pi()*k*q.range/{N_WINDOW})), 2) AS p FROM sg, range({N_WINDOW // 2 + 1}) q GROUP BY 1, 2, 3),
ip(i, f, w) AS (VALUES {_interpolation()}), pw AS (SELECT win, slot, i, sum(p*w) AS p FROM ft JOIN ip ON ip.f = ft.f GROUP BY 1, 2, 3)"""


def sampled(spark, sf):
    """Spectra of windows spread through the flat file; the tasks read the windows only."""
    stream = stored(spark, sf)
    total = stream.frames()
    starts = cs.window_starts(total, N_WINDOW, MOST) if total >= 2 * N_WINDOW else []
    samples = open_stream(spark, stream, ranges=cs.window_ranges(starts, N_WINDOW) or [(0, 0)])
    return cs.sampled_spectra(samples, "frame", "v", SLOTS, starts, FS, N_WINDOW, RANGE, N_FREQS)


@query("sampled_spectra", f"{_SAMPLED} SELECT CAST(win AS INTEGER) AS \"window\", CAST(slot AS INTEGER) AS slot, i AS freq_index, round(log10(p), 6) AS log_power FROM pw")
def _(spark, sf):
    s = sampled(spark, sf).select("window", "slot", F.posexplode("power").alias("freq_index", "p"))
    return s.select("window", "slot", "freq_index", r6(F.log10("p")).alias("log_power"))


@query("channel_theta_signal", f"{_SAMPLED} SELECT CAST(slot AS INTEGER) AS slot, CAST(win AS INTEGER) AS \"window\", round(log10(sum(p) FILTER (i IN ({_inside((5, 10))})) / sum(p) FILTER (i IN ({_inside((2, 13))}))), 6) + 0.0 AS value FROM pw GROUP BY 1, 2")
def _(spark, sf):
    return cs.derived_signal(sampled(spark, sf), FREQS, "theta", 4.0, (5, 10), (2, 13)).withColumn("value", r6("value"))


@query("spike_locations", """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey, l_quantity ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem),
p AS (SELECT l_partkey, l_quantity, l_extendedprice AS x, l_suppkey AS y, row_number() OVER (PARTITION BY l_partkey, l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, x, y FROM s JOIN p USING (l_partkey, l_quantity, k)""")
def _(spark, sf):
    li = b.table(spark, sf, "lineitem")
    spikes = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    found = li.select("l_partkey", "l_quantity", "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), F.col("l_suppkey").alias("y"))
    out = locations.matched_locations(spikes, found, ["l_partkey", "l_quantity"], ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_orderkey", "l_linenumber"], ["x", "y"])
    return out.select("l_orderkey", "l_linenumber", "x", "y")


@query("fit_cut_gaussian", """WITH h AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT p_brand, count(*) AS bins, max(n) AS top FROM h GROUP BY 1)
SELECT p_brand, bins >= 4 AS enough, bins >= 4 AS inside, bins >= 4 AS better FROM s""")
def _(spark, sf):
    """Fits of part sizes by brand: inside their bounds, and no worse than where they started."""
    h = b.table(spark, sf, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("x")).agg(F.count("*").cast("double").alias("n"))
    low, high = [0.0, 0.0, 0.5, 0.0], [1e6, 60.0, 200.0, 30.0]
    start = h.groupBy("p_brand").agg(F.max("n").alias("top"), F.min_by("x", F.struct(-F.col("n"), "x")).alias("at"), F.count("*").alias("bins"))
    start = start.select("p_brand", "bins", F.array("top", "at", F.lit(10.0), F.lit(0.0)).alias("p0"), F.array(*map(F.lit, low)).alias("low"), F.array(*map(F.lit, high)).alias("high"))
    fitted = locations.fit_cut_gaussian(h, ["p_brand"], "x", "n", start)
    both = h.join(fitted, "p_brand").join(start, "p_brand")
    z = (F.col("x") - F.col("centre")) / F.col("sigma")
    model = F.when(F.col("x") < F.col("cut"), 0.0).otherwise(F.col("amplitude") * F.exp(-0.5 * z * z))
    first = F.col("p0")[0] * F.exp(-0.5 * F.pow((F.col("x") - F.col("p0")[1]) / F.col("p0")[2], 2))
    cost = both.groupBy("p_brand").agg(F.sum(F.pow(F.col("n") - model, 2)).alias("own"), F.sum(F.pow(F.col("n") - first, 2)).alias("start"), F.first("bins").alias("bins"),
                                       *[F.first(c).alias(c) for c in ("amplitude", "centre", "sigma", "cut")])
    inside = F.lit(True)
    for i, c in enumerate(("amplitude", "centre", "sigma", "cut")):
        inside = inside & F.col(c).between(low[i], high[i])
    return cost.select("p_brand", (F.col("bins") >= 4).alias("enough"), F.coalesce(inside, F.lit(False)).alias("inside"), F.coalesce(F.col("own") <= F.col("start") * (1 + 1e-9), F.lit(False)).alias("better"))
