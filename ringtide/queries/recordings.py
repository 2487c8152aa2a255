"""Queries: recordings as tables (channels, clocks, square waves, sessions, drift)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.angles import r6
from ..operators import channels as ch
from ..operators import drift as dr
from ..operators import split as sp
from ..operators import sync as sy
from ..operators import traces as tr
from . import bindings as b
from .registry import query

# ── channels ────────────────────────────────────────────────────────────
# suppliers are contact sites: three recordings (key mod 3) over a shared grid of places
_SITES = """si AS (SELECT s_suppkey AS channel, s_suppkey % 3 AS recording, (s_suppkey // 3) % 2 * 32.0 + (s_suppkey % 3) * 0.3 AS x, (s_suppkey // 6) * 20.0 + CASE WHEN s_suppkey % 7 = 0 AND s_suppkey % 3 > 0 THEN 5.0 ELSE 0.0 END AS y, s_acctbal AS gain FROM supplier)"""


def sites(spark, sf):
    s = b.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    third = F.floor(k / 3).cast("bigint")
    return s.select(
        k.alias("channel"), (k % 3).alias("recording"), ((third % 2) * 32.0 + (k % 3) * 0.3).alias("x"),
        (F.floor(k / 6) * 20.0 + F.when((k % 7 == 0) & (k % 3 > 0), 5.0).otherwise(0.0)).alias("y"), F.col("s_acctbal").alias("gain"))


@query("align_channels_by_location", f"""WITH {_SITES}, h AS (SELECT o.recording, r.channel AS site, o.channel, sqrt((o.x-r.x)*(o.x-r.x) + (o.y-r.y)*(o.y-r.y)) AS d FROM si r JOIN si o ON r.recording = 0 AND abs(o.y - r.y) <= 1 AND abs(o.x - r.x) <= 1),
m AS (SELECT recording, site, arg_min(channel, d) AS channel, min(d) AS d FROM h WHERE d <= 1.0 GROUP BY 1, 2),
k AS (SELECT site FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT recording) FROM si))
SELECT recording, site, channel, round(d, 6) AS residual, count(*) OVER (PARTITION BY recording, channel) = 1 AS one_to_one FROM m WHERE site IN (SELECT site FROM k)""")
def _(spark, sf):
    a = ch.align_channels_by_location(sites(spark, sf), "recording", "channel", 0)
    return a.select("recording", "site", "channel", r6("residual").alias("residual"), "one_to_one")


@query("check_gain_consistency", """WITH g AS (SELECT o_custkey AS channel, o_orderstatus AS recording, min(o_totalprice) AS gain FROM orders GROUP BY 1, 2)
SELECT g.recording, bool_and(abs(g.gain - r.gain) <= 1e-8 + 0.2 * abs(r.gain)) AS consistent, count(*) AS n_channels FROM g JOIN g r ON r.channel = g.channel AND r.recording = 'F' GROUP BY 1""")
def _(spark, sf):
    g = b.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("channel"), F.col("o_orderstatus").alias("recording")).agg(F.min("o_totalprice").alias("gain"))
    return ch.check_gain_consistency(g, "recording", "channel", "F", ["gain"], relative=0.2)


@query("resolve_bad_channels", """SELECT c_custkey AS row, c_name AS channel_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') OR c_name IN (SELECT c_name FROM customer WHERE c_acctbal < 0)""")
def _(spark, sf):
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("row"), F.col("c_name").alias("channel_id"))
    by_row = b.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("entry"), F.lit(True).alias("is_row"))
    by_id = b.table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_name").alias("entry"), F.lit(False).alias("is_row"))
    return ch.resolve_bad_channels(by_row.unionByName(by_id), c)


@query("unresolved_bad_channels", "SELECT CAST(l_partkey AS VARCHAR) AS entry FROM lineitem WHERE l_partkey NOT IN (SELECT c_custkey FROM customer)")
def _(spark, sf):
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("row"), F.col("c_name").alias("channel_id"))
    e = b.table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("entry"), F.lit(True).alias("is_row"))
    return ch.unresolved_bad_channels(e, c)


@query("bad_channel_union", """SELECT channel_id, string_agg(DISTINCT source, '+' ORDER BY source) AS source FROM (SELECT l_partkey AS channel_id, 'detected' AS source FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT l_partkey, 'manual' FROM lineitem WHERE l_tax > 0.07) GROUP BY 1""")
def _(spark, sf):
    li = b.table(spark, sf, "lineitem")
    key = F.col("l_partkey").alias("channel_id")
    return ch.bad_channel_union(li.where("l_discount > 0.09").select(key), li.where("l_tax > 0.07").select(key))


@query("pick_channels", """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey FROM r WHERE n <= 8 OR i IN (SELECT CAST(round_even((n-1)*k.range/7.0, 0) AS BIGINT) FROM range(8) k)""")
def _(spark, sf):
    p = b.table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    return ch.pick_channels(p, ["p_brand"], 8, ["p_retailprice", "p_partkey"]).select("p_brand", "p_partkey")


@query("drop_sync_channels", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'imec#SY' || p_size ELSE 'AP' || p_size END AS label FROM part WHERE p_size % 10 <> 0")
def _(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("imec#SY"), "p_size")).otherwise(F.concat(F.lit("AP"), "p_size")).alias("label"))
    return ch.drop_sync_channels(p, "label")


@query("interleave_channels", "SELECT p_partkey, CASE WHEN p_size > 5 THEN round(p_retailprice * 2, 6) ELSE p_retailprice END AS value, p_size AS position FROM part")
def _(spark, sf):
    p = b.table(spark, sf, "part")
    good = p.where("p_size > 5").select("p_partkey", r6(F.col("p_retailprice") * 2).alias("value"))
    bad = p.where("p_size <= 5").select("p_partkey", F.col("p_retailprice").alias("value"))
    return ch.interleave(good, bad, p.select("p_partkey", F.col("p_size").alias("position")), "p_partkey")


# ── analog channels ─────────────────────────────────────────────────────
_ADC = "ad AS (SELECT vec_id AS frame, generate_subscripts(embedding, 1) - 1 AS channel, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def adc(spark, sf):
    e = b.samples(spark, sf)
    return e.select("frame", F.posexplode("v").alias("channel", "v")).select("frame", F.col("channel").cast("bigint").alias("channel"), F.col("v").cast("double").alias("v"))


_ISO = _ADC + """, sp0 AS (SELECT channel, min(v) AS lo, max(v) AS hi FROM ad GROUP BY 1),
it AS (SELECT 0 AS k, channel, (lo + hi)/2 AS t, false AS done FROM sp0 WHERE hi > lo UNION ALL
 SELECT k + 1, channel, CASE WHEN abs(nt - t) <= 1e-8 + 1e-5*abs(t) THEN t ELSE nt END, abs(nt - t) <= 1e-8 + 1e-5*abs(t) FROM
 (SELECT it.k, it.channel, it.t, (avg(CASE WHEN v > t THEN v END) + avg(CASE WHEN v <= t THEN v END))/2 AS nt FROM it JOIN ad ON ad.channel = it.channel WHERE NOT it.done AND it.k < 50 GROUP BY 1, 2, 3)),
th AS (SELECT channel, arg_max(t, k) AS threshold FROM it GROUP BY 1)"""


@query("ttl_threshold", f"WITH RECURSIVE {_ISO} SELECT channel, round(threshold, 6) AS threshold FROM th")
def _(spark, sf):
    from ..operators.thresholds import two_level_thresholds

    t = two_level_thresholds(adc(spark, sf), ["channel"], "v")
    return t.select("channel", r6("threshold").alias("threshold"))


_DESCRIBE = _ISO + """, cl AS (SELECT ad.channel, frame, v, threshold, v > threshold AS above, avg(CASE WHEN v > threshold THEN v END) OVER w AS hi, avg(CASE WHEN v <= threshold THEN v END) OVER w AS lo,
 lead(v > threshold) OVER (PARTITION BY ad.channel ORDER BY frame) AS nx FROM ad JOIN th ON th.channel = ad.channel WINDOW w AS (PARTITION BY ad.channel)),
ds AS (SELECT channel, min(v) AS min, max(v) AS max, any_value(threshold) AS threshold, avg(CASE WHEN above THEN 1.0 ELSE 0.0 END) AS duty_cycle,
 avg(CASE WHEN v <= lo + 0.1*(hi-lo) THEN 1.0 ELSE 0.0 END + CASE WHEN v >= hi - 0.1*(hi-lo) THEN 1.0 ELSE 0.0 END) AS rail_fraction, CAST(sum(CASE WHEN above AND NOT nx THEN 1 ELSE 0 END) AS BIGINT) AS falling_edges, count(*) AS n_samples FROM cl GROUP BY 1)"""


@query("describe_analog_channels", f"""WITH RECURSIVE {_DESCRIBE} SELECT channel, round(min, 6) AS min, round(max, 6) AS max, round(threshold, 6) AS threshold, round(duty_cycle, 6) AS duty_cycle, round(rail_fraction, 6) AS rail_fraction,
 falling_edges, round(falling_edges / (n_samples / 100.0), 6) AS crossings_per_s, rail_fraction >= 0.52 AS looks_like_ttl FROM ds""")
def _(spark, sf):
    d = sy.describe_analog_channels(adc(spark, sf), ["channel"], "frame", "v", 100.0, 0.52)
    return d.select("channel", *[r6(c).alias(c) for c in ("min", "max", "threshold", "duty_cycle", "rail_fraction")],
                    "falling_edges", r6("crossings_per_s").alias("crossings_per_s"), "looks_like_ttl")


@query("pick_ttl_channel", f"WITH RECURSIVE {_DESCRIBE} SELECT channel, round(threshold, 6) AS threshold FROM ds WHERE rail_fraction >= 0.52")
def _(spark, sf):
    d = sy.describe_analog_channels(adc(spark, sf), ["channel"], "frame", "v", 100.0, 0.52)
    return sy.pick_ttl_channel(d, "channel").withColumn("threshold", r6("threshold"))


@query("shutter_close_times", f"""WITH {_ADC}, e AS (SELECT *, lag(v > 0.05) OVER (PARTITION BY channel ORDER BY frame) AS b FROM ad) SELECT channel, frame FROM e WHERE b AND NOT v > 0.05""")
def _(spark, sf):
    a = adc(spark, sf)
    fixed = a.select("channel").distinct().withColumn("threshold", F.lit(0.05))
    return sy.falling_edges(a, fixed, ["channel"], "frame", "v").select("channel", "frame")


@query("cross_check_frames", f"""WITH {b.SPIKES}, g AS (SELECT *, lead(us) OVER (PARTITION BY session ORDER BY us) - us AS d FROM sp),
a AS (SELECT session, count(*) AS n_detected, count(d) AS n_intervals, CAST(sum(CASE WHEN abs(d - {b.HOUR_US}) <= 0.2*{b.HOUR_US} THEN 1 ELSE 0 END) AS BIGINT) AS n_regular FROM g GROUP BY 1)
SELECT *, n_detected + session AS n_frames, session AS frame_count_difference, abs(session) < 0.01*(n_detected + session) AND n_intervals > 0 AND n_regular > 0.99*n_intervals AS plausible FROM a""")
def _(spark, sf):
    s = b.spikes(spark, sf)
    frames = s.groupBy("session").agg((F.count("*") + F.first("session")).alias("n_frames"), F.lit(b.HOUR_US).alias("period"))
    return sy.cross_check_frames(s, ["session"], "us", frames, "period")


@query("align_frames_to_events", f"""WITH {b.SPIKES}, e AS (SELECT session, us, event_id, row_number() OVER (PARTITION BY session ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY session) AS ne FROM sp WHERE kind <> 'error'),
f AS (SELECT session, us AS frame_us, event_id AS frame_event, row_number() OVER (PARTITION BY session ORDER BY us, event_id) - 1 AS j, count(*) OVER (PARTITION BY session) AS nf FROM sp)
SELECT e.session, e.event_id, j AS frame_index, frame_event FROM e JOIN f ON f.session = e.session AND j = i + nf - ne""")
def _(spark, sf):
    s = b.spikes(spark, sf)
    events = s.where("kind <> 'error'").select("session", "us", "event_id")
    frames = s.select("session", F.col("us").alias("frame_us"), F.col("event_id").alias("frame_event"))
    out = sy.align_frames_to_events(events, frames, ["session"], ["us", "event_id"], ["frame_us", "frame_event"])
    return out.select("session", "event_id", "frame_index", "frame_event")


@query("clock_report", f"""WITH {b.SPIKES}, a AS (SELECT session, min(us) AS t_first, max(us) AS t_last, count(*) AS n FROM sp GROUP BY 1)
SELECT session, t_first, t_last, n, round((n - 1)*{b.HOUR_US}.0/(t_last - t_first), 6) AS rate_per_hour, round((((n - 1)*{b.HOUR_US}.0/(t_last - t_first))/3.5 - 1)*1e6, 1) AS drift_ppm FROM a""")
def _(spark, sf):
    r = sy.clock_report(b.spikes(spark, sf), ["session"], "us", 3.5 / b.HOUR_US)
    return r.select("session", "t_first", "t_last", "n", r6(F.col("realised_rate") * b.HOUR_US).alias("rate_per_hour"), r6("drift_ppm", 1).alias("drift_ppm"))


@query("sync_clock_problem", """WITH t AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS t, lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
SELECT o_custkey, CASE WHEN arg_min(t, o_orderkey) < 0 THEN 'negative start' WHEN arg_max(t, o_orderkey) <= arg_min(t, o_orderkey) THEN 'does not advance' WHEN coalesce(bool_or(t <= p), false) THEN 'not increasing' END AS problem FROM t GROUP BY 1""")
def _(spark, sf):
    o = b.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"))
    return sy.sync_clock_problem(o, ["o_custkey"], "o_orderkey", "t")


@query("synced_times", f"""WITH {b.FRAMES}, st AS (SELECT unit_id, frame, us/1e6 AS t FROM fr WHERE NOT (unit_id % 5 = 0 AND kind = 'error')), g AS (SELECT unit_id, count(*) AS m FROM st GROUP BY 1), n AS (SELECT unit_id, count(*) AS n FROM fr GROUP BY 1)
SELECT fr.event_id, coalesce(n = m, false) AS synced, round(CASE WHEN n = m THEN st.t ELSE fr.frame/30.0 END, 6) AS t FROM fr JOIN n ON n.unit_id = fr.unit_id LEFT JOIN g ON g.unit_id = fr.unit_id LEFT JOIN st ON st.unit_id = fr.unit_id AND st.frame = fr.frame""")
def _(spark, sf):
    f = b.frames(spark, sf)
    stamps = f.where("NOT (unit_id % 5 = 0 AND kind = 'error')").select("unit_id", "frame", (F.col("us") / 1e6).alias("t"))
    out = sy.synced_times(f.select("event_id", "unit_id", "frame"), stamps, ["unit_id"], "frame", 30.0)
    return out.select("event_id", "synced", r6("t").alias("t"))


# ── sessions ────────────────────────────────────────────────────────────
# each nation is one session; its customers are the frames it contributes
_SESS = """sn AS (SELECT n_nationkey AS idx, n_name AS name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
so AS (SELECT *, CAST(sum(n) OVER (ORDER BY idx) - n AS BIGINT) AS "offset" FROM sn)"""


def sessions(spark, sf):
    n = b.table(spark, sf, "nation")
    c = b.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    s = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_nationkey").alias("idx"), F.col("n_name").alias("name"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return sp.cumulative_offsets(s, [], "idx", "n")


def bounds(spark, sf):
    return sessions(spark, sf).select("idx", "name", F.col("offset").alias("start"), (F.col("offset") + F.col("n")).alias("stop"))


@query("session_offsets", f"""WITH {_SESS} SELECT idx, name, n, "offset" FROM so""")
def _(spark, sf):
    return sessions(spark, sf)


@query("session_bounds", f"""WITH {_SESS}, l AS (SELECT idx, "offset" AS start, lead("offset") OVER (ORDER BY idx) AS stop FROM so) SELECT idx, start, stop FROM l WHERE stop IS NOT NULL""")
def _(spark, sf):
    return sp.session_bounds(sessions(spark, sf), [], "idx", "offset").select("idx", "start", "stop")


@query("split_recording", f"""WITH {_SESS} SELECT o_orderkey, idx, o_custkey - "offset" AS local_frame FROM orders JOIN so ON o_custkey >= "offset" AND o_custkey < "offset" + n""")
def _(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return sp.split_frames(o, bounds(spark, sf), [], "o_custkey", 64).select("o_orderkey", "idx", "local_frame")


@query("split_sorting", f"""WITH {_SESS}, u AS (SELECT DISTINCT o_orderpriority AS unit FROM orders), k AS (SELECT idx, o_orderpriority AS unit, count(*) AS n_spikes FROM orders JOIN so ON o_custkey >= "offset" AND o_custkey < "offset" + n GROUP BY 1, 2)
SELECT so.idx, u.unit, coalesce(n_spikes, 0) AS n_spikes FROM so CROSS JOIN u LEFT JOIN k ON k.idx = so.idx AND k.unit = u.unit""")
def _(spark, sf):
    o = b.table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("unit"))
    s = sp.split_frames(o, bounds(spark, sf), [], "o_custkey", 64)
    return sp.split_counts(s, o, bounds(spark, sf), "idx", "unit").select("idx", "unit", "n_spikes")


@query("split_states", f"""WITH {b.SPIKES}, {b.INTERVALS}, d AS (SELECT session, floor(us/86400000000.0) AS day, min(us) AS t0, max(us) AS t1 FROM sp GROUP BY 1, 2)
SELECT iv.session, span_id, t0, greatest(iv.start, t0) - t0 AS start, least(iv.stop, t1) - t0 AS stop FROM iv JOIN d ON d.session = iv.session AND greatest(iv.start, t0) < least(iv.stop, t1)""")
def _(spark, sf):
    day = F.floor(F.col("us") / 86_400_000_000.0)
    days = b.spikes(spark, sf).groupBy("session", day.alias("day")).agg(F.min("us").alias("start"), F.max("us").alias("stop"))
    out = sp.split_states(b.intervals(spark, sf), days.drop("day"), ["session"], 6 * b.HOUR_US)
    return out.select("session", "span_id", F.col("__t0").alias("t0"), "start", "stop")


@query("merge_to_concatenated_time", f"""WITH {b.SPIKES}, {b.INTERVALS}, t AS (SELECT session, session * 1000000000 AS t_start FROM (SELECT DISTINCT session FROM sp))
SELECT state, span_id, start + t_start AS start, stop + t_start AS stop FROM iv JOIN t ON t.session = iv.session""")
def _(spark, sf):
    t = b.spikes(spark, sf).select("session").distinct().withColumn("t_start", F.col("session") * 1_000_000_000)
    return sp.to_concatenated_time(b.intervals(spark, sf), t, ["session"]).select("state", "span_id", "start", "stop")


@query("session_timestamps", f"""WITH {_SESS} SELECT o_orderkey, round((o_custkey - "offset") / 30.0, 6) AS t_session, round(o_custkey / 30.0, 6) AS t_recording FROM orders JOIN so ON o_custkey >= "offset" AND o_custkey < "offset" + n""")
def _(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s = sp.split_frames(o, bounds(spark, sf), [], "o_custkey", 64)
    a = sp.timestamps(s, "local_frame", 30.0).withColumnRenamed("t", "t_session")
    return sp.timestamps(a, "local_frame", 30.0, "start").select("o_orderkey", r6("t_session").alias("t_session"), r6("t").alias("t_recording"))


@query("session_duration", f"""WITH {_SESS} SELECT idx, round("offset" / 30.0, 6) AS t_start, round(n / 30.0, 6) AS duration_s FROM so""")
def _(spark, sf):
    return sessions(spark, sf).select("idx", r6(F.col("offset") / 30.0).alias("t_start"), r6(F.col("n") / 30.0).alias("duration_s"))


# ── drift ───────────────────────────────────────────────────────────────
_SHIFT = f"""{b.SPIKES}, ds AS (SELECT session, CAST(floor(us/(6.0*{b.HOUR_US})) AS BIGINT) AS batch, unit_id % 9 AS section, avg(value) AS um FROM sp GROUP BY 1, 2, 3),
jn AS (SELECT DISTINCT session, batch - batch % 8 AS batch FROM ds)"""


@query("drift_at_junctions", f"""WITH {_SHIFT}, j AS (SELECT jn.session, jn.batch AS jb, ds.batch, um FROM jn JOIN ds ON ds.session = jn.session AND ds.batch BETWEEN jn.batch - 3 AND jn.batch + 3 AND ds.batch <> jn.batch),
sd AS (SELECT session, jb, avg(CASE WHEN batch > jb THEN spread END) AS tilt FROM (SELECT session, jb, batch, max(um) - min(um) AS spread FROM j GROUP BY 1, 2, 3) GROUP BY 1, 2),
a AS (SELECT session, jb, avg(CASE WHEN batch < jb THEN um END) AS pre, avg(CASE WHEN batch > jb THEN um END) AS post FROM j GROUP BY 1, 2)
SELECT a.session, a.jb AS junction, round(pre, 6) AS pre_mean_um, round(post, 6) AS post_mean_um, round(abs(post - pre), 6) AS step_um, round(abs(post - pre)/2.5, 6) AS step_in_row_pitch, round(tilt, 6) AS nonrigid_spread_um,
 CASE WHEN abs(post - pre) < 2.5 THEN 'negligible' WHEN abs(post - pre) <= 4 THEN 'correctable' WHEN abs(post - pre) <= 8 THEN 'marginal' ELSE 'beyond correction' END AS verdict FROM a JOIN sd ON sd.session = a.session AND sd.jb = a.jb WHERE pre IS NOT NULL AND post IS NOT NULL""")
def _(spark, sf):
    s = b.spikes(spark, sf)
    shifts = s.groupBy("session", F.floor(F.col("us") / (6.0 * b.HOUR_US)).cast("bigint").alias("batch"), (F.col("unit_id") % 9).alias("section")).agg(F.avg("value").alias("um"))
    j = shifts.select("session", (F.col("batch") - F.col("batch") % 8).alias("batch")).distinct().withColumn("junction", F.col("batch"))
    d = dr.drift_at_junctions(shifts, j, ["session"], 3, 4.0, 2.5)
    return d.select("session", "junction", *[r6(c).alias(c) for c in ("pre_mean_um", "post_mean_um", "step_um", "step_in_row_pitch", "nonrigid_spread_um")], "verdict")


@query("probe_row_pitch", """WITH y AS (SELECT DISTINCT p_brand, round(p_retailprice, 3) AS y FROM part) SELECT p_brand, round(min(d), 6) AS pitch FROM (SELECT p_brand, y - lag(y) OVER (PARTITION BY p_brand ORDER BY y) AS d FROM y) GROUP BY 1""")
def _(spark, sf):
    p = b.table(spark, sf, "part").select("p_brand", F.col("p_retailprice").alias("y"))
    return dr.probe_row_pitch(p, ["p_brand"]).select("p_brand", r6("pitch").alias("pitch"))


# ── traces ──────────────────────────────────────────────────────────────
@query("get_traces", """SELECT vec_id AS frame, round(embedding[3]::DOUBLE * 100, 6) AS v2, round(embedding[6]::DOUBLE * 100, 6) AS v5 FROM embeddings WHERE vec_id >= 50 AND vec_id < 350""")
def _(spark, sf):
    t = tr.get_traces(b.samples(spark, sf), "frame", 50, 350, {"v2": 2, "v5": 5}, gain=100.0)
    return t.select("frame", r6("v2").alias("v2"), r6("v5").alias("v5"))


@query("time_range_to_frames", """SELECT o_custkey, min(o_orderkey) AS first_frame, max(o_orderkey) + 1 AS stop_frame, count(*) AS n_frames FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-07-01' GROUP BY 1""")
def _(spark, sf):
    o = b.table(spark, sf, "orders")
    return tr.time_range_to_frames(o, ["o_custkey"], "o_orderdate", "o_orderkey", "1997-01-01", "1998-07-01")


@query("mean_trace", "SELECT vec_id AS frame, round(list_sum(embedding::DOUBLE[])/len(embedding), 6) AS mean FROM embeddings")
def _(spark, sf):
    return tr.mean_trace(b.samples(spark, sf), "v").select("frame", r6("mean").alias("mean"))


@query("traces_around_events", """WITH ev AS (SELECT label, min(vec_id) AS e FROM embeddings GROUP BY 1) SELECT ev.label AS session, vec_id AS frame, vec_id - e AS lag, round(embedding[1]::DOUBLE, 6) AS v FROM embeddings x JOIN ev ON ev.label = x.label AND vec_id BETWEEN e - 40 AND e + 40""")
def _(spark, sf):
    s = b.samples(spark, sf)
    events = s.groupBy("session").agg(F.min("frame").alias("at"))
    out = tr.around_events(s, events, ["session"], "frame", "at", 40)
    return out.select(F.col("session").cast("int").alias("session"), "frame", "lag", r6(F.col("v")[0].cast("double")).alias("v"))


@query("slice_to_states", f"""WITH {b.STATE_BINS}, d AS (SELECT *, CASE WHEN code IS DISTINCT FROM lag(code) OVER (PARTITION BY session ORDER BY bin) THEN 1 ELSE 0 END AS ch FROM sb),
g AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY bin) AS run FROM d), e AS (SELECT session, run, min(bin) AS start, max(bin) + 1 AS stop FROM g WHERE code = 1 GROUP BY 1, 2 HAVING max(bin) + 1 - min(bin) >= 2),
k AS (SELECT sp.* FROM sp JOIN e ON e.session = sp.session AND us / {b.HOUR_US}.0 >= start AND us / {b.HOUR_US}.0 < stop)
SELECT event_id, session, row_number() OVER (PARTITION BY session ORDER BY us, event_id) - 1 AS new_frame FROM k""")
def _(spark, sf):
    from ..operators.runs import state_epochs

    bins = b.state_bins(spark, sf).withColumn("t", F.col("bin") + 0.5)
    spans = state_epochs(bins, ["session"], "bin", "t", "code", 1.0).where("code = 1")
    s = b.spikes(spark, sf).withColumn("h", F.col("us") / float(b.HOUR_US))
    out = tr.slice_to_spans(s, spans, ["session"], "h", ["us", "event_id"], 2.0, 6.0)
    return out.select("event_id", "session", "new_frame")


@query("minimal_paths", """WITH p AS (SELECT DISTINCT regexp_replace(url, '/+$', '') AS path FROM pages UNION SELECT DISTINCT regexp_replace(regexp_replace(url, '/[^/]*$', ''), '/+$', '') FROM pages WHERE page_id % 3 = 0)
SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.path <> p.path AND starts_with(p.path, q.path || '/'))""")
def _(spark, sf):
    from ..operators.paths import minimal_cover

    p = b.table(spark, sf, "pages")
    stem = F.regexp_replace("url", "/+$", "")
    parent = F.regexp_replace(F.regexp_replace("url", "/[^/]*$", ""), "/+$", "")
    paths = p.select(stem.alias("path")).unionByName(p.where("page_id % 3 = 0").select(parent.alias("path"))).distinct()
    return minimal_cover(paths, "path")


