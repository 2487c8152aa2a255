"""Queries: lookups, stored scorings, tables behind figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.angles import r6
from ..operators import display as di
from ..operators import runs, states
from ..operators.scan import number_rows
from ..scale import written
from . import bindings as b
from .registry import query
from .tuning import CURVES, curves


# ── stored scorings ─────────────────────────────────────────────────────
@query("scoring_signals", f"""WITH {b.STATE_BINS} SELECT session, bin, signal, value FROM (SELECT session, bin, broadband, theta, emg, speed FROM sb) UNPIVOT (value FOR signal IN (broadband, theta, emg, speed))""")
def _(spark, sf):
    s = b.state_bins(spark, sf)
    return s.unpivot(["session", "bin"], ["broadband", "theta", "emg", "speed"], "signal", "value").where("value IS NOT NULL")


@query("scoring_names", f"WITH {b.STATE_BINS} SELECT session, bin, CASE WHEN n = 1 THEN '?' ELSE CASE code WHEN 1 THEN 'WAKE' WHEN 3 THEN 'NREM' WHEN 5 THEN 'REM' ELSE '?' END END AS state FROM sb")
def _(spark, sf):
    s = b.state_bins(spark, sf)
    return s.select("session", "bin", states.state_name(F.when(F.col("n") == 1, 9).otherwise(F.col("code"))).alias("state"))


_VETO = b.STATE_BINS + ", vt AS (SELECT session, bin, code AS before, CASE WHEN code IN (3, 5) AND coalesce(speed > 1000, false) THEN 1 ELSE code END AS after FROM sb)"


def vetoed(spark, sf):
    return states.apply_movement_veto(b.state_bins(spark, sf), ["session"], "bin", "code", "speed", 3.0, 1.0, 1.0)


@query("vetoed", f"WITH {_VETO} SELECT session, bin, before <> after AS vetoed FROM vt")
def _(spark, sf):
    return vetoed(spark, sf).select("session", "bin", (F.col("code_before") != F.col("code_after")).alias("vetoed"))


@query("vetoed_epochs", f"""WITH {_VETO}, m AS (SELECT *, CASE WHEN before <> after THEN before END AS c FROM vt), d AS (SELECT *, CASE WHEN c IS DISTINCT FROM lag(c) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM m WINDOW w AS (PARTITION BY session ORDER BY bin)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY bin) AS run FROM d) SELECT session, CAST(c AS INT) AS code, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS n_bins FROM g WHERE c IS NOT NULL GROUP BY session, c, run""")
def _(spark, sf):
    v = vetoed(spark, sf).withColumn("c", F.when(F.col("code_before") != F.col("code_after"), F.col("code_before")))
    e = runs.state_epochs(v.withColumn("t", F.col("bin") + 0.5), ["session"], "bin", "t", "c", 1.0).where("c IS NOT NULL")
    return e.select("session", F.col("c").cast("int").alias("code"), "first_bin", "last_bin", "n_bins")


@query("state_fractions", f"WITH {b.STATE_BINS} SELECT session, round(avg(CASE WHEN code = 1 THEN 1.0 ELSE 0.0 END), 6) AS wake, round(avg(CASE WHEN code = 3 THEN 1.0 ELSE 0.0 END), 6) AS nrem, round(avg(CASE WHEN code = 5 THEN 1.0 ELSE 0.0 END), 6) AS rem FROM sb GROUP BY 1")
def _(spark, sf):
    s = b.state_bins(spark, sf)
    return s.groupBy("session").agg(*[r6(F.avg((F.col("code") == c).cast("double"))).alias(n.lower()) for n, c in states.STATE_CODES.items()])


@query("bins_in_interval_mask", f"""WITH {b.FRAMES}, m AS (SELECT *, CASE WHEN lead(value) OVER w IS NOT NULL THEN value > 1 AND lead(value) OVER w > 1 END AS ok FROM fr WINDOW w AS (PARTITION BY unit_id ORDER BY frame))
SELECT unit_id, frame // 4 AS bin, bool_and(ok) AS kept FROM m WHERE ok IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 4""")
def _(spark, sf):
    f = b.frames(spark, sf).withColumn("m", F.col("value") > 1)
    f = runs.intervals_between_frames(f, ["unit_id"], ["frame"], "m", "ok").where("ok IS NOT NULL")
    out = f.groupBy("unit_id", F.floor(F.col("frame") / 4).cast("bigint").alias("bin")).agg(F.bool_and("ok").alias("kept"), F.count("*").alias("n"))
    return out.where("n = 4").drop("n")


@query("state_interval_mask", f"""WITH {b.SPIKES}, {b.INTERVALS}, h AS (SELECT DISTINCT session, CAST(floor(us/{b.HOUR_US}.0) AS BIGINT) * {b.HOUR_US} AS edge FROM sp), s AS (SELECT session, start, max(stop) AS stop FROM iv WHERE state = 'signup' GROUP BY 1, 2),
k AS (SELECT h.session, edge, coalesce(edge < stop, false) AS ok FROM h ASOF LEFT JOIN s ON s.session = h.session AND edge >= start) SELECT session, edge, ok AND lead(ok) OVER w AS kept FROM k WINDOW w AS (PARTITION BY session ORDER BY edge) QUALIFY lead(ok) OVER w IS NOT NULL""")
def _(spark, sf):
    from ..operators.masks import frames_in_states

    edges = b.spikes(spark, sf).select("session", (F.floor(F.col("us") / b.HOUR_US).cast("bigint") * b.HOUR_US).alias("edge")).distinct()
    out = frames_in_states(edges, b.intervals(spark, sf), ["session"], "edge", ["edge"], ["signup"])
    return out.where("interval_kept IS NOT NULL").select("session", "edge", F.col("interval_kept").alias("kept"))


# ── lookups ─────────────────────────────────────────────────────────────
@query("restrict_units", f"WITH {CURVES} SELECT cv.unit_id, angle_bin, round(hz, 6) AS hz FROM cv WHERE unit_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60)")
def _(spark, sf):
    wanted = b.spikes(spark, sf).where("kind = 'error' AND value > 60").select("unit_id").distinct()
    return curves(spark, sf).join(wanted, "unit_id", "left_semi").select("unit_id", "angle_bin", r6("hz").alias("hz"))


@query("missing_units", "SELECT l_suppkey + 50 AS unit_id, count(*) AS n FROM lineitem WHERE l_suppkey + 50 NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def _(spark, sf):
    want = b.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") + 50).alias("unit_id")).agg(F.count("*").alias("n"))
    return want.join(b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit_id")), "unit_id", "left_anti")


@query("unit_depths", "SELECT s_suppkey AS unit_id, CAST(s_nationkey AS BIGINT) AS depth, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def _(spark, sf):
    s, n, r = (b.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("s_suppkey").alias("unit_id"), F.col("s_nationkey").cast("bigint").alias("depth"), "r_name")


@query("stream_start_time", "SELECT user_id, arg_min(epoch_us(ts), event_id) AS start_us FROM events GROUP BY 1")
def _(spark, sf):
    return b.spikes(spark, sf).groupBy(F.col("unit_id").alias("user_id")).agg(F.min_by("us", "event_id").alias("start_us"))


@query("check_source_rows", "SELECT count(*) AS n_different FROM (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount < 0.09 EXCEPT ALL SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.07 THEN l_quantity + 1 ELSE l_quantity END FROM lineitem WHERE l_discount < 0.09)")
def _(spark, sf):
    li = b.table(spark, sf, "lineitem").where("l_discount < 0.09")
    a = li.select("l_orderkey", "l_linenumber", "l_quantity")
    c = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0.07, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("l_quantity"))
    return a.exceptAll(c).agg(F.count("*").alias("n_different"))


@query("stream_candidates", """SELECT page_id, regexp_matches(lower(url), '[-_.]adc$') AS adc, regexp_matches(lower(url), '[-_.](lfp|lf)$') AS lf, ends_with(lower(url), '.html') AS leaf FROM pages""")
def _(spark, sf):
    from ..sources.catalog import band_of

    p = b.table(spark, sf, "pages")
    return p.select("page_id", band_of("url", "adc").alias("adc"), band_of("url", "lf").alias("lf"), F.lower("url").endswith(".html").alias("leaf"))


@query("distinct_names", "SELECT source, min(doc_id) AS first_seen, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    return b.table(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("first_seen"), F.count("*").alias("n"))


@query("recording_ranks", "SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS position, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer")
def _(spark, sf):
    c = b.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    n = c.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return number_rows(c, ["c_mktsegment"], ["c_acctbal", "c_custkey"], "position").join(n, "c_mktsegment").drop("c_acctbal")


@query("standardised_radius", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand))/nullif(stddev_pop(p_retailprice) OVER (PARTITION BY p_brand), 0), 6) + 0.0 AS radius_z FROM part")
def _(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    s = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s"))
    return p.join(s, "p_brand").select("p_partkey", r6((F.col("p_retailprice") - F.col("m")) / F.when(F.col("s") > 0, F.col("s"))).alias("radius_z"))


# ── behind figures ──────────────────────────────────────────────────────
_LINE = b.FRAMES + """, ln AS (SELECT *, us - lag(us) OVER w > 43200000000 AS br, heading - lag(heading) OVER w AS st, lag(heading) OVER w AS ph, lag(us) OVER w AS pu FROM fr WINDOW w AS (PARTITION BY unit_id ORDER BY frame))"""


def _line(spark, sf):
    from ..operators.scan import previous, scan

    f = b.frames(spark, sf).select("unit_id", "frame", "us", "heading")
    f = scan(f, ["unit_id"], ["frame"], {"pu": previous("us")})
    return f.withColumn("br", F.col("us") - F.col("pu") > 43_200_000_000)


@query("break_at", f"WITH {_LINE} SELECT unit_id, frame, 1 AS part, round(heading, 6) AS heading FROM ln UNION ALL SELECT unit_id, frame, 0, NULL FROM ln WHERE ph IS NOT NULL AND (br OR abs(st) > 180)")
def _(spark, sf):
    out = di.break_at(_line(spark, sf), ["unit_id"], "frame", "heading", F.col("br"))
    return out.select("unit_id", "frame", "part", r6("heading").alias("heading"))


@query("wrap_through", f"""WITH {_LINE}, c AS (SELECT unit_id, frame, heading, ph, st < 0 AS up FROM ln WHERE abs(st) > 180 AND NOT br),
e AS (SELECT *, CASE WHEN up THEN 360.0 ELSE 0.0 END AS lv, frame - 1 + ((CASE WHEN up THEN 360.0 ELSE 0.0 END) - ph)/((CASE WHEN up THEN heading + 360 ELSE heading - 360 END) - ph) AS x FROM c)
SELECT unit_id, frame::DOUBLE AS x, 3 AS part, round(heading, 6)::DOUBLE AS heading FROM ln UNION ALL SELECT unit_id, round(x, 6), p.range::INT, CASE p.range WHEN 0 THEN lv WHEN 2 THEN 360 - lv END::DOUBLE FROM e, range(3) p""")
def _(spark, sf):
    line = _line(spark, sf).withColumn("x", F.col("frame").cast("double"))
    out = di.wrap_through(line, ["unit_id"], "x", "heading", F.col("br"))
    return out.select("unit_id", r6("x").alias("x"), "part", r6("heading").alias("heading"))


@query("on_decoded_axis", f"""WITH {b.SPIKES}, h AS (SELECT session, CAST(floor(us/{b.HOUR_US}.0) AS BIGINT) AS bin, count(*) AS n FROM sp GROUP BY 1, 2), a AS (SELECT session, bin * {b.HOUR_US} AS start, (bin + 1) * {b.HOUR_US} AS stop, (row_number() OVER (PARTITION BY session ORDER BY bin) - 1) * {b.HOUR_US} AS axis FROM h WHERE n >= 4)
SELECT event_id, axis + us - start AS axis FROM sp JOIN a ON a.session = sp.session AND us >= start AND us < stop""")
def _(spark, sf):
    s = b.spikes(spark, sf)
    h = s.groupBy("session", F.floor(F.col("us") / b.HOUR_US).cast("bigint").alias("bin")).agg(F.count("*").alias("n")).where("n >= 4")
    h = number_rows(h, ["session"], ["bin"], "i")
    bins = h.select("session", (F.col("bin") * b.HOUR_US).alias("start"), ((F.col("bin") + 1) * b.HOUR_US).alias("stop"), (F.col("i") * b.HOUR_US).alias("axis"))
    return di.on_decoded_axis(s, bins, ["session"], "us").select("event_id", "axis")


@query("unit_raster", "SELECT event_id, s_name AS label, s_acctbal AS preferred FROM events JOIN supplier ON CAST(s_suppkey AS VARCHAR) = CAST(user_id AS VARCHAR)")
def _(spark, sf):
    units = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit_id"), F.col("s_name").alias("label"), F.col("s_acctbal").alias("preferred"))
    return di.unit_raster(b.spikes(spark, sf), units, "unit_id").select("event_id", "label", "preferred")


@query("closed_curves", f"WITH {CURVES} SELECT unit_id, (angle_bin + 0.5)*10.0::DOUBLE AS deg, round(hz, 6) AS hz FROM cv UNION ALL SELECT unit_id, d, round(avg(hz), 6) FROM cv, (VALUES (0.0::DOUBLE), (360.0::DOUBLE)) v(d) WHERE angle_bin IN (0, 35) GROUP BY 1, 2")
def _(spark, sf):
    out = di.closed_curves(curves(spark, sf), ["unit_id"], 36, "hz")
    return out.select("unit_id", "deg", r6("hz").alias("hz"))


@query("gaussian_cut", "SELECT event_id, round(CASE WHEN value < 3 THEN 0.0 ELSE 2.5*exp(-0.5*((value-10)/4.0)*((value-10)/4.0)) END, 6) AS y FROM events")
def _(spark, sf):
    return b.spikes(spark, sf).select("event_id", r6(di.gaussian_cut("value", 2.5, 10.0, 4.0, 3.0)).alias("y"))


@query("amplitude_histogram", "WITH s AS (SELECT event_type AS kind, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY event_type)) SELECT kind, CAST(least(floor((value - lo)/((hi - lo)/25)), 24) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY 1, 2")
def _(spark, sf):
    return di.histogram(b.spikes(spark, sf), ["kind"], "value", 25).select("kind", "bin", "n")


@query("unit_location_data", "SELECT user_id AS unit_id, CAST(s_nationkey AS BIGINT) AS depth, round(log10(count(*)/30.0), 6) AS log_rate FROM events JOIN supplier ON s_suppkey = user_id GROUP BY 1, 2")
def _(spark, sf):
    s = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit_id"), F.col("s_nationkey").cast("bigint").alias("depth"))
    n = b.spikes(spark, sf).groupBy("unit_id").agg(r6(F.log10(F.count("*") / 30.0)).alias("log_rate"))
    return n.join(s, "unit_id")


@query("decoded_window", f"WITH {b.SPIKES}, z AS (SELECT session, min(us) AS t0 FROM sp GROUP BY 1) SELECT event_id, us - t0 AS offset_us FROM sp JOIN z ON z.session = sp.session WHERE us >= t0 AND us < t0 + 72 * {b.HOUR_US}")
def _(spark, sf):
    s = b.spikes(spark, sf)
    first = s.groupBy("session").agg(F.min("us").alias("t0"))
    return s.join(first, "session").where(F.col("us") < F.col("t0") + 72 * b.HOUR_US).select("event_id", (F.col("us") - F.col("t0")).alias("offset_us"))


@query("tracked_tuning_grid", f"WITH {CURVES} SELECT a.unit_id, a.angle_bin, round(a.hz, 6) AS hz_a, round(c.hz, 6) AS hz_b FROM cv a LEFT JOIN cv c ON c.unit_id = a.unit_id + 20 AND c.angle_bin = a.angle_bin")
def _(spark, sf):
    c = curves(spark, sf)
    other = c.select((F.col("unit_id") - 20).alias("unit_id"), "angle_bin", r6("hz").alias("hz_b"))
    return c.select("unit_id", "angle_bin", r6("hz").alias("hz_a")).join(other, ["unit_id", "angle_bin"], "left")


@query("null_interval", f"WITH {b.SPIKES}, n AS (SELECT unit_id, us // (86400000000 * 3) AS shuffle, avg(value) AS v FROM sp GROUP BY 1, 2) SELECT unit_id, round(quantile_cont(v, 0.05), 6) AS low, round(quantile_cont(v, 0.95), 6) AS high FROM n GROUP BY 1")
def _(spark, sf):
    n = b.spikes(spark, sf).groupBy("unit_id", F.floor(F.col("us") / (86_400_000_000 * 3)).alias("shuffle")).agg(F.avg("value").alias("v"))
    return di.null_interval(n, ["unit_id"], "v").select("unit_id", r6("low").alias("low"), r6("high").alias("high"))


@query("encoding_heatmap_rows", f"WITH {CURVES}, p AS (SELECT unit_id, arg_max(angle_bin, round(hz, 9)*1e6 - angle_bin*1e-3) AS peak_bin FROM cv GROUP BY 1) SELECT unit_id, peak_bin, row_number() OVER (ORDER BY peak_bin, unit_id) - 1 AS row FROM p")
def _(spark, sf):
    c = curves(spark, sf)
    p = c.groupBy("unit_id").agg(F.max_by("angle_bin", F.round("hz", 9) * 1e6 - F.col("angle_bin") * 1e-3).alias("peak_bin"))
    return number_rows(written(p, "peaks"), [], ["peak_bin", "unit_id"], "row")  # numbering reads its rows several times
