"""Queries: which moments count (states, spans, behaviour, speed)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.angles import r6
from ..operators import masks, runs, states
from ..operators.scan import previous, scan
from . import bindings as b
from .registry import query

_LATEST = """SELECT p.*, s.start, s.stop FROM {points} p ASOF LEFT JOIN
  (SELECT session, start, max(stop) AS stop FROM iv WHERE state IN ({states}) GROUP BY 1, 2) s
  ON p.session = s.session AND p.us >= s.start"""


@query("classify_states", f"WITH {b.STATE_BINS} SELECT session, bin, CAST(code AS INT) AS code FROM sb")
def _(spark, sf):
    return b.state_bins(spark, sf).select("session", "bin", "code")


@query("times_in_states", f"""WITH {b.SPIKES}, {b.INTERVALS}, h AS ({_LATEST.format(points='sp', states="'signup'")})
SELECT event_id, coalesce(us < stop, false) AS inside FROM h""")
def _(spark, sf):
    return masks.times_in_states(b.spikes(spark, sf), b.intervals(spark, sf), ["session"], "us",
                                 ["signup"]).select("event_id", "inside")


@query("intervals_between_frames", f"""WITH {b.FRAMES}
SELECT event_id, CASE WHEN lead(value) OVER w IS NOT NULL THEN value > 2 AND lead(value) OVER w > 2 END AS kept
FROM fr WINDOW w AS (PARTITION BY unit_id ORDER BY us, event_id)""")
def _(spark, sf):
    f = b.spikes(spark, sf).withColumn("ok", F.col("value") > 2)
    return runs.intervals_between_frames(f, ["unit_id"], ["us", "event_id"], "ok", "kept").select("event_id", "kept")


@query("frames_in_states", f"""WITH {b.SPIKES}, {b.INTERVALS}, h AS ({_LATEST.format(points='sp', states="'signup','purchase'")}),
k AS (SELECT session, us, event_id, coalesce(us < stop, false) AS frame_kept FROM h)
SELECT event_id, frame_kept, CASE WHEN lead(frame_kept) OVER w IS NOT NULL THEN frame_kept AND lead(frame_kept) OVER w END AS interval_kept
FROM k WINDOW w AS (PARTITION BY session ORDER BY us, event_id)""")
def _(spark, sf):
    return masks.frames_in_states(
        b.spikes(spark, sf), b.intervals(spark, sf), ["session"], "us", ["us", "event_id"],
        ["signup", "purchase"]).select("event_id", "frame_kept", "interval_kept")


@query("seconds_since", f"""WITH {b.SPIKES}, {b.INTERVALS},
m AS (SELECT session, start, max(max(stop)) OVER (PARTITION BY session ORDER BY start) AS last FROM iv GROUP BY 1, 2)
SELECT event_id, CASE WHEN last IS NOT NULL THEN greatest(us - last, 0) END AS since FROM sp ASOF LEFT JOIN m ON sp.session = m.session AND us >= start""".replace(
    "max(max(stop)) OVER (PARTITION BY session ORDER BY start) AS last FROM iv GROUP BY 1, 2",
    "max(stop) OVER (PARTITION BY session ORDER BY start) AS last FROM (SELECT session, start, max(stop) AS stop FROM iv GROUP BY 1, 2)"))
def _(spark, sf):
    return masks.seconds_since(b.spikes(spark, sf), b.intervals(spark, sf), ["session"], "us").select(
        "event_id", F.col("since").cast("bigint").alias("since"))


_BEHAVE = f"""WITH {b.FRAMES}, n AS (SELECT *, value <= 20 AND value > 1 AND abs(circ) <= 150 AS ok,
  lead(us) OVER w AS nx FROM (SELECT *, CASE WHEN d IS NULL THEN 0 ELSE d - 360.0*floor((d+180)/360.0) END AS circ FROM
   (SELECT *, heading - lag(heading) OVER (PARTITION BY unit_id ORDER BY us, event_id) AS d FROM fr))
  WINDOW w AS (PARTITION BY unit_id ORDER BY us, event_id)),
k AS (SELECT *, coalesce(nx IS NOT NULL AND ok AND lead(ok) OVER (PARTITION BY unit_id ORDER BY us, event_id), false) AS keep FROM n),
c AS (SELECT *, CASE WHEN keep IS DISTINCT FROM lag(keep) OVER (PARTITION BY unit_id ORDER BY us, event_id) THEN 1 ELSE 0 END AS ch FROM k),
g AS (SELECT *, sum(ch) OVER (PARTITION BY unit_id ORDER BY us, event_id) AS run FROM c),
l AS (SELECT unit_id, run, max(nx) - min(us) AS span FROM g WHERE keep GROUP BY 1, 2),
bm AS (SELECT g.event_id, g.unit_id, g.us, g.nx, g.run, CASE WHEN g.nx IS NOT NULL THEN g.keep AND coalesce(l.span >= {12 * b.HOUR_US}, false) END AS interval_kept
  FROM g LEFT JOIN l ON g.unit_id = l.unit_id AND g.run = l.run)"""


def _behaving(spark, sf):
    f = b.spikes(spark, sf)
    f = scan(f, ["unit_id"], ["us", "event_id"], {"before": previous("heading")})
    from ..functions.angles import circular_difference

    f = f.withColumn("turned", F.coalesce(circular_difference(F.col("heading"), F.col("before")), F.lit(0.0)))
    ok = masks.passes("value", at_most=20, more_than=1) & masks.passes("turned", at_most=150, magnitude=True)
    return masks.behavior_interval_mask(f, ["unit_id"], ["us", "event_id"], "us", ok, min_duration=12 * b.HOUR_US)


@query("behavior_interval_mask", _BEHAVE + " SELECT event_id, interval_kept FROM bm")
def _(spark, sf):
    return _behaving(spark, sf).select("event_id", "interval_kept")


@query("interval_mask_to_spans", _BEHAVE + """ SELECT unit_id, min(us) AS start, CAST(max(nx) AS BIGINT) AS stop, count(*) AS n_intervals
 FROM bm WHERE interval_kept GROUP BY unit_id, run""")
def _(spark, sf):
    return masks.interval_mask_to_spans(_behaving(spark, sf), ["unit_id"], ["us", "event_id"], "us")


@query("true_runs", f"""WITH {b.FRAMES}, c AS (SELECT *, kind IN ('view','click') AS m FROM fr),
d AS (SELECT *, CASE WHEN m IS DISTINCT FROM lag(m) OVER (PARTITION BY unit_id ORDER BY us, event_id) THEN 1 ELSE 0 END AS ch FROM c),
g AS (SELECT *, sum(ch) OVER (PARTITION BY unit_id ORDER BY us, event_id) AS run FROM d)
SELECT unit_id, min(frame) AS start_index, max(frame) + 1 AS stop_index FROM g WHERE m GROUP BY unit_id, run""")
def _(spark, sf):
    f = b.frames(spark, sf).withColumn("m", F.col("kind").isin("view", "click"))
    out = runs.true_runs(f, ["unit_id"], ["us", "event_id"], "m",
                         {"start_index": F.min("frame"), "stop_index": F.max("frame") + 1})
    return out.drop("run")


_EPOCHS = f"""WITH {b.STATE_BINS}, d AS (SELECT *, CASE WHEN code IS DISTINCT FROM lag(code) OVER (PARTITION BY session ORDER BY bin) THEN 1 ELSE 0 END AS ch FROM sb),
g AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY bin) AS run FROM d),
ep AS (SELECT session, code, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS n_bins,
  min(bin) + 0.0 AS start, max(bin) + 1.0 AS stop FROM g GROUP BY session, code, run)"""


def _epochs(spark, sf):
    bins = b.state_bins(spark, sf).withColumn("t", F.col("bin") + 0.5)
    return runs.state_epochs(bins, ["session"], "bin", "t", "code", 1.0)


@query("state_epochs", _EPOCHS + """ SELECT session, CASE code WHEN 1 THEN 'WAKE' WHEN 3 THEN 'NREM' ELSE 'REM' END AS state,
 CAST(start AS DOUBLE) AS start, CAST(stop AS DOUBLE) AS stop, first_bin, last_bin, n_bins FROM ep""")
def _(spark, sf):
    e = _epochs(spark, sf)
    return e.select("session", states.state_name("code").alias("state"), "start", "stop", "first_bin",
                    "last_bin", "n_bins")


@query("state_epoch_duration", _EPOCHS + """ SELECT session, CAST(code AS INT) AS code, CAST(sum(stop - start) AS DOUBLE) AS duration, count(*) AS n_epochs FROM ep GROUP BY 1, 2""")
def _(spark, sf):
    return _epochs(spark, sf).groupBy("session", "code").agg(
        F.sum(F.col("stop") - F.col("start")).alias("duration"), F.count("*").alias("n_epochs"))


@query("intervals_from_states", _EPOCHS + """ SELECT session, CASE code WHEN 1 THEN 'WAKE' WHEN 3 THEN 'NREM' ELSE 'REM' END AS state,
 CAST(start AS DOUBLE) AS start, CAST(stop AS DOUBLE) AS stop, row_number() OVER (PARTITION BY session, code ORDER BY start) - 1 AS position FROM ep""")
def _(spark, sf):
    bins = b.state_bins(spark, sf).withColumn("t", F.col("bin") + 0.5)
    return states.intervals_from_states(bins, ["session"], "bin", "t", "code", 1.0)


@query("conversation_epochs", """WITH d AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS ch FROM conversations),
g AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM d)
SELECT conv_id, role, min(turn) AS first_bin, max(turn) AS last_bin, count(*) AS n_bins FROM g GROUP BY conv_id, role, run""")
def _(spark, sf):
    c = b.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("turn").cast("double").alias("t"))
    return runs.state_epochs(c, ["conv_id"], "turn", "t", "role", 1.0).select(
        "conv_id", "role", "first_bin", "last_bin", "n_bins")


@query("enforce_min_duration")
def _(spark, sf):
    return states.enforce_min_duration(b.state_bins(spark, sf), ["session"], "bin", "code", 1.0, 4.0).select(
        "session", "bin", "code", "code_smoothed")


@query("apply_movement_veto", f"""WITH {b.STATE_BINS}
SELECT session, bin, coalesce(speed > 1000, false) AS moving, CAST(code AS INT) AS code_before,
 CAST(CASE WHEN code IN (3, 5) AND coalesce(speed > 1000, false) THEN 1 ELSE code END AS INT) AS code_after FROM sb""")
def _(spark, sf):
    return states.apply_movement_veto(b.state_bins(spark, sf), ["session"], "bin", "code", "speed", 3.0, 1.0, 1.0).select(
        "session", "bin", "moving", "code_before", "code_after")


@query("movement_veto_summary", f"""WITH {b.STATE_BINS}, v AS (SELECT *, coalesce(speed > 1000, false) AS moving,
 CASE WHEN code IN (3, 5) AND coalesce(speed > 1000, false) THEN 1 ELSE code END AS after FROM sb)
SELECT session, round(avg(CASE WHEN speed IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage, round(avg(CASE WHEN moving THEN 1.0 ELSE 0.0 END), 6) AS fraction_moving,
 CAST(sum(CASE WHEN after <> code THEN 1 ELSE 0 END) AS BIGINT) AS n_reassigned, round(avg(CASE WHEN after <> code THEN 1.0 ELSE 0.0 END), 6) AS fraction_reassigned FROM v GROUP BY 1""")
def _(spark, sf):
    v = states.apply_movement_veto(b.state_bins(spark, sf), ["session"], "bin", "code", "speed", 3.0, 1.0, 1.0)
    s = states.veto_summary(v, ["session"], "speed")
    return s.select("session", r6("coverage").alias("coverage"), r6("fraction_moving").alias("fraction_moving"),
                    "n_reassigned", r6("fraction_reassigned").alias("fraction_reassigned"))


_HELD = f"""WITH {b.FRAMES}, p AS (SELECT *, floor(value/10) AS px, CASE kind WHEN 'view' THEN 1.0 ELSE 0.0 END AS py FROM fr),
h AS (SELECT *, coalesce(px = lag(px) OVER w AND py = lag(py) OVER w, false) AS held FROM p WINDOW w AS (PARTITION BY unit_id ORDER BY us, event_id))"""


def _positions(spark, sf):
    return b.spikes(spark, sf).select(
        "unit_id", "us", "event_id", F.floor(F.col("value") / 10).cast("double").alias("px"),
        F.when(F.col("kind") == "view", 1.0).otherwise(0.0).alias("py"))


@query("held_frames", _HELD + " SELECT event_id, held FROM h")
def _(spark, sf):
    return states.held_frames(_positions(spark, sf), ["unit_id"], ["us", "event_id"], ["px", "py"]).select("event_id", "held")


@query("frame_speeds", _HELD + f""", u AS (SELECT *, us - lag(us) OVER w AS el, px - lag(px) OVER w AS dx, py - lag(py) OVER w AS dy FROM h WHERE NOT held
  WINDOW w AS (PARTITION BY unit_id ORDER BY us, event_id))
SELECT event_id, round(sqrt(dx*dx+dy*dy)/el*{b.HOUR_US}, 6) AS speed FROM u WHERE el > 0 AND el <= {12 * b.HOUR_US}""")
def _(spark, sf):
    s = states.frame_speeds(_positions(spark, sf), ["unit_id"], "us", ["px", "py"], 12 * b.HOUR_US, ["event_id"])
    return s.where("speed IS NOT NULL").select("event_id", r6(F.col("speed") * b.HOUR_US).alias("speed"))


_GRID = 6 * b.HOUR_US
_SPEED = _HELD + f""", u AS (SELECT *, us - lag(us) OVER w AS el, px - lag(px) OVER w AS dx, py - lag(py) OVER w AS dy FROM h WHERE NOT held
  WINDOW w AS (PARTITION BY unit_id ORDER BY us, event_id)),
m AS (SELECT unit_id, CAST(floor(us/{_GRID}.0) AS BIGINT) AS bin, avg(sqrt(dx*dx+dy*dy)/el*{b.HOUR_US}) AS speed FROM u WHERE el > 0 AND el <= {12 * b.HOUR_US} GROUP BY 1, 2),
gb AS (SELECT DISTINCT unit_id, CAST(floor(us/{_GRID}.0) AS BIGINT) AS bin FROM sp),
q AS (SELECT gb.unit_id, gb.bin, speed, row_number() OVER (PARTITION BY gb.unit_id ORDER BY gb.bin) - 1 AS i FROM gb LEFT JOIN m ON gb.unit_id = m.unit_id AND gb.bin = m.bin),
e AS (SELECT *, max(CASE WHEN speed IS NOT NULL THEN i END) OVER (PARTITION BY unit_id ORDER BY bin) AS ia,
  min(CASE WHEN speed IS NOT NULL THEN i END) OVER (PARTITION BY unit_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM q),
f AS (SELECT e.unit_id, e.bin, CASE WHEN e.speed IS NOT NULL THEN e.speed WHEN e.ib - e.ia - 1 <= 2 THEN a.speed + (c.speed - a.speed) * ((e.i - e.ia) * 1.0 / (e.ib - e.ia)) END AS speed
  FROM e LEFT JOIN q a ON a.unit_id = e.unit_id AND a.i = e.ia LEFT JOIN q c ON c.unit_id = e.unit_id AND c.i = e.ib)
SELECT unit_id, bin, round(speed, 6) AS speed FROM f"""


@query("binned_speed", _SPEED)
def _(spark, sf):
    p = _positions(spark, sf)
    grid = p.select("unit_id", F.floor(F.col("us") / _GRID).cast("bigint").alias("bin")).distinct()
    s = states.binned_speed(p, grid, ["unit_id"], "us", ["px", "py"], "bin", _GRID, 12 * b.HOUR_US,
                            2 * _GRID, ["event_id"])
    return s.select("unit_id", "bin", r6(F.col("speed") * b.HOUR_US).alias("speed"))


@query("interpolate_gaps", f"""WITH {b.STATE_BINS}, q AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY bin) - 1 AS i FROM sb),
e AS (SELECT *, max(CASE WHEN speed IS NOT NULL THEN i END) OVER (PARTITION BY session ORDER BY bin) AS ia,
  min(CASE WHEN speed IS NOT NULL THEN i END) OVER (PARTITION BY session ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM q)
SELECT e.session, e.bin, round(CASE WHEN e.speed IS NOT NULL THEN e.speed WHEN e.ib - e.ia - 1 <= 3 THEN a.speed + (c.speed - a.speed) * ((e.i - e.ia) * 1.0 / (e.ib - e.ia)) END, 6) AS speed
  FROM e LEFT JOIN q a ON a.session = e.session AND a.i = e.ia LEFT JOIN q c ON c.session = e.session AND c.i = e.ib""")
def _(spark, sf):
    return states.interpolate_gaps(b.state_bins(spark, sf), ["session"], "bin", "speed", 1.0, 3.0).select(
        "session", "bin", r6("speed").alias("speed"))
