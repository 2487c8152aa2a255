"""Queries: kinematics, turning, head calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.angles import mean_angle, r6
from ..operators import motion as mo
from . import bindings as b
from .angles import QUATERNIONS, track, w360_sql, wrap_sql
from .registry import query


def weight_sql(name: str, window: int, order: int, derivative: int) -> str:
    """Filter weights as a SQL table of (offset from centre d, sample k, weight)."""
    table = mo.polynomial_weights(window, order, derivative)
    h = window // 2
    rows = ", ".join(f"({d - h}, {k - h}, {float(x)!r}::DOUBLE)" for d, row in enumerate(table) for k, x in enumerate(row))
    return f"{name}(d, k, w) AS (VALUES {rows})"


_FRAME = b.FRAMES + """, fn AS (SELECT *, count(*) OVER (PARTITION BY unit_id) AS n FROM fr), fc AS (SELECT *, least(greatest(frame, 5), n - 6) AS c FROM fn)"""


@query("compute_kinematics", f"""WITH {_FRAME}, {weight_sql('w0', 11, 3, 0)}, {weight_sql('w1', 11, 3, 1)}, {weight_sql('w2', 11, 3, 2)},
j AS (SELECT f.event_id, f.unit_id, f.frame, q.value AS x, q.heading AS y, f.frame - f.c AS d, q.frame - f.c AS k FROM fc f JOIN fc q ON q.unit_id = f.unit_id AND q.frame BETWEEN f.c - 5 AND f.c + 5 WHERE f.n >= 11)
SELECT event_id, round(sum(w0.w * x), 5) + 0.0 AS x_smoothed, round(sum(w1.w * x)/0.5, 5) + 0.0 AS x_velocity, round(sqrt(pow(sum(w1.w * x)/0.5, 2) + pow(sum(w1.w * y)/0.5, 2)), 5) AS speed,
 round(sqrt(pow(sum(w2.w * x)/0.25, 2) + pow(sum(w2.w * y)/0.25, 2)), 5) AS accel_magnitude FROM j JOIN w0 ON w0.d = j.d AND w0.k = j.k JOIN w1 ON w1.d = j.d AND w1.k = j.k JOIN w2 ON w2.d = j.d AND w2.k = j.k GROUP BY 1""")
def _(spark, sf):
    f = b.frames(spark, sf).select("event_id", "unit_id", "frame", F.col("value").alias("x"), F.col("heading").alias("y"))
    k = mo.compute_kinematics(f, ["unit_id"], "frame", ["x", "y"], 0.5).where("speed IS NOT NULL")
    return k.select("event_id", *[r6(c, 5).alias(c) for c in ("x_smoothed", "x_velocity", "speed", "accel_magnitude")])


_UNWRAP = b.FRAMES + f""", st AS (SELECT *, CASE WHEN lag(heading) OVER w IS NULL THEN heading WHEN {wrap_sql('heading - lag(heading) OVER w')} = -180 AND heading > lag(heading) OVER w THEN 180 ELSE {wrap_sql('heading - lag(heading) OVER w')} END AS step FROM fr WINDOW w AS (PARTITION BY unit_id ORDER BY frame)),
uw AS (SELECT *, sum(step) OVER (PARTITION BY unit_id ORDER BY frame) AS u, count(*) OVER (PARTITION BY unit_id) AS n FROM st)"""


@query("unwrap", f"WITH {_UNWRAP} SELECT event_id, round(u, 5) + 0.0 AS unwrapped FROM uw")
def _(spark, sf):
    return mo.unwrap(b.frames(spark, sf), ["unit_id"], ["frame"], "heading").select("event_id", r6("unwrapped", 5).alias("unwrapped"))


@query("compute_angular_velocity", f"""WITH {_UNWRAP}, {weight_sql('w1', 11, 3, 1)}, uc AS (SELECT *, least(greatest(frame, 5), n - 6) AS c FROM uw)
SELECT f.event_id, round(sum(w * q.u)/2.0, 5) + 0.0 AS angular_velocity FROM uc f JOIN uc q ON q.unit_id = f.unit_id AND q.frame BETWEEN f.c - 5 AND f.c + 5 JOIN w1 ON d = f.frame - f.c AND k = q.frame - f.c WHERE f.n >= 11 GROUP BY 1""")
def _(spark, sf):
    v = mo.compute_angular_velocity(b.frames(spark, sf), ["unit_id"], "frame", "heading", 2.0)
    return v.where("angular_velocity IS NOT NULL").select("event_id", r6("angular_velocity", 5).alias("angular_velocity"))


@query("calibrate_head_frame", f"""WITH {QUATERNIONS}, {weight_sql('w1', 31, 3, 1)}, n AS (SELECT count(*) AS n FROM qu), qc AS (SELECT qu.*, least(greatest(frame, 15), n - 16) AS c FROM qu, n),
v AS (SELECT f.frame, sum(w1.w * q.px) AS vx, sum(w1.w * q.pz) AS vz FROM qc f JOIN qc q ON q.frame BETWEEN f.c - 15 AND f.c + 15 JOIN w1 ON d = f.frame - f.c AND k = q.frame - f.c GROUP BY 1),
m AS (SELECT qu.frame, sqrt(vx*vx+vz*vz) AS g, vx/sqrt(vx*vx+vz*vz) AS tx, vz/sqrt(vx*vx+vz*vz) AS tz, 1-2*(y*y+z*z) AS xx, 2*(x*y+z*w) AS xy, 2*(x*z-y*w) AS xz, 2*(x*y-z*w) AS yx, 1-2*(x*x+z*z) AS yy, 2*(y*z+x*w) AS yz, 2*(x*z+y*w) AS zx, 2*(y*z-x*w) AS zy, 1-2*(x*x+y*y) AS zz FROM qu JOIN v ON v.frame = qu.frame),
s AS (SELECT avg(xy) AS ux, avg(yy) AS uy, avg(zy) AS uz, sum(xx*tx+xz*tz) FILTER (g > 0.3) AS fx, sum(yx*tx+yz*tz) FILTER (g > 0.3) AS fy, sum(zx*tx+zz*tz) FILTER (g > 0.3) AS fz, count(*) FILTER (g > 0.3) AS n FROM m),
u AS (SELECT n, ux/sqrt(ux*ux+uy*uy+uz*uz) AS ux, uy/sqrt(ux*ux+uy*uy+uz*uz) AS uy, uz/sqrt(ux*ux+uy*uy+uz*uz) AS uz, fx/sqrt(fx*fx+fy*fy+fz*fz) AS fx, fy/sqrt(fx*fx+fy*fy+fz*fz) AS fy, fz/sqrt(fx*fx+fy*fy+fz*fz) AS fz FROM s),
l AS (SELECT n, ux, uy, uz, fx-(fx*ux+fy*uy+fz*uz)*ux AS fx, fy-(fx*ux+fy*uy+fz*uz)*uy AS fy, fz-(fx*ux+fy*uy+fz*uz)*uz AS fz FROM u),
h AS (SELECT n, ux, uy, uz, fx/sqrt(fx*fx+fy*fy+fz*fz) AS fx, fy/sqrt(fx*fx+fy*fy+fz*fz) AS fy, fz/sqrt(fx*fx+fy*fy+fz*fz) AS fz FROM l),
o AS (SELECT atan2(xx*fx+yx*fy+zx*fz, xz*fx+yz*fy+zz*fz) - atan2(tx, tz) AS o, h.* FROM m, h WHERE g > 0.3)
SELECT any_value(n) AS n_calibration_frames, round(any_value(fx), 5) + 0.0 AS forward_x, round(any_value(fy), 5) + 0.0 AS forward_y, round(any_value(fz), 5) + 0.0 AS forward_z, round(any_value(uy), 5) + 0.0 AS up_y, round(any_value(uy*fz - uz*fy), 5) + 0.0 AS left_x,
 round(sqrt(pow(avg(cos(o)), 2) + pow(avg(sin(o)), 2)), 5) AS concentration, round(degrees(atan2(avg(sin(o)), avg(cos(o)))), 4) + 0.0 AS residual_deg FROM o""")
def _(spark, sf):
    t = mo.polynomial_filter(track(spark, sf), [], "frame", {"vx": ("px", 1), "vy": ("py", 1), "vz": ("pz", 1)}, 31, 3)
    c = mo.calibrate_head_frame(t, ["qx", "qy", "qz", "qw"], ["vx", "vy", "vz"], 0.3)
    return c.select("n_calibration_frames", *[r6(x, 5).alias(x) for x in ("forward_x", "forward_y", "forward_z", "up_y", "left_x", "concentration")], r6("residual_deg", 4).alias("residual_deg"))


# ── turns ───────────────────────────────────────────────────────────────
STEP, HALF, THRESHOLD = 100.0, 2, 12.0


def turns_sql(threshold: str = str(THRESHOLD), extra: str = "") -> str:
    """Turn detection on the hourly mean heading of each session as SQL."""
    return f"""{b.SPIKES}, hr AS (SELECT session, CAST(floor(us/{b.HOUR_US}.0) AS BIGINT) + 0.5::DOUBLE AS t, {w360_sql('degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading)))))')} AS h FROM sp GROUP BY session, floor(us/{b.HOUR_US}.0)),
t0 AS (SELECT *, row_number() OVER w - 1 AS i, t - lag(t) OVER w <= 1.5 AS same, {wrap_sql('h - lag(h) OVER w')} AS step FROM hr WINDOW w AS (PARTITION BY session ORDER BY t)),
t1 AS (SELECT *, coalesce(same AND abs(step) > {STEP}, false) AS jump, CASE WHEN i > 0 AND (NOT same OR abs(step) > {STEP}) THEN 1 ELSE 0 END AS bd FROM t0),
t2 AS (SELECT *, sum(bd) OVER w AS piece, sum(CASE WHEN i = 0 OR bd = 1 THEN 0.0 ELSE step END) OVER w AS u FROM t1 WINDOW w AS (PARTITION BY session ORDER BY t)),
t3 AS (SELECT *, first_value(u) OVER w AS ulo, last_value(u) OVER w AS uhi, last_value(t) OVER w - first_value(t) OVER w AS span FROM t2 WINDOW w AS (PARTITION BY session, piece ORDER BY i ROWS BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING)),
t4 AS (SELECT *, span >= {HALF - 0.25} AS analysed, CASE WHEN span >= {HALF - 0.25} THEN (uhi - ulo)/span END AS velocity FROM t3),
t5 AS (SELECT *{extra}, coalesce(abs(velocity) >= {threshold}, false) AS turning, CASE WHEN abs(velocity) >= {threshold} THEN CAST(sign(velocity) AS INT) ELSE 0 END AS direction FROM t4{', th' if extra else ''})"""


_RUNS = """, g0 AS (SELECT *, CASE WHEN piece IS DISTINCT FROM lag(piece) OVER w OR direction IS DISTINCT FROM lag(direction) OVER w THEN 1 ELSE 0 END AS ch FROM t5 WINDOW w AS (PARTITION BY session ORDER BY t)),
g1 AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY t) AS run FROM g0), tn AS (SELECT session, run, min(t) AS start, max(t) AS stop, any_value(direction) AS direction, arg_max(uhi, t) - arg_min(ulo, t) AS rot FROM g1 WHERE direction <> 0 GROUP BY 1, 2)"""


def trace(spark, sf):
    """Hourly circular mean heading of each session."""
    s = b.spikes(spark, sf)
    h = s.groupBy("session", F.floor(F.col("us") / b.HOUR_US).alias("bin")).agg(mean_angle("heading").alias("h"))
    return h.select("session", (F.col("bin") + 0.5).cast("double").alias("t"), "h")


def turning(spark, sf, threshold=THRESHOLD):
    return mo.turn_bins(trace(spark, sf), ["session"], "t", "h", 1.0, threshold, 3.0, STEP)


@query("turn_bins", f"WITH {turns_sql()} SELECT session, t, CAST(piece AS BIGINT) AS piece, jump, analysed, round(velocity, 5) + 0.0 AS velocity, direction FROM t5")
def _(spark, sf):
    return turning(spark, sf).select("session", "t", F.col("piece").cast("bigint").alias("piece"), "jump", "analysed", r6("velocity", 5).alias("velocity"), "direction")


@query("find_turns", f"WITH {turns_sql()}{_RUNS} SELECT session, start, stop, direction, round(rot, 5) + 0.0 AS rotation_deg FROM tn")
def _(spark, sf):
    return mo.turns(turning(spark, sf), ["session"], "t").select("session", "start", "stop", "direction", r6("rotation_deg", 5).alias("rotation_deg"))


@query("turn_jumps", f"WITH {turns_sql()} SELECT session, t FROM t5 WHERE jump")
def _(spark, sf):
    return mo.jumps(turning(spark, sf), ["session"], "t")


_SUMMARY = """, b0 AS (SELECT session, count(*)*1.0::DOUBLE AS duration_s, count(*) FILTER (analysed)*1.0::DOUBLE AS analysed_s, count(*) FILTER (analysed AND NOT turning)*1.0::DOUBLE AS constant_s, count(*) FILTER (jump) AS n_jumps FROM t5 GROUP BY 1),
pn AS (SELECT session, sum(CASE WHEN ok THEN r ELSE 0 END) AS net FROM (SELECT session, piece, arg_max(u, t) - arg_min(u, t) AS r, arg_min(analysed, t) AS ok FROM t5 GROUP BY 1, 2) GROUP BY 1),
tc AS (SELECT session, count(*) FILTER (direction > 0) AS cw, count(*) FILTER (direction < 0) AS ccw FROM tn GROUP BY 1)"""


@query("turn_summary", f"WITH {turns_sql()}{_RUNS}{_SUMMARY} SELECT b0.session, duration_s, analysed_s, constant_s, n_jumps, round(net, 4) + 0.0 AS net_rotation_deg, cw AS n_clockwise, ccw AS n_counterclockwise, cw + ccw AS n_turns, round(constant_s/analysed_s, 6) AS constant_fraction, round((cw+ccw)/(analysed_s/60), 5) AS turns_per_min, round(net/(analysed_s/60), 4) + 0.0 AS drift_deg_per_min, round(n_jumps/(duration_s/60), 5) AS jumps_per_min, round(cw/ccw, 6) AS clockwise_ratio FROM b0 JOIN pn ON pn.session = b0.session JOIN tc ON tc.session = b0.session")
def _(spark, sf):
    s = mo.turn_summary(turning(spark, sf), ["session"], "t", 1.0)
    return s.select("session", "duration_s", "analysed_s", "constant_s", "n_jumps", r6("net_rotation_deg", 4).alias("net_rotation_deg"), "n_clockwise", "n_counterclockwise", "n_turns",
                    r6("constant_fraction").alias("constant_fraction"), r6("turns_per_min", 5).alias("turns_per_min"), r6("drift_deg_per_min", 4).alias("drift_deg_per_min"), r6("jumps_per_min", 5).alias("jumps_per_min"), r6("clockwise_ratio").alias("clockwise_ratio"))


@query("turn_sweep", f"""WITH th(thr) AS (VALUES (6.0::DOUBLE), (12.0::DOUBLE), (24.0::DOUBLE)), {turns_sql('thr', ', thr')},
g0 AS (SELECT *, CASE WHEN piece IS DISTINCT FROM lag(piece) OVER w OR direction IS DISTINCT FROM lag(direction) OVER w THEN 1 ELSE 0 END AS ch FROM t5 WINDOW w AS (PARTITION BY session, thr ORDER BY t)),
g1 AS (SELECT *, sum(ch) OVER (PARTITION BY session, thr ORDER BY t) AS run FROM g0), tn AS (SELECT session, thr, run, any_value(direction) AS direction FROM g1 WHERE direction <> 0 GROUP BY 1, 2, 3)
SELECT session, thr AS threshold, count(*) AS n_turns, CASE WHEN count(*) >= 20 AND count(*) FILTER (direction < 0) > 0 AND count(*) FILTER (direction > 0) > 0 THEN round(count(*) FILTER (direction > 0) / count(*) FILTER (direction < 0), 6) END AS clockwise_ratio FROM tn GROUP BY 1, 2""")
def _(spark, sf):
    out = None
    for threshold in (6.0, 12.0, 24.0):
        found = mo.turns(turning(spark, sf, threshold), ["session"], "t").groupBy("session").agg(
            F.count("*").alias("n_turns"), F.sum((F.col("direction") > 0).cast("bigint")).alias("cw"))
        part = found.withColumn("threshold", F.lit(threshold))
        out = part if out is None else out.unionByName(part)
    ccw = F.col("n_turns") - F.col("cw")
    kept = (F.col("n_turns") >= 20) & (F.col("cw") > 0) & (ccw > 0)
    return out.select("session", "threshold", "n_turns", F.when(kept, r6(F.col("cw") / F.when(kept, ccw))).alias("clockwise_ratio"))
