"""Queries: heading tuning, its significance, and cuts read off distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.angles import bin_centre, heading_bin, r6
from ..operators import thresholds as th
from ..operators import tuning as tu
from ..operators.nulls import draw_shifts
from ..operators.quantiles import average_rank, quantiles
from . import bindings as b
from .registry import query

BINS = 36
SIGMA = 10.0
SHIFTS = draw_shifts(39, 100, 5000, seed=0)

CELLS = b.CLOCK + f""", ab AS (SELECT *, least(greatest(CAST(floor(heading / 10.0) AS BIGINT), 0), {BINS - 1}) AS angle_bin FROM ck),
oc AS (SELECT angle_bin, sum(dur) AS occupancy FROM ab GROUP BY 1),
cells AS (SELECT unit_id, angle_bin, count(*) AS n FROM ab GROUP BY 1, 2),
units AS (SELECT DISTINCT unit_id FROM ab),
grid AS (SELECT unit_id, CAST(r.range AS BIGINT) AS angle_bin FROM units, range({BINS}) r),
tc AS (SELECT g.unit_id, g.angle_bin, coalesce(c.n, 0) AS n_spikes, CAST(coalesce(o.occupancy, 0) AS BIGINT) AS occupancy
  FROM grid g LEFT JOIN cells c ON c.unit_id = g.unit_id AND c.angle_bin = g.angle_bin LEFT JOIN oc o ON o.angle_bin = g.angle_bin)"""
CURVES = CELLS + f""", kn(off, w) AS (VALUES {tu.kernel_sql(SIGMA / 10.0, BINS)}),
hz0 AS (SELECT unit_id, angle_bin, CASE WHEN occupancy > 0 THEN n_spikes / (occupancy / {b.HOUR_US}.0) ELSE 0.0 END AS hz FROM tc),
cv AS (SELECT unit_id, CAST((angle_bin + off) % {BINS} AS BIGINT) AS angle_bin, sum(hz * w) AS hz FROM hz0, kn GROUP BY 1, 2)"""


def mvl_sql(source: str, keys: str, rate: str = "hz", n: int = BINS) -> str:
    """Mean vector of a curve table as SQL."""
    th_ = f"radians((angle_bin + 0.5) * {360.0 / n})"
    return f"""SELECT {keys}, CASE WHEN t > 0 THEN sqrt(x*x + y*y) / t END AS mvl,
 CASE WHEN t > 0 THEN degrees(atan2(y, x)) - 360.0*floor(degrees(atan2(y, x))/360.0) END AS pd, peak FROM
 (SELECT {keys}, sum({rate}) AS t, sum({rate}*cos({th_})) AS x, sum({rate}*sin({th_})) AS y, max({rate}) AS peak FROM {source} GROUP BY {keys})"""


STATS = CURVES + f""", st AS ({mvl_sql('cv', 'unit_id')})"""


def curves(spark, sf):
    """Smoothed rate per hour of each unit and heading bin."""
    counts = b.curves(spark, sf, BINS)
    return tu.occupancy_normalized_rate(counts, ["unit_id"], BINS, SIGMA, float(b.HOUR_US))


def stats(spark, sf):
    return tu.mean_vector(curves(spark, sf), ["unit_id"], BINS)


@query("bin_headings", f"""WITH {b.SPIKES} SELECT event_id, least(greatest(CAST(floor(heading / 10.0) AS BIGINT), 0), 35) AS angle_bin,
 (least(greatest(CAST(floor(heading / 10.0) AS BIGINT), 0), 35) + 0.5) * 10.0::DOUBLE AS centre_deg FROM sp""")
def _(spark, sf):
    s = b.spikes(spark, sf).withColumn("angle_bin", heading_bin(F.col("heading"), BINS))
    return s.select("event_id", "angle_bin", bin_centre("angle_bin", BINS).alias("centre_deg"))


_COUNTS = f"""WITH {b.SPIKES}, e AS (SELECT session, us AS t, lead(us) OVER w AS nx, lag(us) OVER w AS pv FROM sp WHERE kind = 'view'
  WINDOW w AS (PARTITION BY session ORDER BY us, event_id)),
h AS (SELECT sp.session, sp.unit_id, CASE WHEN nx IS NULL AND us = t THEN pv ELSE t END AS start, CASE WHEN nx IS NULL AND us = t THEN t ELSE nx END AS stop
  FROM sp ASOF JOIN e ON sp.session = e.session AND sp.us >= e.t WHERE sp.kind <> 'error')
"""


def _frame_counts(spark, sf):
    s = b.spikes(spark, sf)
    return tu.frame_spike_counts(s.where("kind <> 'error'"), s.where("kind = 'view'"), ["session"], "unit_id",
                                 "us", ["us", "event_id"])


@query("frame_spike_counts", _COUNTS + """SELECT session, unit_id, start, stop, count(*) AS n_spikes FROM h
 WHERE start IS NOT NULL AND stop IS NOT NULL GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return _frame_counts(spark, sf).drop("rate")


@query("frame_firing_rates", _COUNTS + f"""SELECT session, unit_id, start, round(count(*) / ((stop - start) / {b.HOUR_US}.0), 6) AS rate FROM h
 WHERE start IS NOT NULL AND stop IS NOT NULL GROUP BY session, unit_id, start, stop""")
def _(spark, sf):
    return _frame_counts(spark, sf).select("session", "unit_id", "start", r6(
        F.col("n_spikes") / ((F.col("stop") - F.col("start")) / float(b.HOUR_US))).alias("rate"))


@query("tuning_counts", f"WITH {CELLS} SELECT unit_id, angle_bin, n_spikes, occupancy FROM tc")
def _(spark, sf):
    return b.curves(spark, sf, BINS).select("unit_id", "angle_bin", "n_spikes", F.col("occupancy").cast("bigint").alias("occupancy"))


@query("tuning_curves", f"WITH {CURVES} SELECT unit_id, angle_bin, round(hz, 6) AS hz FROM cv")
def _(spark, sf):
    return curves(spark, sf).select("unit_id", "angle_bin", r6("hz").alias("hz"))


@query("mean_vector_length", f"WITH {STATS} SELECT unit_id, round(mvl, 6) AS mvl, round(pd, 4) AS pd, round(peak, 6) AS peak FROM st")
def _(spark, sf):
    return stats(spark, sf).select("unit_id", r6("mean_vector_length").alias("mvl"),
                                   r6("preferred_direction_deg", 4).alias("pd"), r6("peak_rate_hz").alias("peak"))


NULLS = STATS + f""", sh(shuffle, s) AS (VALUES {', '.join(f'({i}, {s})' for i, s in enumerate(SHIFTS))}),
nf AS (SELECT *, row_number() OVER (ORDER BY us, event_id) - 1 AS i, count(*) OVER () AS n FROM ab),
mv AS (SELECT unit_id, shuffle, ((i - s) % n + n) % n AS i FROM nf, sh),
nc AS (SELECT mv.unit_id, shuffle, nf.angle_bin, count(*) AS k FROM mv JOIN nf ON mv.i = nf.i GROUP BY 1, 2, 3),
nh AS (SELECT unit_id, shuffle, CAST((nc.angle_bin + off) % {BINS} AS BIGINT) AS angle_bin, sum(w * k / (occupancy / {b.HOUR_US}.0)) AS hz
  FROM nc JOIN oc ON oc.angle_bin = nc.angle_bin, kn GROUP BY 1, 2, 3),
nm AS ({mvl_sql('nh', 'unit_id, shuffle')}),
nj AS (SELECT st.unit_id, any_value(st.mvl) AS mvl, any_value(st.pd) AS pd, any_value(st.peak) AS peak, CAST(sum(CASE WHEN nm.mvl >= st.mvl THEN 1 ELSE 0 END) AS BIGINT) AS hits,
  quantile_cont(nm.mvl, 0.9) AS thr FROM st JOIN nm ON nm.unit_id = st.unit_id GROUP BY 1),
sg AS (SELECT *, (1 + hits) / 40.0 AS p, (1 + hits) / 40.0 <= 0.1 AND NOT peak < 0.05 AS significant FROM nj)"""


def significance(spark, sf):
    return tu.hd_significance(b.clock(spark, sf), "unit_id", "heading", "dur", ["us", "event_id"], BINS, SIGMA,
                              min_shift=1.0, alpha=0.1, min_peak_rate=0.05, per_second=float(b.HOUR_US), shifts=SHIFTS)


@query("hd_significance", f"""WITH {NULLS} SELECT unit_id, round(mvl, 6) AS mvl, round(p, 6) AS p_value, round(thr, 6) AS mvl_threshold,
 peak < 0.05 AS too_quiet, significant FROM sg""")
def _(spark, sf):
    s, _null = significance(spark, sf)
    return s.select("unit_id", r6("mean_vector_length").alias("mvl"), r6("p_value").alias("p_value"),
                    r6("mvl_threshold").alias("mvl_threshold"), "too_quiet", "significant")


@query("null_band", f"""WITH {NULLS} SELECT unit_id, angle_bin, round(quantile_cont(hz, 0.025), 6) AS low, round(quantile_cont(hz, 0.5), 6) AS middle,
 round(quantile_cont(hz, 0.975), 6) AS high FROM nh GROUP BY 1, 2""")
def _(spark, sf):
    _stats, null = significance(spark, sf)
    band = tu.null_band(null, "unit_id")
    return band.select("unit_id", "angle_bin", r6(F.col("band")[0]).alias("low"), r6(F.col("band")[1]).alias("middle"),
                       r6(F.col("band")[2]).alias("high"))


def otsu_sql(source: str, value: str) -> str:
    """Best split of one column as SQL."""
    return f"""(SELECT (v + vn) / 2 FROM (SELECT v, lead(v) OVER (ORDER BY v) AS vn, sum(n) OVER (ORDER BY v) AS k, sum(n*v) OVER (ORDER BY v) AS low,
 sum(n) OVER () AS total, sum(n*v) OVER () AS ts FROM (SELECT {value} AS v, count(*) AS n FROM {source} GROUP BY 1)) WHERE vn IS NOT NULL
 ORDER BY round((k/total)*(1-k/total)*(low/k - (ts-low)/(total-k))*(low/k - (ts-low)/(total-k)), 12) DESC, v LIMIT 1)"""


@query("apply_mvl_cutoff", f"""WITH {NULLS}, c AS (SELECT {otsu_sql("(SELECT mvl FROM sg WHERE significant)", "mvl")} AS cut)
SELECT unit_id, round(cut, 6) AS mvl_cutoff, significant AND coalesce(mvl < cut, false) AS weakly_tuned,
 significant AND NOT coalesce(mvl < cut, false) AS significant FROM sg, c""")
def _(spark, sf):
    s, _null = significance(spark, sf)
    out = tu.apply_mvl_cutoff(s, "bimodal")
    return out.select("unit_id", r6("mvl_cutoff").alias("mvl_cutoff"), "weakly_tuned", "significant")


@query("tuned_ids", f"WITH {NULLS} SELECT unit_id FROM sg WHERE significant")
def _(spark, sf):
    return significance(spark, sf)[0].where("significant").select("unit_id")


@query("hd_population", f"""WITH {STATS} SELECT cv.unit_id, cv.angle_bin, round(CASE WHEN peak > 0 THEN hz / peak END, 6) AS normalised
 FROM cv JOIN st ON st.unit_id = cv.unit_id""")
def _(spark, sf):
    return tu.peak_normalised(curves(spark, sf), "unit_id").select("unit_id", "angle_bin", r6("normalised").alias("normalised"))


@query("preferred_direction_histogram", f"""WITH {STATS} SELECT least(CAST(floor(round(pd, 6) / 30.0) AS BIGINT), 11) AS direction_bin, count(*) AS n_units
 FROM st WHERE pd IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    s = stats(spark, sf).where("preferred_direction_deg IS NOT NULL")
    return s.groupBy(heading_bin(r6("preferred_direction_deg"), 12).alias("direction_bin")).agg(
        F.count("*").alias("n_units"))


@query("find_bimodal_threshold", """WITH d AS (SELECT event_type AS kind, value AS v, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT kind, v, lead(v) OVER w AS vn, sum(n) OVER w AS k, sum(n*v) OVER w AS low, sum(n) OVER (PARTITION BY kind) AS total, sum(n*v) OVER (PARTITION BY kind) AS ts
  FROM d WINDOW w AS (PARTITION BY kind ORDER BY v)),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round((k/total)*(1-k/total)*(low/k - (ts-low)/(total-k))*(low/k - (ts-low)/(total-k)), 9) DESC, v) AS rn FROM s WHERE vn IS NOT NULL)
SELECT kind, round((v + vn)/2, 6) AS cutoff, CAST(k AS BIGINT) AS n_low, CAST(total AS BIGINT) AS n_values FROM r WHERE rn = 1""")
def _(spark, sf):
    t = th.otsu_table(b.spikes(spark, sf), ["kind"], "value")
    return t.select("kind", r6("cutoff").alias("cutoff"), "n_low", "n_values")


@query("upper_fence", """SELECT event_type AS kind, count(*) AS n_values, round(quantile_cont(value, 0.75) + 1.5*(quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 6) AS fence
 FROM events GROUP BY 1""")
def _(spark, sf):
    return th.upper_fence(b.spikes(spark, sf), ["kind"], "value").select("kind", "n_values", r6("fence").alias("fence"))


@query("upper_fence_log", """SELECT l_returnflag, count(*) AS n_values, round(power(10.0, quantile_cont(x, 0.75) + 1.5*(quantile_cont(x, 0.75) - quantile_cont(x, 0.25))), 4) AS fence
 FROM (SELECT l_returnflag, log10(l_extendedprice) AS x FROM lineitem WHERE l_extendedprice > 0) GROUP BY 1""")
def _(spark, sf):
    li = b.table(spark, sf, "lineitem")
    return th.upper_fence(li, ["l_returnflag"], "l_extendedprice", log=True).select(
        "l_returnflag", "n_values", r6("fence", 4).alias("fence"))


@query("quantiles", """SELECT l_returnflag, l_linestatus, count(*) AS n_values, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10,
 round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.975), 6) AS p97 FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    q = quantiles(b.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice",
                  {"p10": 0.1, "p50": 0.5, "p97": 0.975})
    return q.select("l_returnflag", "l_linestatus", "n_values", *[r6(c).alias(c) for c in ("p10", "p50", "p97")])


@query("average_rank", """SELECT p_partkey, CAST(rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS DOUBLE) AS avg_rank FROM part""")
def _(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey", "p_size")
    return average_rank(p, [], "p_size").select("p_partkey", F.col("avg_rank").cast("double").alias("avg_rank"))


@query("unit_locations", """SELECT user_id AS unit_id, round(median(value), 6) AS x, round(median(epoch_us(ts) % 3600000000 / 1e6), 6) AS y FROM events GROUP BY 1""")
def _(spark, sf):
    s = b.spikes(spark, sf).withColumn("y", (F.col("us") % b.HOUR_US) / 1e6)
    x = quantiles(s, ["unit_id"], "value", {"x": 0.5}).select("unit_id", "x")
    y = quantiles(s, ["unit_id"], "y", {"y": 0.5}).select("unit_id", "y")
    return x.join(y, "unit_id").select("unit_id", r6("x").alias("x"), r6("y").alias("y"))


EM_ROUNDS = 12
_EM = f"""WITH RECURSIVE d AS (SELECT event_type AS kind, log10(greatest(value, 0.001)) AS x FROM events),
i0 AS (SELECT kind, count(*) AS total, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS m1, quantile_cont(x, 0.75) AS m2,
  greatest(sum(x*x)/count(*) - (sum(x)/count(*))*(sum(x)/count(*)), 1e-12) AS v FROM d GROUP BY 1),
em AS (SELECT 0 AS it, kind, total, lo, hi, m1, m2, v AS v1, v AS v2, CAST(0.5 AS DOUBLE) AS w1 FROM i0
 UNION ALL SELECT it + 1, kind, total, lo, hi, x1/r1, x2/r2, greatest(xx1/r1 - (x1/r1)*(x1/r1), 1e-12), greatest(xx2/r2 - (x2/r2)*(x2/r2), 1e-12), r1/total FROM
  (SELECT it, kind, any_value(total) AS total, any_value(lo) AS lo, any_value(hi) AS hi, sum(r) AS r1, sum(r*x) AS x1, sum(r*x*x) AS xx1, sum(1-r) AS r2, sum((1-r)*x) AS x2, sum((1-r)*x*x) AS xx2 FROM
   (SELECT em.it, em.kind, em.total, em.lo, em.hi, x, (w1*exp(-(x-m1)*(x-m1)/(2*v1))/sqrt(v1)) / (w1*exp(-(x-m1)*(x-m1)/(2*v1))/sqrt(v1) + (1-w1)*exp(-(x-m2)*(x-m2)/(2*v2))/sqrt(v2)) AS r
    FROM em JOIN d ON d.kind = em.kind WHERE em.it < {{rounds}}) GROUP BY it, kind))"""


@query("gaussian_pair", _EM.format(rounds=EM_ROUNDS) + f" SELECT kind, round(m1, 6) AS m1, round(m2, 6) AS m2, round(v1, 6) AS v1, round(v2, 6) AS v2, round(w1, 6) AS w1 FROM em WHERE it = {EM_ROUNDS}")
def _(spark, sf):
    s = b.spikes(spark, sf).select("kind", F.log10(F.greatest("value", F.lit(0.001))).alias("x"))
    fit = th.gaussian_pair(s, ["kind"], "x", EM_ROUNDS)
    return fit.select("kind", *[r6(c).alias(c) for c in ("m1", "m2", "v1", "v2", "w1")])


@query("bimodality_score", _EM.format(rounds=20) + " SELECT kind, total AS n_values, round(CASE WHEN total >= 50 AND hi > lo THEN abs(m1 - m2) / greatest(sqrt((v1 + v2)/2), 1e-12) END, 6) AS score FROM em WHERE it = 20")
def _(spark, sf):
    s = b.spikes(spark, sf).select("kind", F.log10(F.greatest("value", F.lit(0.001))).alias("x"))
    return th.bimodality_score(s, ["kind"], "x").select("kind", "n_values", r6("score").alias("score"))


_ALL_EM = _EM.format(rounds=20).replace("SELECT event_type AS kind,", "SELECT 0 AS kind,")


@query("movement_threshold", _ALL_EM + """, p AS (SELECT CASE WHEN m1 <= m2 THEN m1 ELSE m2 END AS a, CASE WHEN m1 <= m2 THEN v1 ELSE v2 END AS va, CASE WHEN m1 <= m2 THEN w1 ELSE 1-w1 END AS wa,
 CASE WHEN m1 <= m2 THEN m2 ELSE m1 END AS c, CASE WHEN m1 <= m2 THEN v2 ELSE v1 END AS vc, CASE WHEN m1 <= m2 THEN 1-w1 ELSE w1 END AS wc FROM em WHERE it = 20),
g AS (SELECT r.range AS i, a + (c-a)*r.range/999 AS x, sign((ln(wa) - 0.5*ln(va) - (a + (c-a)*r.range/999 - a)*(a + (c-a)*r.range/999 - a)/(2*va)) - (ln(wc) - 0.5*ln(vc) - (a + (c-a)*r.range/999 - c)*(a + (c-a)*r.range/999 - c)/(2*vc))) AS s FROM p, range(1000) r),
n AS (SELECT *, lead(s) OVER (ORDER BY i) AS sn FROM g)
SELECT round(coalesce((SELECT x FROM n WHERE sn IS NOT NULL AND sn <> s ORDER BY i LIMIT 1), (SELECT median(x) FROM d)), 6) AS threshold_log10""")
def _(spark, sf):
    value = th.movement_threshold(b.spikes(spark, sf), "value")
    return spark.createDataFrame([(value,)], "threshold_log10 double").select(r6("threshold_log10").alias("threshold_log10"))
