"""Queries: correlations between units, rings, and comparisons of rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.angles import r6, wrap360
from ..operators import blocks as bl
from ..operators import pairs as pr
from ..operators import ring as rg
from ..operators.nulls import draw_orders, judge
from . import bindings as b
from .angles import w360_sql, wrap_sql
from .registry import query

UNITS = 64
DUR = 0.5
SIGMA, MAX_LAG, START_LAG = 1.0, 12, 6
_W = bl.gaussian_kernel(SIGMA)
_R = len(_W) // 2


def population(spark, sf):
    """Bins of all channels: one array of counts per bin, a bin length and a mask."""
    e = b.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("bin"), F.transform("embedding", lambda x: x.cast("double") * 10).alias("counts"),
                    F.lit(DUR).alias("dur"), (F.col("label") != 3).alias("kept"), F.col("label").alias("session"))


POP = f"""x0 AS (SELECT vec_id AS t, label <> 3 AS m, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding)::DOUBLE * 10 / {DUR} AS v FROM embeddings),
kn(k, w) AS (VALUES {', '.join(f'({i - _R}, {float(w)!r}::DOUBLE)' for i, w in enumerate(_W))}),
xs AS (SELECT a.t, a.m, a.c, sum(w * q.v) AS s FROM x0 a, kn JOIN x0 q ON q.t = a.t + k AND q.c = a.c GROUP BY 1, 2, 3)"""


@query("smoothed_rates", f"WITH {POP} SELECT t AS bin, c AS unit, round(s, 6) + 0.0 AS rate FROM xs")
def _(spark, sf):
    s = bl.smoothed_rates(population(spark, sf), [], "bin", "counts", "dur", SIGMA)
    return s.select("bin", F.posexplode("rates").alias("unit", "rate")).select("bin", F.col("unit").cast("bigint").alias("unit"), r6("rate").alias("rate"))


@query("pair_counts", f"""WITH m AS (SELECT vec_id AS t FROM embeddings WHERE label <> 3), l AS (SELECT r.range AS lag FROM range({MAX_LAG + 1}) r)
SELECT lag, count(b.t) AS n_pairs FROM l, m a LEFT JOIN m b ON b.t = a.t + lag GROUP BY 1""")
def _(spark, sf):
    return pr.pair_counts(population(spark, sf), [], "bin", "kept", MAX_LAG)


_CORR = POP + f""", xm AS (SELECT c, avg(s) AS mu, stddev_pop(s) AS sd FROM xs WHERE m GROUP BY 1),
xc AS MATERIALIZED (SELECT t, xs.c, s - mu AS z FROM xs JOIN xm ON xm.c = xs.c WHERE m),
zc AS (SELECT a.c AS i, b.c AS j, avg(a.z * b.z) AS zero FROM xc a JOIN xc b ON a.t = b.t GROUP BY 1, 2)"""
_BASE = _CORR + f""", lg AS (SELECT r.range - {MAX_LAG} AS lag FROM range({2 * MAX_LAG + 1}) r WHERE abs(r.range - {MAX_LAG}) >= {START_LAG}),
mk AS (SELECT DISTINCT t FROM xc), ln AS (SELECT lag, count(*) AS n FROM lg, mk a JOIN mk b ON b.t = a.t + lag GROUP BY 1),
lc AS (SELECT a.c AS i, b.c AS j, lag, sum(a.z * b.z) AS p FROM ln, xc b JOIN xc a ON a.t = b.t + lag GROUP BY 1, 2, 3),
bc AS (SELECT i, j, avg(p / n) AS base FROM lc JOIN ln ON ln.lag = lc.lag GROUP BY 1, 2),
pc AS (SELECT z.i, z.j, zero / (a.sd * b.sd) AS zero_lag, (p.base + q.base) / 2 / (a.sd * b.sd) AS baseline FROM zc z JOIN bc p ON p.i = z.i AND p.j = z.j JOIN bc q ON q.i = z.j AND q.j = z.i JOIN xm a ON a.c = z.i JOIN xm b ON b.c = z.j)"""


def correlations(spark, sf):
    return pr.pairwise_correlations(population(spark, sf), [], "bin", "counts", "dur", "kept", SIGMA, MAX_LAG, START_LAG)


@query("pairwise_correlations", f"WITH {_BASE} SELECT i, j, round(zero_lag, 6) + 0.0 AS zero_lag, round(baseline, 6) + 0.0 AS baseline, round(zero_lag - baseline, 6) + 0.0 AS metric FROM pc")
def _(spark, sf):
    return correlations(spark, sf).select("i", "j", *[r6(c).alias(c) for c in ("zero_lag", "baseline", "metric")])


@query("gram", """WITH x AS (SELECT vec_id AS t, label, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT a.label AS session, a.c AS i, b.c AS j, round(sum(a.v * b.v), 6) + 0.0 AS s FROM x a JOIN x b ON a.t = b.t GROUP BY 1, 2, 3""")
def _(spark, sf):
    e = b.table(spark, sf, "embeddings").select(F.col("label").alias("session"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return bl.gram(e, ["session"], "v", "v").select("session", "i", "j", r6("s").alias("s"))


@query("pair_correlogram", f"""WITH k AS (SELECT vec_id AS t, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings WHERE label <> 3),
s AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM k)
SELECT r.range - {MAX_LAG} AS lag, count(*) AS n_pairs, round(avg((x.a - ma)*(y.b - mb)) / any_value(sa) / any_value(sb), 6) + 0.0 AS r FROM s, range({2 * MAX_LAG + 1}) r, k x JOIN k y ON y.t = x.t - (r.range - {MAX_LAG}) GROUP BY 1""")
def _(spark, sf):
    p = population(spark, sf).withColumns({"a": F.col("counts")[0], "b": F.col("counts")[1]})
    return pr.pair_correlogram(p, [], "bin", "a", "b", "kept", MAX_LAG).select("lag", "n_pairs", r6("r").alias("r"))


@query("masked_rates", f"""SELECT c AS unit, round(sum(v) / (count(*) * {DUR}), 6) + 0.0 AS rate_hz FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding)::DOUBLE * 10 AS v FROM embeddings) WHERE label <> 3 GROUP BY 1""")
def _(spark, sf):
    return pr.masked_rates(population(spark, sf), [], "counts", "dur", "kept").select("unit", r6("rate_hz").alias("rate_hz"))


@query("wide_counts", f"""WITH {b.SPIKES}, bn AS (SELECT DISTINCT session, CAST(floor(us/{b.HOUR_US}.0) AS BIGINT) AS bin FROM sp), k AS (SELECT session, CAST(floor(us/{b.HOUR_US}.0) AS BIGINT) AS bin, kind, count(*) AS n FROM sp WHERE kind <> 'error' GROUP BY 1, 2, 3),
u(kind, o) AS (VALUES ('view', 0), ('click', 1), ('signup', 2)) SELECT bn.session, bn.bin, to_json(list(coalesce(n, 0) ORDER BY o))::VARCHAR AS counts FROM bn CROSS JOIN u LEFT JOIN k ON k.session = bn.session AND k.bin = bn.bin AND k.kind = u.kind GROUP BY 1, 2""")
def _(spark, sf):
    s = b.spikes(spark, sf).withColumn("bin", F.floor(F.col("us") / b.HOUR_US).cast("bigint"))
    counts = s.where("kind <> 'error'").groupBy("session", "bin", "kind").agg(F.count("*").alias("n"))
    w = pr.wide_counts(counts, s.select("session", "bin").distinct(), ["session"], "bin", "kind", "n", ["view", "click", "signup"])
    return w.select("session", "bin", F.to_json("counts").alias("counts"))


@query("auc", """WITH j AS (SELECT lang, quality = 1 AS pos, n_chars AS s FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1)/2.0 AS k FROM j)
SELECT lang, count(*) FILTER (pos) AS n_positive, count(*) FILTER (NOT pos) AS n_negative, round((sum(k) FILTER (pos) - count(*) FILTER (pos)*(count(*) FILTER (pos) + 1)/2.0)/nullif(count(*) FILTER (pos) * count(*) FILTER (NOT pos), 0), 6) AS auc FROM r GROUP BY 1""")
def _(spark, sf):
    d = b.table(spark, sf, "labels").join(b.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    d = d.select("lang", (F.col("quality") == 1).alias("pos"), F.col("n_chars").alias("s"))
    return pr.auc(d, ["lang"], "pos", "s").withColumn("auc", r6("auc"))


@query("rank_correlation", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1)/2.0 AS a,
 rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1)/2.0 AS b FROM lineitem) SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) + 0.0 AS rho FROM r GROUP BY 1""")
def _(spark, sf):
    return pr.rank_correlation(b.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("rho", r6("rho"))


@query("pearson", "SELECT l_linestatus, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS r FROM lineitem GROUP BY 1")
def _(spark, sf):
    return pr.pearson(b.table(spark, sf, "lineitem"), ["l_linestatus"], "l_quantity", "l_extendedprice").withColumn("r", r6("r"))


@query("binned_mean", """SELECT l_linestatus, CAST(floor(l_quantity / 5.0) AS BIGINT) AS bin, count(*) AS n, round(CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE)/count(*), 5) AS mean, round(stddev_samp(l_discount*100)/sqrt(count(*)), 6) AS sem, (floor(l_quantity / 5.0) + 0.5)*5.0 AS centre FROM lineitem WHERE l_quantity < 50 GROUP BY ALL""")
def _(spark, sf):
    li = b.table(spark, sf, "lineitem").withColumn("d", F.col("l_discount") * 100)
    m = pr.binned_mean(li, ["l_linestatus"], "l_quantity", "d", 0.0, 5.0, 10)
    return m.select("l_linestatus", "bin", "n", r6("mean", 5).alias("mean"), r6("sem").alias("sem"), "centre")


# ── rings ───────────────────────────────────────────────────────────────
def angles_of(pairs):
    """A fixed arrangement of the channels on a ring, for queries that do not embed."""
    return pairs.select(F.col("i").alias("unit")).distinct().withColumn("angle_deg", wrap360(F.col("unit") * 67.5 + F.col("unit") * F.col("unit")))


_ANGLE = w360_sql("c * 67.5 + c * c")


@query("embed_pairs")
def _(spark, sf):
    return rg.embed_pairs(correlations(spark, sf), [], "metric", 8)


@query("fit_ring")
def _(spark, sf):
    from ..plans.ring_session import fit_ring

    out = fit_ring(population(spark, sf), [], "bin", "counts", "dur", "kept", SIGMA, MAX_LAG, START_LAG, k_neighbors=8,
                   min_rate_hz=-100.0, min_partner_snr=None)
    return out["units"]


@query("standardised_pairs", f"WITH {_CORR}, k AS (SELECT i, j, zero / (a.sd * b.sd) AS r FROM zc JOIN xm a ON a.c = i JOIN xm b ON b.c = j WHERE i <> j) SELECT i, j, round((r - (SELECT avg(r) FROM k)) / (SELECT stddev_samp(r) FROM k), 5) + 0.0 AS corr_z FROM k")
def _(spark, sf):
    return rg.standardised_pairs(correlations(spark, sf), [], "zero_lag").select("i", "j", r6("corr_z", 5).alias("corr_z"))


@query("ring_coupling", f"""WITH {_CORR}, k AS (SELECT i, j, zero / (a.sd * b.sd) AS r FROM zc JOIN xm a ON a.c = i JOIN xm b ON b.c = j WHERE i <> j), an AS (SELECT DISTINCT c, {_ANGLE} AS a FROM x0),
q AS (SELECT i, j, r, cos(radians(p.a - s.a)) AS cs FROM k JOIN an p ON p.c = i JOIN an s ON s.c = j)
SELECT i AS unit, round(regr_slope(r, cs), 6) + 0.0 AS coupling, round((SELECT corr(r, cs) FROM q WHERE i < j), 6) + 0.0 AS consistency_r FROM q GROUP BY 1""")
def _(spark, sf):
    p = correlations(spark, sf)
    slope, overall = rg.ring_coupling(p, [], angles_of(p), "zero_lag")
    return slope.select("unit", r6("coupling").alias("coupling")).withColumn("consistency_r", overall.select(r6("consistency_r").alias("c")).scalar())


@query("partner_snr", f"""WITH {_CORR}, k AS (SELECT i, j, zero / (a.sd * b.sd) AS r FROM zc JOIN xm a ON a.c = i JOIN xm b ON b.c = j WHERE i <> j), rk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY r DESC) AS n FROM k)
SELECT i AS unit, round((avg(r) - (SELECT median(r) FROM k)) / 0.05, 6) + 0.0 AS partner_snr FROM rk WHERE n <= 8 GROUP BY 1""")
def _(spark, sf):
    p = correlations(spark, sf).withColumn("noise", F.lit(0.05))
    return rg.partner_snr(p, [], "zero_lag", "noise", 8).select("unit", r6("partner_snr").alias("partner_snr"))


_RING = f"rn AS (SELECT DISTINCT c, {_ANGLE} AS a, (c % 7 - 1) / 5.0 AS raw FROM x0), rw AS (SELECT c, a, greatest(raw, 0) / max(greatest(raw, 0)) OVER () AS w FROM rn)"


def ring_units(spark, sf):
    """The fixed arrangement with made-up couplings, weighted by them."""
    n = b.table(spark, sf, "embeddings").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.size("embedding").cast("bigint") - 1)).alias("unit")).distinct()
    ring = n.withColumns({"angle_deg": wrap360(F.col("unit") * 67.5 + F.col("unit") * F.col("unit")), "coupling": (F.col("unit") % 7 - 1) / 5.0, "radius": F.lit(1.0)})
    return rg.unit_weights(ring, [], "coupling")


@query("unit_weights", f"WITH {POP}, {_RING} SELECT c AS unit, round(w, 6) AS weight FROM rw")
def _(spark, sf):
    return ring_units(spark, sf).select("unit", r6("weight").alias("weight"))


@query("ring_members", f"WITH {POP}, {_RING} SELECT c AS unit, rank() OVER (ORDER BY a, c) - 1 AS position FROM rn WHERE raw >= 0.5")
def _(spark, sf):
    from ..operators.scan import number_rows

    return number_rows(ring_units(spark, sf).where("coupling >= 0.5"), [], ["angle_deg", "unit"], "position").select("unit", "position")


_PV = f"""{_RING}, zs AS (SELECT t, x0.c, (v - avg(v) OVER (PARTITION BY x0.c)) / stddev_pop(v) OVER (PARTITION BY x0.c) AS z FROM x0),
pv AS (SELECT t, sum(z*w*cos(radians(a))) AS x, sum(z*w*sin(radians(a))) AS y, sum(abs(z)*w) AS n FROM zs JOIN rw ON rw.c = zs.c GROUP BY 1)"""


def vectors(spark, sf):
    p = population(spark, sf).withColumn("rates", F.transform("counts", lambda x: x / DUR))
    return rg.population_vector(p, [], "bin", "rates", ring_units(spark, sf))


@query("population_vector", f"WITH {POP}, {_PV} SELECT t AS bin, round({w360_sql('degrees(atan2(y, x))')}, 4) AS ring_deg, round(CASE WHEN n > 0 THEN sqrt(x*x+y*y)/n ELSE 0 END, 6) AS length FROM pv")
def _(spark, sf):
    return vectors(spark, sf).select("bin", r6("ring_deg", 4).alias("ring_deg"), r6("length").alias("length"))


_ORDERS = draw_orders(20, UNITS, seed=1)
_PERM = "pm(shuffle, p, q) AS (VALUES " + ", ".join(f"({s}, {p}, {q})" for s, o in enumerate([list(range(UNITS)), *_ORDERS], start=-1) for p, q in enumerate(o)) + ")"
_CHAN = f"cm AS (SELECT c, {w360_sql('round(avg(v), 6) * 400')} AS a, {w360_sql('round(stddev_pop(v), 6) * 900 + c * 3')} AS r FROM x0 GROUP BY c)"


def channel_angles(spark, sf):
    """Two angles per channel: one from its mean, one from its spread."""
    p = population(spark, sf).select(F.posexplode("counts").alias("unit", "k")).groupBy(F.col("unit").cast("bigint").alias("unit")).agg(
        F.round(F.avg(F.col("k") / DUR), 6).alias("m"), F.round(F.stddev_pop(F.col("k") / DUR), 6).alias("s"))
    return p.select("unit", wrap360(F.col("m") * 400).alias("a"), wrap360(F.col("s") * 900 + F.col("unit") * 3).alias("r"))


@query("compare_angles", f"""WITH {POP}, {_CHAN}, {_PERM}, mp AS (SELECT shuffle, x.a, y.r FROM pm JOIN cm x ON x.c = p JOIN cm y ON y.c = q),
s AS (SELECT shuffle, avg(cos(radians(r-a))) AS cp, avg(sin(radians(r-a))) AS sp, avg(cos(radians(r+a))) AS cn, avg(sin(radians(r+a))) AS sn FROM mp GROUP BY 1),
f AS (SELECT shuffle, cn*cn+sn*sn > cp*cp+sp*sp AS flip, CASE WHEN cn*cn+sn*sn > cp*cp+sp*sp THEN degrees(atan2(sn, cn)) ELSE degrees(atan2(sp, cp)) END AS o FROM s),
e AS (SELECT mp.shuffle, median(abs({wrap_sql('(CASE WHEN flip THEN -a ELSE a END) + o - r')})) AS v FROM mp JOIN f ON f.shuffle = mp.shuffle GROUP BY 1)
SELECT round((SELECT v FROM e WHERE shuffle = -1), 4) AS observed, round((1 + count(*) FILTER (v <= (SELECT v FROM e WHERE shuffle = -1))) / 21.0, 6) AS p_value FROM e WHERE shuffle >= 0""")
def _(spark, sf):
    seen, null = rg.compare_angles(channel_angles(spark, sf), "a", "r", ["unit"], _ORDERS)
    return judge(null, seen, [], "median_abs_error_deg").select(r6("observed", 4).alias("observed"), r6("p_value").alias("p_value"))


@query("structure_test", f"""WITH {_CORR}, {_PERM}, {_CHAN}, px AS (SELECT i, j, zero / (a.sd * b.sd) AS x FROM zc JOIN xm a ON a.c = i JOIN xm b ON b.c = j WHERE i < j),
py AS (SELECT x.c AS i, y.c AS j, cos(radians(x.a - y.a)) AS y FROM cm x, cm y WHERE x.c <> y.c),
r AS (SELECT u.shuffle, corr(x, y) AS v FROM px JOIN pm u ON u.p = px.i JOIN pm w ON w.p = px.j AND w.shuffle = u.shuffle JOIN py ON py.i = u.q AND py.j = w.q GROUP BY 1)
SELECT round((SELECT v FROM r WHERE shuffle = -1), 6) + 0.0 AS observed, round((1 + count(*) FILTER (v >= (SELECT v FROM r WHERE shuffle = -1))) / 21.0, 6) AS p_value FROM r WHERE shuffle >= 0""")
def _(spark, sf):
    corr = correlations(spark, sf).where("i <> j")
    a = channel_angles(spark, sf)
    x = corr.select("i", "j", F.col("zero_lag").alias("v"))
    # the second table covers the same ordered pairs as the first
    y = corr.select("i", "j").join(a.select(F.col("unit").alias("i"), F.col("a").alias("p")), "i").join(
        a.select(F.col("unit").alias("j"), F.col("a").alias("q")), "j").select("i", "j", F.cos(F.radians(F.col("p") - F.col("q"))).alias("v"))
    units = a.select("unit", F.col("unit").alias("p"))
    seen, null = pr.structure_test(x, y, units, _ORDERS)
    return judge(null, seen, [], "structure_r").select(r6("observed").alias("observed"), r6("p_value").alias("p_value"))


_RVT = f"""sc AS (SELECT c AS unit, CASE WHEN c % 5 = 0 THEN 'silent' WHEN c % 4 = 0 THEN 'no partners' ELSE 'ring' END AS status, a / 100 AS partner_snr FROM cm),
rvt AS (SELECT sc.unit, status, partner_snr, CASE WHEN status = 'ring' THEN (sc.unit % 7 - 1)/5.0 END AS coupling, CASE WHEN sc.unit % 3 > 0 THEN r END AS preferred_deg, coalesce(r > 90 AND sc.unit % 3 > 0, false) AS tuned FROM sc JOIN cm ON c = sc.unit)"""


def _versus(spark, sf):
    a = channel_angles(spark, sf)
    u = F.col("unit")
    screen = a.select("unit", F.when(u % 5 == 0, "silent").when(u % 4 == 0, "no partners").otherwise("ring").alias("status"), (F.col("a") / 100).alias("partner_snr"))
    ring = screen.where("status = 'ring'").select("unit", F.lit(0.0).alias("angle_deg"), F.lit(1.0).alias("radius"), ((u % 7 - 1) / 5.0).alias("coupling"))
    stats = a.where(u % 3 > 0).select("unit", F.col("r").alias("preferred_deg"), F.lit(0.5).alias("mvl"), (F.col("r") > 90).alias("significant"))
    return pr.ring_vs_tuning_table(screen, ring, stats)


@query("ring_vs_tuning", f"WITH {POP}, {_CHAN}, {_RVT} SELECT unit, status, round(partner_snr, 5) AS partner_snr, round(coupling, 6) AS coupling, round(preferred_deg, 4) AS preferred_deg, tuned, coalesce(coupling >= 0.5, false) AS member FROM rvt")
def _(spark, sf):
    t = _versus(spark, sf)
    return t.select("unit", "status", r6("partner_snr", 5).alias("partner_snr"), r6("coupling").alias("coupling"), r6("preferred_deg", 4).alias("preferred_deg"), "tuned", "member")


@query("ring_vs_tuning_auc", f"""WITH {POP}, {_CHAN}, {_RVT}, r AS (SELECT *, rank() OVER (ORDER BY partner_snr) + (count(*) OVER (PARTITION BY partner_snr) - 1)/2.0 AS k FROM rvt)
SELECT round((sum(k) FILTER (tuned) - count(*) FILTER (tuned)*(count(*) FILTER (tuned) + 1)/2.0)/(count(*) FILTER (tuned) * count(*) FILTER (NOT tuned)), 6) AS auc FROM r""")
def _(spark, sf):
    return pr.auc(_versus(spark, sf), [], "tuned", "partner_snr").select(r6("auc").alias("auc"))


@query("ring_tuning_crosstab", f"""WITH {POP}, {_CHAN}, {_RVT} SELECT tuned, count(*) FILTER (status = 'ring') AS "ring", count(*) FILTER (status = 'no partners') AS "no partners", count(*) FILTER (status = 'silent') AS "silent" FROM rvt GROUP BY 1""")
def _(spark, sf):
    return pr.crosstab(_versus(spark, sf), "tuned", "status", ["ring", "no partners", "silent"])


@query("ring_difference_curve", f"""WITH {_CORR}, {_CHAN}, k AS (SELECT i, j, zero / (a.sd * b.sd) AS r FROM zc JOIN xm a ON a.c = i JOIN xm b ON b.c = j WHERE i <> j), z AS (SELECT i, j, (r - (SELECT avg(r) FROM k)) / (SELECT stddev_samp(r) FROM k) AS z FROM k WHERE i < j),
d AS (SELECT z, round(abs({wrap_sql('x.r - y.r')}), 9) AS d FROM z JOIN cm x ON x.c = i JOIN cm y ON y.c = j)
SELECT CAST(least(floor(d / 15.0), 11) AS BIGINT) AS bin, count(*) AS n, round(avg(z), 5) + 0.0 AS mean_z, round(stddev_samp(z)/sqrt(count(*)), 5) AS sem_z FROM d GROUP BY 1""")
def _(spark, sf):
    z = rg.standardised_pairs(correlations(spark, sf), [], "zero_lag")
    c = pr.difference_curve(z, channel_angles(spark, sf).select("unit", F.col("r").alias("preferred_deg")), 15.0)
    return c.select("bin", "n", r6("mean", 5).alias("mean_z"), r6("sem", 5).alias("sem_z"))


# ── ring decoding ───────────────────────────────────────────────────────
_HEAD = f"hd AS (SELECT vec_id AS t, {w360_sql('round(embedding[1]::DOUBLE * 700, 6)')} AS heading, vec_id % 10 < 7 AS train FROM embeddings)"
_FIT = f"""{_PV}, {_HEAD}, ve AS (SELECT pv.t, {w360_sql('degrees(atan2(y, x))')} AS ring_deg, heading, train FROM pv JOIN hd ON hd.t = pv.t)"""


def headed(spark, sf):
    e = b.table(spark, sf, "embeddings")
    h = e.select(F.col("vec_id").alias("bin"), wrap360(F.round(F.col("embedding")[0].cast("double") * 700, 6)).alias("heading"),
                 (F.col("vec_id") % 10 < 7).alias("train"))
    return population(spark, sf).withColumn("rates", F.transform("counts", lambda x: x / DUR)).join(h, "bin")


@query("decode_ring", f"""WITH {POP}, {_FIT}, s AS (SELECT avg(cos(radians(heading - ring_deg))) AS cp, avg(sin(radians(heading - ring_deg))) AS sp_, avg(cos(radians(heading + ring_deg))) AS cm, avg(sin(radians(heading + ring_deg))) AS sm FROM ve WHERE train),
f AS (SELECT cm*cm+sm*sm > cp*cp+sp_*sp_ AS flip, CASE WHEN cm*cm+sm*sm > cp*cp+sp_*sp_ THEN degrees(atan2(sm, cm)) ELSE degrees(atan2(sp_, cp)) END AS o FROM s)
SELECT t AS bin, round({w360_sql('(CASE WHEN flip THEN -ring_deg ELSE ring_deg END) + o')}, 4) AS decoded_deg FROM ve, f""")
def _(spark, sf):
    from ..plans.ring_session import decode_ring

    d = decode_ring(headed(spark, sf), [], "bin", "rates", ring_units(spark, sf).drop("weight"), "heading", "train")
    return d.select("bin", r6("decoded_deg", 4).alias("decoded_deg"))


_MOVES = [0, 41, 97, 133, 180, 222]


@query("ring_shift_null", f"""WITH {POP}, {_FIT}, sh(shuffle, d) AS (VALUES {', '.join(f'({i - 1}, {d})' for i, d in enumerate(_MOVES))}), n AS (SELECT count(*) AS n FROM hd),
pa AS (SELECT shuffle, ring_deg, hd.heading, ve.train FROM ve, n, sh JOIN hd ON hd.t = ((ve.t - d) % n + n) % n),
s AS (SELECT shuffle, avg(cos(radians(heading - ring_deg))) AS cp, avg(sin(radians(heading - ring_deg))) AS sp_, avg(cos(radians(heading + ring_deg))) AS cm, avg(sin(radians(heading + ring_deg))) AS sm FROM pa WHERE train GROUP BY 1),
f AS (SELECT shuffle, cm*cm+sm*sm > cp*cp+sp_*sp_ AS flip, CASE WHEN cm*cm+sm*sm > cp*cp+sp_*sp_ THEN degrees(atan2(sm, cm)) ELSE degrees(atan2(sp_, cp)) END AS o FROM s)
SELECT pa.shuffle, round(median(abs({wrap_sql('(CASE WHEN flip THEN -ring_deg ELSE ring_deg END) + o - heading')})), 4) AS value FROM pa JOIN f ON f.shuffle = pa.shuffle WHERE NOT train GROUP BY 1""")
def _(spark, sf):
    from ..plans.ring_session import ring_shift_null

    h = headed(spark, sf)
    v = rg.population_vector(h, [], "bin", "rates", ring_units(spark, sf))
    out = ring_shift_null(v.where("train"), v.where("NOT train"), h, "bin", _MOVES[1:], h.count())
    return out.withColumn("value", r6("value", 4))


@query("ring_unit_null", f"""WITH {POP}, {_RING}, pm(shuffle, p, q) AS (VALUES {', '.join(f'({s}, {p}, {q})' for s, o in enumerate([list(range(UNITS)), *_ORDERS[:6]], start=-1) for p, q in enumerate(o))},),
zs AS (SELECT t, x0.c, (v - avg(v) OVER (PARTITION BY x0.c)) / stddev_pop(v) OVER (PARTITION BY x0.c) AS z FROM x0),
pv AS (SELECT shuffle, t, sum(z*u.w*cos(radians(a2.a))) AS x, sum(z*u.w*sin(radians(a2.a))) AS y, sum(abs(z)*u.w) AS n FROM zs JOIN pm ON p = zs.c JOIN rw u ON u.c = p JOIN rw a2 ON a2.c = q GROUP BY 1, 2)
SELECT shuffle, round(avg(sqrt(x*x+y*y)/n), 6) AS value FROM pv GROUP BY 1""".replace(",),", "),"))
def _(spark, sf):
    from ..plans.ring_session import ring_unit_null

    p = population(spark, sf).withColumn("rates", F.transform("counts", lambda x: x / DUR))
    return ring_unit_null(p, "bin", "rates", ring_units(spark, sf), _ORDERS[:6]).withColumn("value", r6("value"))


@query("run_ring")
def _(spark, sf):
    from ..plans.ring_session import run_ring

    h = headed(spark, sf).drop("rates").withColumn("test", ~F.col("train"))
    return run_ring(h, [], "bin", "counts", "dur", "heading", "train", "test", SIGMA, MAX_LAG, START_LAG, 8, -100.0, None)["metrics"]
