"""Queries: following units across recordings, and unit labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.angles import r6
from ..operators import curation as cu
from ..operators import matching as ma
from . import bindings as b
from .angles import wrap_sql
from .registry import query

RECORDINGS = [0, 1, 2]
# parts play the baseline's units, suppliers the other recordings' units, and each
# order line one observation of a pair; both directions come from different columns
MATCH = """pr AS (SELECT l_orderkey % 3 AS recording, l_partkey AS a, l_suppkey AS b,
 CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) % 997 AS BIGINT) / 996.0::DOUBLE AS f, CAST(sum(CAST(l_quantity AS BIGINT)*31 + l_orderkey) % 991 AS BIGINT) / 990.0::DOUBLE AS g FROM lineitem GROUP BY 1, 2, 3),
cd0 AS (SELECT recording, a AS ref_unit, b AS other_unit, f AS p_ref_row, g AS p_other_row, (f + g) / 2 AS p_avg FROM pr WHERE greatest(f, g) > {threshold}),
cd AS (SELECT *, count(*) OVER (PARTITION BY recording, ref_unit) AS n_ref_candidates, count(*) OVER (PARTITION BY recording, other_unit) AS n_other_candidates FROM cd0)"""


def match_scores(spark, sf):
    """Sparse score table in both directions, and the units of its rows."""
    li = b.table(spark, sf, "lineitem")
    pairs = li.groupBy((F.col("l_orderkey") % 3).alias("recording"), "l_partkey", "l_suppkey").agg(
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) % 997 / 996.0).alias("f"),
        (F.sum(F.col("l_quantity").cast("bigint") * 31 + F.col("l_orderkey")) % 991 / 990.0).alias("g"))
    other = -1 - F.col("l_suppkey")  # the other recording's rows are numbered below zero
    prob = pairs.select("recording", F.col("l_partkey").alias("row"), other.alias("col"), F.col("f").alias("p")).unionByName(
        pairs.select("recording", other.alias("row"), F.col("l_partkey").alias("col"), F.col("g").alias("p")))
    parts = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("row"), F.col("p_partkey").alias("unit_id"), F.lit("ref").alias("side"))
    suppliers = b.table(spark, sf, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("row"), F.col("s_suppkey").alias("unit_id"), F.lit("other").alias("side"))
    return prob, parts.unionByName(suppliers)


def candidates(spark, sf, threshold):
    prob, units = match_scores(spark, sf)
    return ma.putative_matches(prob, units, ["recording"], threshold)


@query("putative_matches", f"""WITH {MATCH.format(threshold=0.9)} SELECT recording, ref_unit, other_unit, round(p_ref_row, 6) AS p_ref_row, round(p_other_row, 6) AS p_other_row,
 round(p_avg, 6) AS p_avg, n_ref_candidates, n_other_candidates FROM cd""")
def _(spark, sf):
    c = candidates(spark, sf, 0.9)
    return c.select("recording", "ref_unit", "other_unit", *[r6(x).alias(x) for x in ("p_ref_row", "p_other_row", "p_avg")],
                    "n_ref_candidates", "n_other_candidates")


def _directions(spark, sf):
    p = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("unit_id"), (F.col("p_size") * 7.3).alias("preferred_direction_deg"), (F.col("p_size") > 5).alias("significant"))
    s = b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("unit_id"), (F.col("s_suppkey") % 50 * 7.3 + 20).alias("preferred_direction_deg"), (F.col("s_acctbal") > 0).alias("significant"))
    return p, s


@query("estimate_rotation", f"""WITH {MATCH.format(threshold=0.98)}, u AS (SELECT recording, radians((other_unit % 50 * 7.3 + 20) - p_size * 7.3) AS d FROM cd
 JOIN part ON p_partkey = ref_unit AND p_size > 5 JOIN supplier ON s_suppkey = other_unit AND s_acctbal > 0 WHERE n_ref_candidates = 1),
s AS (SELECT recording, avg(cos(d)) AS x, avg(sin(d)) AS y, count(*) AS n FROM u GROUP BY 1)
SELECT recording, CASE WHEN n >= 3 THEN round({wrap_sql('degrees(atan2(y, x))')}, 4) ELSE 0 END AS rotation_deg, CASE WHEN n >= 3 THEN round(sqrt(x*x + y*y), 6) END AS resultant_length, n AS n_pairs FROM s""")
def _(spark, sf):
    # every supplier is contested here, so unambiguous means a single candidate of the reference unit
    c = candidates(spark, sf, 0.98).where("n_ref_candidates = 1").withColumn("n_other_candidates", F.lit(1))
    p, s = _directions(spark, sf)
    rot = ma.estimate_rotation(c, p, s, ["recording"], 3)
    return rot.select("recording", r6("rotation_deg", 4).alias("rotation_deg"), r6("resultant_length").alias("resultant_length"), "n_pairs")


_MONTHS = """ca AS (SELECT l_partkey AS u, CAST(month(l_shipdate) - 1 AS BIGINT) AS angle_bin, count(*)::DOUBLE AS hz FROM lineitem GROUP BY 1, 2),
cb AS (SELECT l_suppkey AS u, CAST(month(l_shipdate) - 1 AS BIGINT) AS angle_bin, count(*)::DOUBLE AS hz FROM lineitem GROUP BY 1, 2),
gr AS (SELECT ref_unit, other_unit, r.range AS bin FROM (SELECT DISTINCT ref_unit, other_unit FROM cd), range(12) r),
sim AS (SELECT ref_unit, other_unit, CASE WHEN stddev_pop(coalesce(ca.hz, 0)) > 0 AND stddev_pop(coalesce(cb.hz, 0)) > 0 THEN corr(coalesce(ca.hz, 0), coalesce(cb.hz, 0)) END AS similarity FROM gr
 LEFT JOIN ca ON ca.u = ref_unit AND ca.angle_bin = bin LEFT JOIN cb ON cb.u = other_unit AND cb.angle_bin = (bin + 2) % 12 GROUP BY 1, 2)"""


def _month_curves(spark, sf, unit):
    li = b.table(spark, sf, "lineitem")
    cells = li.groupBy(F.col(unit).alias("unit_id"), (F.month("l_shipdate") - 1).cast("bigint").alias("angle_bin")).agg(
        F.count("*").cast("double").alias("hz"))
    grid = cells.select("unit_id").distinct().withColumn("angle_bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint"))))
    return grid.join(cells, ["unit_id", "angle_bin"], "left").withColumn("hz", F.coalesce("hz", F.lit(0.0)))


def _scored(spark, sf, threshold):
    c = candidates(spark, sf, threshold)
    pairs = c.select("ref_unit", "other_unit").distinct()
    sim = ma.tuning_similarity(pairs, _month_curves(spark, sf, "l_partkey"), _month_curves(spark, sf, "l_suppkey"), 12, 60.0)
    return c.join(sim, ["ref_unit", "other_unit"])


@query("tuning_similarity", f"WITH {MATCH.format(threshold=0.97)}, {_MONTHS} SELECT ref_unit, other_unit, round(similarity, 6) + 0.0 AS similarity FROM sim")
def _(spark, sf):
    return _scored(spark, sf, 0.97).select("ref_unit", "other_unit", r6("similarity").alias("similarity")).distinct()


def partners_sql(source: str, lead: str, scored: str) -> str:
    """Exact greedy choice as SQL: rounds of pairs that are best for both of their units."""
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY {lead} -p_avg, ref_unit, other_unit) - 1 AS rank FROM {source}),
g AS (SELECT 0 AS it, recording, ref_unit, other_unit, rank, false AS ok FROM rk UNION ALL
 SELECT it + 1, recording, ref_unit, other_unit, rank, m FROM (SELECT *, bool_or(m) OVER (PARTITION BY recording, ref_unit) AS mr, bool_or(m) OVER (PARTITION BY recording, other_unit) AS mo FROM
  (SELECT *, rank = min(rank) OVER (PARTITION BY recording, ref_unit) AND rank = min(rank) OVER (PARTITION BY recording, other_unit) AS m FROM g WHERE NOT ok)) WHERE m OR NOT (mr OR mo)),
ch AS (SELECT recording, ref_unit, other_unit, rank FROM g WHERE ok),
fin AS (SELECT rk.*, cr.rank AS rr, co.rank AS ro, co.ref_unit AS owner, min(rk.rank) OVER (PARTITION BY rk.recording, rk.ref_unit) AS best, coalesce(cr.rank = rk.rank, false) AS chosen
 FROM rk LEFT JOIN ch cr ON cr.recording = rk.recording AND cr.ref_unit = rk.ref_unit LEFT JOIN ch co ON co.recording = rk.recording AND co.other_unit = rk.other_unit),
pa AS (SELECT recording, ref_unit, other_unit, p_avg, rank, chosen, CASE WHEN NOT chosen AND rr < rank THEN 'not needed' WHEN NOT chosen THEN 'lost to unit ' || owner WHEN n_ref_candidates = 1 THEN 'only candidate'
 WHEN rank <> best THEN 'fallback' WHEN {scored} THEN 'best tuning similarity' ELSE 'highest average P' END AS reason FROM fin)"""


@query("select_partners_probability", f"WITH RECURSIVE {MATCH.format(threshold=0.9)}, {partners_sql('cd', '', 'false')} SELECT recording, ref_unit, other_unit, rank, chosen, reason FROM pa")
def _(spark, sf):
    return ma.select_partners(candidates(spark, sf, 0.9), ["recording"], "probability").select(
        "recording", "ref_unit", "other_unit", "rank", "chosen", "reason")


@query("select_partners_tuning", f"""WITH RECURSIVE {MATCH.format(threshold=0.97)}, {_MONTHS}, sc AS (SELECT cd.*, round(similarity, 9) AS similarity FROM cd JOIN sim USING (ref_unit, other_unit)),
{partners_sql('sc', 'CASE WHEN similarity IS NOT NULL THEN -similarity ELSE 2.0 END,', 'similarity IS NOT NULL')} SELECT recording, ref_unit, other_unit, rank, chosen, reason FROM pa""")
def _(spark, sf):
    scored = _scored(spark, sf, 0.97).withColumn("similarity", F.round("similarity", 9))
    return ma.select_partners(scored, ["recording"], "tuning").select(
        "recording", "ref_unit", "other_unit", "rank", "chosen", "reason")


_WIDE = ", ".join(f'max(CASE WHEN recording = {r} THEN other_unit END) AS "{r}_unit", round(max(CASE WHEN recording = {r} THEN p_avg END), 6) AS "{r}_p_avg"' for r in RECORDINGS)


@query("return_matches_wide", f"""WITH RECURSIVE {MATCH.format(threshold=0.95)}, {partners_sql('cd', '', 'false')}, w AS (SELECT ref_unit, {_WIDE} FROM pa WHERE chosen GROUP BY 1)
SELECT p_partkey AS unit_id, p_size > 5 AS tuned, w.* EXCLUDE (ref_unit) FROM part LEFT JOIN w ON ref_unit = p_partkey""")
def _(spark, sf):
    chosen = ma.select_partners(candidates(spark, sf, 0.95), ["recording"], "probability")
    base = b.table(spark, sf, "part").select(F.col("p_partkey").alias("unit_id"), (F.col("p_size") > 5).alias("tuned"))
    wide = ma.matched_wide(base, chosen, "recording", RECORDINGS)
    return wide.withColumns({f"{r}_p_avg": r6(F.col(f"{r}_p_avg")) for r in RECORDINGS})


@query("match_counts", f"""WITH {MATCH.format(threshold=0.9)} SELECT recording, count(DISTINCT ref_unit) AS with_candidate, count(DISTINCT CASE WHEN n_ref_candidates > 1 THEN ref_unit END) AS with_several,
 count(DISTINCT CASE WHEN n_other_candidates > 1 THEN other_unit END) AS contested FROM cd GROUP BY 1""")
def _(spark, sf):
    return ma.match_counts(candidates(spark, sf, 0.9), ["recording"])


@query("probe_drift", f"""WITH {MATCH.format(threshold=0.9)} SELECT recording, count(*) AS n_pairs, round(median(s_acctbal - p_retailprice), 6) AS drift FROM cd
 JOIN part ON p_partkey = ref_unit JOIN supplier ON s_suppkey = other_unit GROUP BY 1""")
def _(spark, sf):
    p = b.table(spark, sf, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_retailprice").alias("depth"))
    s = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit_id"), F.col("s_acctbal").alias("depth"))
    return ma.probe_drift(candidates(spark, sf, 0.9), p, s, ["recording"]).withColumn("drift", r6("drift"))


@query("decoder_units", f"""WITH {MATCH.format(threshold=0.9)}, f AS (SELECT ref_unit, count(DISTINCT recording) AS n FROM cd JOIN part ON p_partkey = ref_unit AND p_size > 5 WHERE p_avg > 0.6 GROUP BY 1)
SELECT ref_unit, n = 3 AS joint, n AS n_recordings FROM f""")
def _(spark, sf):
    c = candidates(spark, sf, 0.9).withColumn("chosen", F.col("p_avg") > 0.6)
    tuned = b.table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("unit_id"))
    either = ma.decoder_units(c, tuned, "recording", RECORDINGS, "pairwise")
    both = ma.decoder_units(c, tuned, "recording", RECORDINGS, "joint").select("ref_unit", F.lit(True).alias("joint"))
    return either.join(both, "ref_unit", "left").select("ref_unit", F.coalesce("joint", F.lit(False)).alias("joint"), "n_recordings")


@query("ring_band", "SELECT p_type, round(quantile_cont(p_retailprice, 0.1) - 100, 6) AS low, round(quantile_cont(p_retailprice, 0.9) + 100, 6) AS high FROM part GROUP BY 1")
def _(spark, sf):
    from ..operators.quantiles import quantiles

    q = quantiles(b.table(spark, sf, "part"), ["p_type"], "p_retailprice", {"a": 0.1, "z": 0.9})
    return q.select("p_type", r6(F.col("a") - 100).alias("low"), r6(F.col("z") + 100).alias("high"))


@query("control_band_runs", """WITH d AS (SELECT p_brand, p_size AS depth, count(*) AS n FROM part GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN depth < 20 THEN 'below' WHEN depth > 30 THEN 'above' END AS side FROM d),
r AS (SELECT *, sum(n) OVER (PARTITION BY p_brand, side ORDER BY depth) AS upto FROM s WHERE side IS NOT NULL)
SELECT a.p_brand, a.side, a.depth AS first, z.depth AS last, z.depth - a.depth AS span FROM r a JOIN r z ON a.p_brand = z.p_brand AND a.side = z.side AND a.upto - a.n = z.upto - 12""")
def _(spark, sf):
    d = b.table(spark, sf, "part").groupBy("p_brand", F.col("p_size").alias("depth")).agg(F.count("*").alias("n"))
    d = d.withColumns({"low": F.lit(20), "high": F.lit(30)})
    return ma.control_band_candidates(d, ["p_brand"], 12, "low", "high").select("p_brand", "side", "first", "last", "span")


@query("control_band", """WITH d AS (SELECT p_brand, CASE WHEN p_size < 19 THEN 'below' WHEN p_size > 31 THEN 'above' END AS side, p_size::DOUBLE AS d, count(*) AS n FROM part GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER w AS upto, lag(d) OVER w AS pv, lead(d) OVER w AS nx FROM d WHERE side IS NOT NULL WINDOW w AS (PARTITION BY p_brand, side ORDER BY d)),
j AS (SELECT a.p_brand, a.side, a.d AS f, z.d AS l, coalesce(a.pv + 1e-6, CASE WHEN a.side = 'below' THEN a.d ELSE 31 + 1e-6 END) AS fl, coalesce(z.nx - 1e-6, CASE WHEN a.side = 'below' THEN 19 - 1e-6 ELSE z.d END) AS ce FROM r a JOIN r z ON a.p_brand = z.p_brand AND a.side = z.side AND a.upto - a.n = z.upto - 12),
w AS (SELECT *, least(greatest(10.0::DOUBLE, l - f), ce - fl) AS w FROM j WHERE fl <= f AND ce >= l),
s AS (SELECT *, least(greatest((f + l - w)/2, greatest(fl, l - w)), least(f, ce - w)) AS st FROM w),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(abs(w - 10), 9), round(-(CASE WHEN side = 'below' THEN 20 - (st + w) ELSE st - 30 END), 9), st) AS rn FROM s)
SELECT p_brand, side, round(st, 5) AS start, round(st + w, 5) AS stop FROM b WHERE rn = 1""")
def _(spark, sf):
    p = b.table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    band = ma.control_band(p, ["p_brand"], "p_size", 20.0, 30.0, 12, gap=1.0)
    return band.select("p_brand", "side", r6("start", 5).alias("start"), r6("stop", 5).alias("stop"))


# ── labels ──────────────────────────────────────────────────────────────
_LABELS = """un AS (SELECT doc_id AS unit_id, lang, source, n_chars FROM documents),
la AS (SELECT doc_id AS unit_id, CASE WHEN quality = 1 THEN 'GOOD' ELSE 'NOISE' END AS a, CASE WHEN toxic = 1 THEN 'noise' WHEN doc_id % 3 = 0 THEN 'mua' ELSE 'sua' END AS b, quality + toxic AS q, toxic FROM labels)"""


def _tools(spark, sf):
    units = b.table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"))
    l = b.table(spark, sf, "labels")
    first = l.select(F.col("doc_id").alias("unit_id"), F.when(F.col("quality") == 1, "GOOD").otherwise("NOISE").alias("label"))
    second = l.select(F.col("doc_id").alias("unit_id"), F.when(F.col("toxic") == 1, "noise").when(F.col("doc_id") % 3 == 0, "mua").otherwise("sua").alias("label"),
                      F.col("toxic").cast("double").alias("prob"))
    manual = l.where("doc_id % 5 = 0").select(F.col("doc_id").alias("unit_id"), (F.col("doc_id") % 4).cast("int").alias("code"))
    return units, first, second, manual


@query("automated_labels", f"""WITH {_LABELS}, m AS (SELECT un.unit_id, coalesce(a, '') AS a_label, coalesce(CASE WHEN a IS NOT NULL AND un.unit_id % 5 = 0 THEN CASE un.unit_id % 4 WHEN 0 THEN 'noise' WHEN 1 THEN 'good' WHEN 2 THEN 'MUA' ELSE 'non-somatic' END END, '') AS a_manual, coalesce(b, '') AS b_label, toxic::DOUBLE AS b_prob FROM un LEFT JOIN la ON la.unit_id = un.unit_id),
q AS (SELECT *, CASE WHEN a_manual <> '' THEN a_manual ELSE a_label END AS c FROM m),
z AS (SELECT *, CASE c WHEN 'GOOD' THEN 'good' WHEN 'good' THEN 'good' WHEN 'MUA' THEN 'MUA' WHEN 'NOISE' THEN 'noise' WHEN 'noise' THEN 'noise' END AS ours, CASE b_label WHEN 'sua' THEN 'good' WHEN 'mua' THEN 'MUA' WHEN 'noise' THEN 'noise' END AS theirs FROM q)
SELECT unit_id, coalesce(CASE WHEN ours = theirs THEN ours END, '') AS auto_label, a_label, a_manual, b_label, b_prob FROM z""")
def _(spark, sf):
    return cu.automated_labels(*_tools(spark, sf))


@query("final_unit_labels", """SELECT doc_id AS unit_id, CASE WHEN doc_id % 2 = 0 THEN CASE doc_id % 5 WHEN 0 THEN 'noise' WHEN 1 THEN 'good' WHEN 2 THEN 'MUA' WHEN 3 THEN 'non-somatic' ELSE 'NA' END
 ELSE CASE quality WHEN 0 THEN 'noise' ELSE 'good' END END AS label FROM labels""")
def _(spark, sf):
    l = b.table(spark, sf, "labels")
    return cu.final_unit_labels(l.select(
        F.col("doc_id").alias("unit_id"), F.when(F.col("doc_id") % 2 == 0, "manual").otherwise("auto").alias("source"),
        (F.col("doc_id") % 5).cast("int").alias("manual_code"), F.col("quality").alias("auto_code")))


@query("merge_groups", """SELECT l_orderkey AS group_id, l_partkey AS unit_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS position FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)""")
def _(spark, sf):
    m = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("unit_id")).distinct()
    return cu.merge_groups(m)


_SCORES = """ps AS (SELECT l_partkey AS i, l_suppkey AS j, max(l_discount) AS score FROM lineitem GROUP BY 1, 2),
mb AS (SELECT p_partkey AS unit_id, p_size AS group_id FROM part)"""


def _scores(spark, sf):
    s = b.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.max("l_discount").alias("score"))
    return s, b.table(spark, sf, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_size").alias("group_id"))


@query("merge_pairs", f"WITH {_SCORES} SELECT i, j, score, a.group_id FROM ps JOIN mb a ON a.unit_id = i JOIN mb c ON c.unit_id = j WHERE a.group_id = c.group_id AND i <> j")
def _(spark, sf):
    s, m = _scores(spark, sf)
    return cu.scored_partners(m, s).select("i", "j", "score", "group_id")


@query("merge_partner_scores", f"""WITH {_SCORES}, p AS (SELECT i, j, score FROM ps JOIN mb a ON a.unit_id = i JOIN mb c ON c.unit_id = j WHERE a.group_id = c.group_id AND i <> j),
w AS (SELECT i AS u, j AS v, score FROM p UNION ALL SELECT j, i, score FROM p)
SELECT unit_id, group_id, max(score) AS best_score, count(DISTINCT v) AS n_partners FROM mb LEFT JOIN w ON u = unit_id GROUP BY 1, 2""")
def _(spark, sf):
    s, m = _scores(spark, sf)
    return cu.partner_scores(m, s).select("unit_id", "group_id", "best_score", "n_partners")


@query("curation_result", f"""WITH {_LABELS} SELECT un.unit_id, lang, coalesce(a, '') AS quality, n_chars < 200 AS removed, CASE WHEN source = 'web' THEN 1 ELSE -1 END AS merge_group, un.unit_id % 7 = 0 AS split FROM un LEFT JOIN la ON la.unit_id = un.unit_id""")
def _(spark, sf):
    d = b.table(spark, sf, "documents")
    unit = F.col("doc_id").alias("unit_id")
    manual = b.table(spark, sf, "labels").select(unit, F.when(F.col("quality") == 1, "GOOD").otherwise("NOISE").alias("quality"))
    out = cu.curation_result(d.select(unit, "lang"), manual, d.where("n_chars < 200").select(unit),
                             d.where("source = 'web'").select(unit, F.lit(1).alias("group_id")), d.where("doc_id % 7 = 0").select(unit))
    return out.withColumn("quality", F.coalesce("quality", F.lit("")))


@query("sorting_fingerprint", "SELECT user_id AS unit_id, count(*) AS n_spikes FROM events GROUP BY 1")
def _(spark, sf):
    return cu.sorting_fingerprint(b.spikes(spark, sf), "unit_id")


@query("fingerprint_changes", """WITH a AS (SELECT user_id AS unit_id, count(*) AS n_old FROM events WHERE user_id < 140 GROUP BY 1), c AS (SELECT user_id AS unit_id, count(*) AS n_new FROM events WHERE user_id > 5 AND NOT (user_id % 10 = 0 AND event_type = 'view') GROUP BY 1)
SELECT coalesce(a.unit_id, c.unit_id) AS unit_id, n_old, n_new, CASE WHEN n_old IS NULL THEN 'extra' WHEN n_new IS NULL THEN 'missing' WHEN abs(n_new - n_old) > greatest(2, n_old*0.001) THEN 'stale' ELSE 'ok' END AS status FROM a FULL JOIN c ON a.unit_id = c.unit_id""")
def _(spark, sf):
    s = b.spikes(spark, sf)
    old = cu.sorting_fingerprint(s.where("unit_id < 140"), "unit_id")
    new = cu.sorting_fingerprint(s.where("unit_id > 5 AND NOT (unit_id % 10 = 0 AND kind = 'view')"), "unit_id")
    return cu.fingerprint_changes(old, new, "unit_id", 0.001, 2)


@query("sheet_properties", f"WITH {_LABELS} SELECT un.unit_id, coalesce(a, '') AS a, coalesce(b, '') AS b, q FROM un LEFT JOIN la ON la.unit_id = un.unit_id")
def _(spark, sf):
    units, first, second, _m = _tools(spark, sf)
    l = b.table(spark, sf, "labels").select(F.col("doc_id").alias("unit_id"), (F.col("quality") + F.col("toxic")).alias("q"))
    out = units.join(first.withColumnRenamed("label", "a"), "unit_id", "left").join(
        second.select("unit_id", F.col("label").alias("b")), "unit_id", "left").join(l, "unit_id", "left")
    return cu.sheet_properties(out)


@query("initial_curation", """SELECT doc_id AS unit_id, CASE WHEN quality = 1 THEN '{"unit_id":' || doc_id || ',"labels":{"quality":"good"}}' ELSE '{"unit_id":' || doc_id || ',"labels":{}}' END AS curation FROM labels""")
def _(spark, sf):
    l = b.table(spark, sf, "labels").select(F.col("doc_id").alias("unit_id"), F.when(F.col("quality") == 1, "good").otherwise("").alias("auto_label"))
    return cu.initial_curation(l)


@query("manual_paint", f"""WITH {b.STATE_BINS}, ed AS (SELECT session, bin AS edit, bin - 1 AS lo, bin + theta AS hi, CASE WHEN theta % 2 = 0 THEN 3 ELSE 5 END AS code FROM sb WHERE theta >= 3),
h AS (SELECT sb.session, sb.bin, arg_max(ed.code, ed.edit) AS manual FROM sb JOIN ed ON ed.session = sb.session AND sb.bin >= lo AND sb.bin <= hi GROUP BY 1, 2)
SELECT sb.session, sb.bin, CAST(coalesce(manual, sb.code) AS INT) AS code, manual IS NOT NULL AS painted FROM sb LEFT JOIN h ON h.session = sb.session AND h.bin = sb.bin""")
def _(spark, sf):
    from ..operators.editing import paint

    bins = b.state_bins(spark, sf)
    edits = bins.where("theta >= 3").select(
        "session", F.col("bin").alias("edit_id"), (F.col("bin") - 1).alias("lo"), (F.col("bin") + F.col("theta")).alias("hi"),
        F.when(F.col("theta") % 2 == 0, 3).otherwise(5).alias("code"))
    auto = bins.select("session", "bin", F.col("code").alias("auto"))
    return paint(auto, edits, ["session"], "bin", "auto", 8).select("session", "bin", "code", "painted")
