"""Queries: angle arithmetic, circular statistics, decoding scores, names and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import angles as an
from ..functions import text as tx
from ..operators import circular as ci
from ..operators.nulls import judge
from . import bindings as b
from .registry import query

r6 = an.r6
DECODED = f"""de0 AS (SELECT event_id, user_id, user_id % {b.SESSIONS} AS session, event_type AS kind, epoch_us(ts) AS us, value,
  value*36 - 360.0*floor(value*36/360.0) AS decoded_deg, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
de1 AS (SELECT *, decoded_deg + (k - 50) * 1.7 + 8 AS a FROM de0),
de AS (SELECT *, a - 360.0*floor(a/360.0) AS actual_deg FROM de1)"""


def wrap_sql(x: str) -> str:
    """[-180, 180) wrap of an expression as SQL."""
    return f"(({x}) + 180.0 - 360.0*floor((({x}) + 180.0)/360.0) - 180.0)"


def w360_sql(x: str) -> str:
    return f"(({x}) - 360.0*floor(({x})/360.0))"


def decoded(spark, sf):
    """A decode and its truth: the truth is the decode plus an error held in the JSON field."""
    e = b.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    out = e.select(
        "event_id", "user_id", (F.col("user_id") % b.SESSIONS).alias("session"), F.col("event_type").alias("kind"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value",
        an.wrap360(F.col("value") * 36).alias("decoded_deg"), k.alias("k"))
    return out.withColumn("actual_deg", an.wrap360(F.col("decoded_deg") + (F.col("k") - 50) * 1.7 + 8))


@query("circular_difference", f"WITH {DECODED} SELECT event_id, round({wrap_sql('decoded_deg - actual_deg')}, 6) + 0.0 AS error_deg FROM de")
def _(spark, sf):
    d = decoded(spark, sf)
    return d.select("event_id", r6(an.circular_difference(F.col("decoded_deg"), F.col("actual_deg"))).alias("error_deg"))


_MEAN = "{x} AS mean_deg, round(sqrt(pow(avg(cos(radians(h))),2)+pow(avg(sin(radians(h))),2)), 6) AS resultant"


@query("circular_mean", f"WITH {DECODED} SELECT user_id, round({w360_sql('degrees(atan2(avg(sin(radians(actual_deg))), avg(cos(radians(actual_deg)))))')}, 4) AS mean_deg, round(sqrt(pow(avg(cos(radians(actual_deg))),2)+pow(avg(sin(radians(actual_deg))),2)), 6) AS resultant, count(*) AS n FROM de GROUP BY 1")
def _(spark, sf):
    m = ci.circular_mean(decoded(spark, sf), ["user_id"], "actual_deg")
    return m.select("user_id", r6("mean_deg", 4).alias("mean_deg"), r6("resultant").alias("resultant"), "n")


def corr_sql(source: str, keys: str) -> str:
    return f"""(SELECT {keys}, sum(sin(radians(decoded_deg - ma))*sin(radians(actual_deg - mb)))/sqrt(sum(sin(radians(decoded_deg - ma))*sin(radians(decoded_deg - ma)))*sum(sin(radians(actual_deg - mb))*sin(radians(actual_deg - mb)))) AS r, count(*) AS n
 FROM (SELECT *, degrees(atan2(avg(sin(radians(decoded_deg))) OVER w, avg(cos(radians(decoded_deg))) OVER w)) AS ma, degrees(atan2(avg(sin(radians(actual_deg))) OVER w, avg(cos(radians(actual_deg))) OVER w)) AS mb
  FROM {source} WINDOW w AS (PARTITION BY {keys})) GROUP BY {keys})"""


@query("circular_correlation", f"WITH {DECODED} SELECT kind, round(r, 6) AS r, n FROM {corr_sql('de', 'kind')}")
def _(spark, sf):
    return ci.circular_correlation(decoded(spark, sf), ["kind"], "decoded_deg", "actual_deg").select("kind", r6("r").alias("r"), "n")


@query("circular_r", f"""WITH {DECODED}, p AS (SELECT user_id, radians(decoded_deg) AS x, radians(actual_deg) AS y FROM de),
s AS (SELECT user_id, count(*) AS n, sum(cos(x)*cos(y)) AS cc, sum(sin(x)*sin(y)) AS ss, sum(cos(x)*sin(y)) AS cs, sum(sin(x)*cos(y)) AS sc, sum(cos(2*x)) AS c2a, sum(sin(2*x)) AS s2a, sum(cos(2*y)) AS c2b, sum(sin(2*y)) AS s2b FROM p GROUP BY 1)
SELECT user_id, n, round(4*(cc*ss-cs*sc)/sqrt((n*n - (c2a*c2a+s2a*s2a))*(n*n - (c2b*c2b+s2b*s2b))), 6) AS r FROM s WHERE n >= 3""")
def _(spark, sf):
    return ci.circular_r(decoded(spark, sf), ["user_id"], "decoded_deg", "actual_deg").where("n >= 3").select("user_id", "n", r6("r").alias("r"))


def metrics_sql(source: str, keys: str, tolerance: float) -> str:
    """Decoding scores per key as SQL (a common-table list ending in ``mt``)."""
    err = wrap_sql("decoded_deg - actual_deg")
    return f"""ee AS (SELECT *, {err} AS e FROM {source}),
eo AS (SELECT *, {wrap_sql(w360_sql('degrees(atan2(avg(sin(radians(e))) OVER w, avg(cos(radians(e))) OVER w))'))} AS o FROM ee WINDOW w AS (PARTITION BY {keys})),
ec AS (SELECT *, abs({wrap_sql('e - o')}) AS c FROM eo),
mt AS (SELECT {keys}, median(abs(e)) AS median_abs_error_deg, avg(abs(e)) AS mean_abs_error_deg, sqrt(avg(e*e)) AS rmse_deg, avg(CASE WHEN abs(e) <= {tolerance} THEN 1.0 ELSE 0.0 END) AS frac_within_deg,
 {tolerance}::DOUBLE AS tolerance_deg, any_value(o) AS offset_deg, median(c) AS median_abs_error_corrected_deg, avg(CASE WHEN c <= {tolerance} THEN 1.0 ELSE 0.0 END) AS frac_within_corrected_deg,
 quantile_cont(abs(e), 0.25) AS q25_abs_error_deg, quantile_cont(abs(e), 0.75) AS q75_abs_error_deg, count(*) AS n_bins FROM ec GROUP BY {keys})"""


METRIC_COLUMNS = ["median_abs_error_deg", "mean_abs_error_deg", "rmse_deg", "frac_within_deg", "tolerance_deg", "offset_deg",
                  "median_abs_error_corrected_deg", "frac_within_corrected_deg", "q25_abs_error_deg", "q75_abs_error_deg"]
_ROUNDED = ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in METRIC_COLUMNS)


@query("decoding_metrics", f"WITH {DECODED}, {metrics_sql('de', 'session', 30.3)} SELECT mt.session, {_ROUNDED}, n_bins, round(r, 5) AS circular_correlation FROM mt JOIN {corr_sql('de', 'session')} c ON c.session = mt.session")
def _(spark, sf):
    m = ci.decoding_metrics(decoded(spark, sf), ["session"], "decoded_deg", "actual_deg", 30.3)
    return m.select("session", *[r6(c, 5).alias(c) for c in [*METRIC_COLUMNS, "circular_correlation"]], "n_bins")


@query("metrics_by_group", f"""WITH {DECODED}, {metrics_sql('de', 'kind', 10.1)},
x AS (SELECT kind, count(*) AS time_s, round(avg(k), 6) AS mean_posterior_max, round(CAST(sum(round(value*100)) AS DOUBLE)/count(*), 4) AS population_rate_hz FROM de GROUP BY 1)
SELECT mt.kind, {_ROUNDED}, n_bins, time_s, mean_posterior_max, population_rate_hz FROM mt JOIN x ON x.kind = mt.kind""")
def _(spark, sf):
    d = decoded(spark, sf)
    m = ci.decoding_metrics(d, ["kind"], "decoded_deg", "actual_deg", 10.1)
    x = d.groupBy("kind").agg(
        F.count("*").alias("time_s"), r6(F.avg("k")).alias("mean_posterior_max"),
        r6(F.sum(F.round(F.col("value") * 100)) / F.count("*"), 4).alias("population_rate_hz"))
    return m.join(x, "kind").select("kind", *[r6(c, 5).alias(c) for c in METRIC_COLUMNS], "n_bins", "time_s",
                                    "mean_posterior_max", "population_rate_hz")


@query("align_angles", f"""WITH {DECODED}, s AS (SELECT user_id, count(*) AS n, avg(cos(radians(actual_deg - decoded_deg))) AS cp, avg(sin(radians(actual_deg - decoded_deg))) AS sp_, avg(cos(radians(actual_deg + decoded_deg))) AS cm, avg(sin(radians(actual_deg + decoded_deg))) AS sm FROM de GROUP BY 1),
t AS (SELECT *, sqrt(cp*cp+sp_*sp_) AS a, sqrt(cm*cm+sm*sm) AS m FROM s)
SELECT user_id, n, m > a AS flip, round(CASE WHEN m > a THEN {w360_sql('degrees(atan2(sm, cm))')} ELSE {w360_sql('degrees(atan2(sp_, cp))')} END, 4) AS offset_deg, round(greatest(a, m), 6) AS resultant, round(abs(a - m), 6) AS margin FROM t""")
def _(spark, sf):
    a = ci.align_angles(decoded(spark, sf), ["user_id"], "decoded_deg", "actual_deg")
    return a.select("user_id", "n", "flip", r6("offset_deg", 4).alias("offset_deg"), r6("resultant").alias("resultant"), r6("margin").alias("margin"))


@query("ring_alignment_apply", f"""WITH {DECODED}, p AS (SELECT event_id, decoded_deg AS a, user_id % 2 = 1 AS flip, CAST(user_id AS DOUBLE) AS o, user_id % 3 = 1 AS flip2, CAST(user_id*2 AS DOUBLE) AS o2 FROM de),
q AS (SELECT *, {w360_sql('(CASE WHEN flip THEN -a ELSE a END) + o')} AS applied FROM p)
SELECT event_id, round(applied, 6) AS applied, round({w360_sql('(CASE WHEN flip THEN -(round(applied, 6) - o) ELSE round(applied, 6) - o END)')}, 5) AS inverted,
 flip <> flip2 AS then_flip, round({w360_sql('(CASE WHEN flip2 THEN -o ELSE o END) + o2')}, 6) AS then_offset FROM q""")
def _(spark, sf):
    from ..operators.ring import alignment_apply, alignment_invert, alignment_then

    p = decoded(spark, sf).select(
        "event_id", F.col("decoded_deg").alias("a"), (F.col("user_id") % 2 == 1).alias("flip"), F.col("user_id").cast("double").alias("o"),
        (F.col("user_id") % 3 == 1).alias("flip2"), (F.col("user_id") * 2).cast("double").alias("o2"))
    p = p.withColumn("applied", r6(alignment_apply("a", "flip", "o")))
    flip, offset = alignment_then("flip", "o", "flip2", "o2")
    return p.select("event_id", "applied", r6(alignment_invert("applied", "flip", "o"), 5).alias("inverted"),
                    flip.alias("then_flip"), r6(offset).alias("then_offset"))


@query("decoding_error_histogram", f"WITH {DECODED} SELECT kind, CAST(least(floor((round({wrap_sql('decoded_deg - actual_deg')}, 6) + 180.0)/5.0), 71) AS BIGINT) AS error_bin, count(*) AS n FROM de GROUP BY 1, 2")
def _(spark, sf):
    d = decoded(spark, sf).withColumn("e", r6(an.circular_difference(F.col("decoded_deg"), F.col("actual_deg"))))
    return ci.error_histogram(d, ["kind"], "e", 5.0)


@query("decoding_confusion", f"""WITH {DECODED}, c AS (SELECT CAST(floor(round(actual_deg, 6)/5.0) AS BIGINT) AS actual_bin, CAST(floor(round(decoded_deg, 6)/5.0) AS BIGINT) AS decoded_bin, count(*) AS n FROM de GROUP BY 1, 2)
SELECT least(actual_bin, 71) AS actual_bin, least(decoded_bin, 71) AS decoded_bin, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / sum(sum(n)) OVER (PARTITION BY least(actual_bin, 71)), 6) AS p FROM c GROUP BY 1, 2""")
def _(spark, sf):
    d = decoded(spark, sf).select(r6("decoded_deg").alias("d"), r6("actual_deg").alias("a"))
    return ci.confusion(d, [], "d", "a", 72).withColumn("p", r6("p"))


@query("permutation_judge", f"""WITH {DECODED}, o AS (SELECT kind, avg(abs({wrap_sql('decoded_deg - actual_deg')})) AS v FROM de GROUP BY 1),
nl AS (SELECT kind, i.range AS shuffle, avg(abs({wrap_sql('decoded_deg + i.range*7 - actual_deg')})) AS v FROM de, range(1, 40) i GROUP BY 1, 2),
j AS (SELECT nl.kind, any_value(o.v) AS ov, count(*) AS n, sum(CASE WHEN nl.v <= o.v THEN 1 ELSE 0 END) AS hits, avg(nl.v) AS m, stddev_pop(nl.v) AS sd FROM nl JOIN o ON o.kind = nl.kind GROUP BY 1)
SELECT kind, round(ov, 5) AS observed, n AS n_shuffles, round((1+hits)/(n+1), 6) AS p_value, round((ov - m)/sd, 4) AS z_score, 'lower' AS better FROM j""")
def _(spark, sf):
    d = decoded(spark, sf)
    observed = d.groupBy("kind").agg(F.avg(F.abs(an.circular_difference(F.col("decoded_deg"), F.col("actual_deg")))).alias("value"))
    moved = d.withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(39))))
    null = moved.groupBy("kind", "shuffle").agg(
        F.avg(F.abs(an.circular_difference(F.col("decoded_deg") + F.col("shuffle") * 7, F.col("actual_deg")))).alias("value"))
    j = judge(null, observed, ["kind"], "mean_abs_error_deg")
    return j.select("kind", r6("observed", 5).alias("observed"), "n_shuffles", r6("p_value").alias("p_value"),
                    r6("z_score", 4).alias("z_score"), "better")


QUATERNIONS = """qt AS (SELECT vec_id AS frame, label, embedding[1]::DOUBLE AS qx, embedding[2]::DOUBLE AS qy, embedding[3]::DOUBLE AS qz, embedding[4]::DOUBLE AS qw,
 embedding[5]::DOUBLE*100 AS px, embedding[6]::DOUBLE*100 AS py, embedding[7]::DOUBLE*100 AS pz FROM embeddings),
qn AS (SELECT *, sqrt(qx*qx+qy*qy+qz*qz+qw*qw) AS nn FROM qt),
qu AS (SELECT frame, label, px, py, pz, qx/nn AS x, qy/nn AS y, qz/nn AS z, qw/nn AS w FROM qn)"""


def track(spark, sf):
    """Tracking frames with an orientation and a position, from the first embedding slots."""
    e = b.table(spark, sf, "embeddings")
    names = ["qx", "qy", "qz", "qw", "px", "py", "pz"]
    scale = [1, 1, 1, 1, 100, 100, 100]
    return e.select(F.col("vec_id").alias("frame"), "label",
                    *[(F.col("embedding")[i].cast("double") * s).alias(n) for i, (n, s) in enumerate(zip(names, scale))])


@query("compute_heading", f"""WITH {QUATERNIONS} SELECT frame, round({w360_sql('-degrees(atan2(2*(x*z+w*y), 1-2*(x*x+y*y))) + 15')}, 6) AS heading_deg FROM qu""")
def _(spark, sf):
    vx, vy, vz = an.quaternion_apply("qx", "qy", "qz", "qw", (0, 0, 1))
    t = track(spark, sf)
    return t.select("frame", r6(an.heading_of(vx, vz, flip_direction=True, offset_deg=15.0)).alias("heading_deg"))


@query("compute_head_elevation", f"WITH {QUATERNIONS} SELECT frame, round(degrees(asin(greatest(least(2*(y*z-w*x), 1.0), -1.0))), 6) + 0.0 AS elevation_deg FROM qu")
def _(spark, sf):
    vx, vy, vz = an.quaternion_apply("qx", "qy", "qz", "qw", (0, 0, 1))
    return track(spark, sf).select("frame", r6(an.elevation_of(vy)).alias("elevation_deg"))


@query("entropy_bits", """WITH u AS (SELECT vec_id, abs(unnest(embedding)::DOUBLE) AS a FROM embeddings), p AS (SELECT vec_id, a / sum(a) OVER (PARTITION BY vec_id) AS p FROM u)
SELECT vec_id, round(-sum(CASE WHEN p > 0 THEN p*log2(p) ELSE 0 END), 6) AS entropy_bits, round(max(p), 6) AS peak FROM p GROUP BY 1""")
def _(spark, sf):
    from ..operators.hmm import entropy_bits, normalise

    e = b.table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"))
    e = e.select("vec_id", normalise("a").alias("p"))
    return e.select("vec_id", r6(entropy_bits("p")).alias("entropy_bits"), r6(F.array_max("p")).alias("peak"))


@query("is_sync_label", """SELECT event_id, len(list_filter(string_split_regex(lower(l), '[;#]'), lambda p: regexp_full_match(trim(p), 'sy[0-9]*'))) > 0 AS is_sync FROM
 (SELECT event_id, CASE event_type WHEN 'view' THEN 'imec0.ap#SY' || event_id WHEN 'click' THEN 'SY0;768:768' WHEN 'error' THEN 'ADC' || event_id WHEN 'signup' THEN 'system;3' ELSE 'AP1;SYNC' END AS l FROM events)""")
def _(spark, sf):
    e = b.table(spark, sf, "events")
    label = (F.when(F.col("event_type") == "view", F.concat(F.lit("imec0.ap#SY"), "event_id"))
             .when(F.col("event_type") == "click", "SY0;768:768").when(F.col("event_type") == "error", F.concat(F.lit("ADC"), "event_id"))
             .when(F.col("event_type") == "signup", "system;3").otherwise("AP1;SYNC"))
    return e.select("event_id", tx.is_sync_label(label).alias("is_sync"))


@query("session_name", """SELECT page_id, (list_filter(list_filter(string_split(url, '/'), lambda p: len(p) > 0), lambda p: NOT list_contains(['raw','ephys','physiology','continuous','data'], lower(p)) AND NOT regexp_matches(lower(p), '^record node|:$')))[-1] AS session FROM pages""")
def _(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", tx.session_name("url").alias("session"))


@query("session_stem", r"""SELECT page_id, regexp_replace((list_filter(string_split(url, '/'), lambda p: len(p) > 0))[-1], '(.)\.[^.]*$', '\1') AS stem FROM pages""")
def _(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", tx.path_stem("url").alias("stem"))


@query("plain_json", """SELECT event_id, to_json({'id': event_id, 'hz': CASE WHEN value > 100 THEN NULL ELSE CAST(floor(value) AS BIGINT) END})::VARCHAR AS js FROM events""")
def _(spark, sf):
    from ..sources.store import plain

    e = b.table(spark, sf, "events")
    hz = F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.floor("value").cast("double"))
    js = F.to_json(F.struct(F.col("event_id").alias("id"), plain(hz).cast("bigint").alias("hz")), {"ignoreNullFields": "false"})
    return e.select("event_id", js.alias("js"))
