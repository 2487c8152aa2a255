"""Queries: reading heading out of binned spikes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.angles import heading_bin, mean_angle, r6
from ..operators import decoding as de
from ..operators.circular import decoding_metrics
from ..operators.nulls import draw_orders, judge
from ..operators.quantiles import quantiles
from ..operators.tuning import kernel_sql
from ..scale import cut_lineage
from . import bindings as b
from .angles import METRIC_COLUMNS, corr_sql, metrics_sql, w360_sql, wrap_sql
from .registry import query

ANGLES = 24
KINDS = ["click", "error", "purchase", "signup", "view"]
TRANSITION = de.ring_transition(ANGLES, 900.0)


def binned(spark, sf):
    """Hourly bins of each session: counts of the five kinds, circular mean heading, length 1."""
    s = b.spikes(spark, sf)
    counts = F.array(*[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("bigint") for k in KINDS])
    return s.groupBy("session", F.floor(F.col("us") / b.HOUR_US).cast("bigint").alias("bin")).agg(
        counts.alias("counts"), r6(mean_angle("heading")).alias("heading"), F.lit(1.0).alias("dur"), F.count("*").alias("n"))


BINNED = b.SPIKES + f""", bn AS (SELECT session, CAST(floor(us/{b.HOUR_US}.0) AS BIGINT) AS bin, round({w360_sql('degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading)))))')}, 6) AS heading, count(*) AS n,
 {', '.join(f"count(*) FILTER (kind = '{k}') AS k{i}" for i, k in enumerate(KINDS))} FROM sp GROUP BY 1, 2),
bh AS (SELECT *, least(greatest(CAST(floor(heading / {360.0 / ANGLES}) AS BIGINT), 0), {ANGLES - 1}) AS ab FROM bn)"""


@query("prepare_decoder_data", f"""WITH {b.FRAMES}, g AS (SELECT unit_id, frame // 4 AS bin, min(us) AS start, count(*) AS n, {w360_sql('degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading)))))')} AS heading FROM fr GROUP BY 1, 2)
SELECT g.unit_id, g.bin, start, fr.us AS stop, round(g.heading, 4) AS heading, fr.us - start AS duration FROM g JOIN fr ON fr.unit_id = g.unit_id AND fr.frame = (g.bin + 1) * 4""")
def _(spark, sf):
    f = de.frame_bins(b.spikes(spark, sf), ["unit_id"], ["us", "event_id"], "us", "heading", 4)
    return f.select("unit_id", "bin", "start", "stop", r6("heading", 4).alias("heading"), "duration")


@query("decoder_bin_counts", f"""WITH {b.SPIKES}, fr AS (SELECT session, us, row_number() OVER (PARTITION BY session ORDER BY us, event_id) - 1 AS frame FROM sp WHERE kind = 'view'),
e AS (SELECT a.session, a.frame // 5 AS bin, a.us AS start, z.us AS stop FROM fr a JOIN fr z ON z.session = a.session AND z.frame = a.frame + 5 WHERE a.frame % 5 = 0),
x AS (SELECT e.*, max(stop) OVER (PARTITION BY session) AS fin FROM e)
SELECT sp.session, bin, kind, count(*) AS n FROM sp JOIN x ON x.session = sp.session AND us >= start AND (us < stop OR (stop = fin AND us = fin)) GROUP BY 1, 2, 3""")
def _(spark, sf):
    s = b.spikes(spark, sf)
    bins = de.frame_bins(s.where("kind = 'view'"), ["session"], ["us", "event_id"], "us", "heading", 5)
    return de.bin_counts(s, bins, ["session"], "us", "kind")


def _held(n_blocks: int) -> list[int]:
    order = np.random.default_rng(0).permutation(n_blocks)
    return [int(x) for x in order[:max(1, round(0.3 * n_blocks))]]


_BLOCK = 24.0
_HELD = ", ".join(f"({n}, {x})" for n in range(1, 41) for x in _held(n))
_SPLIT = f"""hb(nb, block) AS (VALUES {_HELD}), ms AS (SELECT session, bin, CAST(floor((row_number() OVER (PARTITION BY session ORDER BY bin) - 1) / {_BLOCK}) AS BIGINT) AS block FROM bn WHERE n >= 2),
mn AS (SELECT *, max(block) OVER (PARTITION BY session) + 1 AS nb FROM ms), tt AS (SELECT session, bin, mn.block, hb.block IS NOT NULL AS is_test FROM mn LEFT JOIN hb ON hb.nb = mn.nb AND hb.block = mn.block)"""


def split(spark, sf):
    x = binned(spark, sf).withColumn("ok", F.col("n") >= 2)
    return de.split_train_test(x, ["session"], "bin", "dur", "ok", _BLOCK, 0.3, "blocks", 0)


@query("split_train_test", f"WITH {BINNED}, {_SPLIT} SELECT session, bin, block, is_test FROM tt")
def _(spark, sf):
    return split(spark, sf).select("session", "bin", "block", "is_test")


@query("split_contiguous", f"""WITH {BINNED}, e AS (SELECT session, bin, row_number() OVER (PARTITION BY session ORDER BY bin) - 1 AS before, count(*) OVER (PARTITION BY session) AS total FROM bn WHERE n >= 2) SELECT session, bin, before >= total * (1 - 0.3::DOUBLE) AS is_test FROM e""")
def _(spark, sf):
    x = binned(spark, sf).withColumn("ok", F.col("n") >= 2)
    return de.split_train_test(x, ["session"], "bin", "dur", "ok", _BLOCK, 0.3, "contiguous").select("session", "bin", "is_test")


_MODEL = f"""oc AS (SELECT session, ab, count(*)::DOUBLE AS occ FROM bh GROUP BY 1, 2),
uk AS (SELECT session, ab, u.range AS unit, sum(CASE u.range {' '.join(f'WHEN {i} THEN k{i}' for i in range(5))} END)::DOUBLE AS n FROM bh, range(5) u GROUP BY 1, 2, 3),
gr AS (SELECT s.session, u.range AS unit, a.range AS ab FROM (SELECT DISTINCT session FROM bn) s, range(5) u, range({ANGLES}) a),
h0 AS (SELECT gr.session, gr.unit, gr.ab, coalesce(n / occ, 0) AS hz FROM gr LEFT JOIN uk ON uk.session = gr.session AND uk.unit = gr.unit AND uk.ab = gr.ab LEFT JOIN oc ON oc.session = gr.session AND oc.ab = gr.ab),
kn(off, w) AS (VALUES {kernel_sql(20.0 / (360.0 / ANGLES), ANGLES)}),
mo AS (SELECT session, unit, CAST((ab + off) % {ANGLES} AS BIGINT) AS ab, greatest(sum(hz * w), 0.05) AS hz FROM h0, kn GROUP BY 1, 2, 3)"""


def model(spark, sf):
    return de.fit_encoding_model(binned(spark, sf), ["session"], "counts", "heading", "dur", ANGLES, 20.0, 0.05)


@query("fit_encoding_model", f"WITH {BINNED}, {_MODEL} SELECT mo.session, unit, mo.ab AS angle_bin, round(hz, 6) AS rate_hz, coalesce(occ, 0) AS occupancy_s FROM mo LEFT JOIN oc ON oc.session = mo.session AND oc.ab = mo.ab")
def _(spark, sf):
    return model(spark, sf).select("session", "unit", "angle_bin", r6("rate_hz").alias("rate_hz"), "occupancy_s")


@query("preferred_deg", f"""WITH {BINNED}, {_MODEL}, v AS (SELECT session, unit, sum(hz) AS t, sum(hz*cos(radians((ab+0.5)*{360.0/ANGLES}))) AS x, sum(hz*sin(radians((ab+0.5)*{360.0/ANGLES}))) AS y FROM mo GROUP BY 1, 2)
SELECT session, unit, round({w360_sql('degrees(atan2(y, x))')}, 4) AS preferred_deg, round(sqrt(x*x+y*y)/t, 6) AS mvl FROM v""")
def _(spark, sf):
    from ..operators.tuning import mean_vector

    v = mean_vector(model(spark, sf), ["session", "unit"], ANGLES, "rate_hz")
    return v.select("session", "unit", r6("preferred_direction_deg", 4).alias("preferred_deg"), r6("mean_vector_length").alias("mvl"))


@query("movement_variance", f"""WITH {BINNED}, d AS (SELECT session, {wrap_sql('heading - lag(heading) OVER w')} AS s, bin - lag(bin) OVER w AS g FROM bn WINDOW w AS (PARTITION BY session ORDER BY bin)) SELECT session, round(var_pop(s), 4) AS variance, count(*) AS n_steps FROM d WHERE g = 1 GROUP BY 1""")
def _(spark, sf):
    return de.movement_variance(binned(spark, sf), ["session"], "bin", "heading").select("session", r6("variance", 4).alias("variance"), "n_steps")


@query("poisson_log_likelihood", f"""WITH {BINNED}, {_MODEL} SELECT bn.session, bn.bin, mo.ab AS angle_bin, round(sum(CASE unit {' '.join(f'WHEN {i} THEN k{i}' for i in range(5))} END * ln(hz) - hz), 5) + 0.0 AS log_likelihood FROM bn JOIN mo ON mo.session = bn.session GROUP BY 1, 2, 3""")
def _(spark, sf):
    k = binned(spark, sf).select("session", "bin", "dur", F.posexplode("counts").alias("unit", "k")).withColumn("unit", F.col("unit").cast("bigint"))
    j = k.join(model(spark, sf).select("session", "unit", "angle_bin", "rate_hz"), ["session", "unit"])
    return j.groupBy("session", "bin", "angle_bin").agg(
        r6(F.sum(F.col("k") * F.log("rate_hz") - F.col("dur") * F.col("rate_hz")), 5).alias("log_likelihood"))


@query("ring_transition", f"""WITH {BINNED}, oc AS (SELECT session, ab, count(*) AS n FROM bh GROUP BY 1, 2), tr(d, w) AS (VALUES {', '.join(f'({d}, {float(w)!r}::DOUBLE)' for d, w in enumerate(TRANSITION[0]))})
SELECT session, CAST((ab + d) % {ANGLES} AS BIGINT) AS angle_bin, round(sum(n * w), 6) AS expected FROM oc, tr GROUP BY 1, 2""")
def _(spark, sf):
    """Where each session's headings are expected one bin later, by the walk's transition matrix."""
    x = binned(spark, sf).withColumn("a", heading_bin(F.col("heading"), ANGLES))
    seen = x.groupBy("session", "a").agg(F.count("*").alias("n"))
    steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(w)).alias("w")) for d, w in enumerate(TRANSITION[0])])
    moved = seen.withColumn("t", F.explode(steps))
    to = F.pmod(F.col("a") + F.col("t.d"), F.lit(ANGLES)).cast("bigint").alias("angle_bin")
    return moved.groupBy("session", to).agg(r6(F.sum(F.col("n") * F.col("t.w"))).alias("expected"))


@query("decoder_runs", f"""WITH {BINNED}, k AS (SELECT *, n >= 2 AS keep FROM bn), c AS (SELECT *, CASE WHEN keep IS DISTINCT FROM lag(keep) OVER w THEN 1 ELSE 0 END AS ch FROM k WINDOW w AS (PARTITION BY session ORDER BY bin)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY bin) AS run FROM c), s AS (SELECT session, run, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS n_bins FROM g WHERE keep GROUP BY 1, 2 HAVING count(*) >= 3) SELECT session, first_bin, last_bin, n_bins FROM s""")
def _(spark, sf):
    from ..operators.runs import masked_runs

    x = masked_runs(binned(spark, sf), ["session"], ["bin"], F.col("n") >= 2, "dur", 1.0, 3.0)
    return x.groupBy("session", "run").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.count("*").alias("n_bins")).drop("run")


_ROW = "[" + ", ".join(f"{float(w)!r}::DOUBLE" for w in TRANSITION[0]) + "]"
_A = ANGLES


def _spread(p: str) -> str:
    """One step of the walk applied to a list of probabilities (the matrix is circulant and symmetric)."""
    return f"list_transform(range({_A}), lambda j: list_sum(list_transform(range({_A}), lambda i: {p}[i+1] * {_ROW}[((j - i) % {_A} + {_A}) % {_A} + 1])))"


def _norm(x: str) -> str:
    return f"list_transform({x}, lambda v: v / list_sum({x}))"


_HMM = f"""ls AS (SELECT bn.session, bn.bin, mo.ab, sum(CASE unit {' '.join(f'WHEN {i} THEN k{i}' for i in range(5))} END * ln(hz) - hz) AS l FROM bn JOIN mo ON mo.session = bn.session WHERE bn.n >= 2 GROUP BY 1, 2, 3),
lk AS (SELECT session, bin, list(l ORDER BY ab) AS raw FROM ls GROUP BY 1, 2),
rg AS (SELECT session, bin, n, sum(CASE WHEN n >= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY bin) AS run FROM bn),
rn AS MATERIALIZED (SELECT lk.session, lk.bin, run, list_transform(raw, lambda v: exp(v - list_max(raw))) AS lik FROM lk JOIN rg ON rg.session = lk.session AND rg.bin = lk.bin),
rx AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session, run ORDER BY bin) AS i, count(*) OVER (PARTITION BY session, run) AS len FROM rn),
ok AS MATERIALIZED (SELECT * FROM rx WHERE len >= 3),
fw AS (SELECT session, run, i, {_norm('lik')} AS p FROM ok WHERE i = 1 UNION ALL
 SELECT session, run, i, {_norm('q')} AS p FROM (SELECT n.session, n.run, n.i, list_transform(range({_A}), lambda k: s[k+1] * n.lik[k+1]) AS q FROM (SELECT session, run, i, {_spread('p')} AS s FROM fw) f JOIN ok n ON n.session = f.session AND n.run = f.run AND n.i = f.i + 1)),
bw AS (SELECT session, run, i, list_transform(range({_A}), lambda k: 1.0::DOUBLE / {_A}) AS m FROM ok WHERE i = len UNION ALL
 SELECT session, run, i, {_norm('q')} AS m FROM (SELECT session, run, i, {_spread('s')} AS q FROM (SELECT o.session, o.run, o.i - 1 AS i, list_transform(range({_A}), lambda k: w.m[k+1] * o.lik[k+1]) AS s FROM bw w JOIN ok o ON o.session = w.session AND o.run = w.run AND o.i = w.i WHERE w.i > 1))),
ps AS (SELECT ok.session, ok.bin, fw.p AS causal, list_transform(range({_A}), lambda k: fw.p[k+1] * bw.m[k+1]) AS u FROM ok JOIN fw ON fw.session = ok.session AND fw.run = ok.run AND fw.i = ok.i JOIN bw ON bw.session = ok.session AND bw.run = ok.run AND bw.i = ok.i),
pz AS (SELECT session, bin, causal, {_norm('u')} AS p FROM ps)"""


def decoded(spark, sf, acausal=True, chunk_bins=4096):
    return de.decode(binned(spark, sf), model(spark, sf), ["session"], "bin", "counts", "dur", "heading", F.col("n") >= 2,
                     TRANSITION, acausal, 1.0, 3.0, chunk_bins)


def _decode_sql(p: str) -> str:
    return f"""WITH RECURSIVE {BINNED}, {_MODEL}, {_HMM} SELECT session, bin, (list_position({p}, list_max({p})) - 0.5) * {360.0 / _A}::DOUBLE AS decoded_deg, round(list_max({p}), 6) AS posterior_max,
 round(-list_sum(list_transform({p}, lambda v: CASE WHEN v > 0 THEN v * log2(v) ELSE 0 END)), 5) AS entropy_bits FROM pz"""


def _decode_columns(d):
    return d.select("session", "bin", "decoded_deg", r6("posterior_max").alias("posterior_max"), r6("entropy_bits", 5).alias("entropy_bits"))


@query("decode_heading", _decode_sql("p"))
def _(spark, sf):
    return _decode_columns(decoded(spark, sf))


@query("decode_heading_causal", _decode_sql("causal"))
def _(spark, sf):
    return _decode_columns(decoded(spark, sf, acausal=False))


@query("decode_heading_chunked", _decode_sql("p"))
def _(spark, sf):
    return _decode_columns(decoded(spark, sf, chunk_bins=8))


_DECODED = f"""{_HMM}, dd AS (SELECT pz.session, pz.bin, (list_position(p, list_max(p)) - 0.5) * {360.0 / _A}::DOUBLE AS decoded_deg, heading AS actual_deg, list_max(p) AS peak,
 -list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * log2(v) ELSE 0 END)) AS entropy FROM pz JOIN bn ON bn.session = pz.session AND bn.bin = pz.bin)"""


@query("decode_metrics", f"""WITH RECURSIVE {BINNED}, {_MODEL}, {_DECODED}, {metrics_sql('dd', 'session', 10.1)}, ex AS (SELECT session, avg(peak) AS pk, avg(entropy) AS en FROM dd GROUP BY 1)
SELECT mt.session, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in METRIC_COLUMNS)}, n_bins, round(r, 5) + 0.0 AS circular_correlation, round(pk, 6) AS mean_posterior_max, round(en, 5) AS mean_entropy_bits
 FROM mt JOIN ex ON ex.session = mt.session JOIN {corr_sql('dd', 'session')} c ON c.session = mt.session""")
def _(spark, sf):
    d = cut_lineage(decoded(spark, sf))
    m = decoding_metrics(d, ["session"], "decoded_deg", "actual_deg", 10.1)
    extra = d.groupBy("session").agg(r6(F.avg("posterior_max")).alias("mean_posterior_max"), r6(F.avg("entropy_bits"), 5).alias("mean_entropy_bits"))
    return m.join(extra, "session").select("session", *[r6(c, 5).alias(c) for c in [*METRIC_COLUMNS, "circular_correlation"]], "n_bins",
                                           "mean_posterior_max", "mean_entropy_bits")


@query("shuffle_test_shift")
def _(spark, sf):
    """Decoding error against spikes shifted along the recording."""
    shifts = [37, 111, 202, 305, 401, 96, 250]
    x = de.shifted_bins(binned(spark, sf), ["session"], "bin", "counts", shifts)
    null = de.decode(x, model(spark, sf), ["session", "shuffle"], "bin", "counts", "dur", "heading", F.col("n") >= 2, TRANSITION,
                     True, 1.0, 3.0, model_keys=["session"])
    null = quantiles(cut_lineage(null.select("session", "shuffle", F.abs("error_deg").alias("e"))), ["session", "shuffle"], "e", {"value": 0.5})
    seen = quantiles(cut_lineage(decoded(spark, sf).select("session", F.abs("error_deg").alias("e"))), ["session"], "e", {"value": 0.5})
    return judge(null, seen, ["session"], "median_abs_error_deg")


@query("shuffle_test_units")
def _(spark, sf):
    """Confidence of the decode against models with their units exchanged."""
    models = de.permuted_models(model(spark, sf), draw_orders(7, len(KINDS), seed=0))
    x = de.over_shuffles(binned(spark, sf), 7)
    null = de.decode(x, models, ["session", "shuffle"], "bin", "counts", "dur", "heading", F.col("n") >= 2, TRANSITION,
                     True, 1.0, 3.0)
    null = null.groupBy("session", "shuffle").agg(F.avg("posterior_max").alias("value"))
    seen = decoded(spark, sf).groupBy("session").agg(F.avg("posterior_max").alias("value"))
    return judge(null, seen, ["session"], "mean_posterior_max")


@query("pair_decodes", f"""WITH {BINNED}, a AS (SELECT session, bin + 0.5 AS centre FROM bn WHERE session < 2), z AS (SELECT session, bin AS b_bin, bin * 1.0::DOUBLE AS start, bin + 0.75::DOUBLE AS stop FROM bn WHERE n >= 2),
h AS (SELECT a.session, centre::DOUBLE AS centre, b_bin, stop FROM a ASOF LEFT JOIN z ON z.session = a.session AND a.centre >= z.start) SELECT session, centre, CASE WHEN centre < stop THEN b_bin END AS b_bin FROM h""")
def _(spark, sf):
    from ..operators.joins import asof_join

    x = binned(spark, sf)
    a = x.where("session < 2").select("session", (F.col("bin") + 0.5).cast("double").alias("centre"))
    z = x.where("n >= 2").select("session", F.col("bin").alias("b_bin"), F.col("bin").cast("double").alias("start"), (F.col("bin") + F.lit(0.75)).alias("stop"))
    h = asof_join(a, z, ["session"], "centre", "start", ["b_bin", "stop"])
    return h.select("session", "centre", F.when(F.col("centre") < F.col("stop"), F.col("b_bin")).alias("b_bin"))


@query("run_decoder")
def _(spark, sf):
    from ..plans.decode_session import run_decoder

    x = binned(spark, sf).withColumn("state", F.when(F.col("n") >= 2, "WAKE").otherwise("REM"))
    return run_decoder(x, ["session"], "bin", "counts", "dur", "heading", F.col("state") == "WAKE", {"REM": F.col("state") == "REM"},
                       ANGLES, 20.0, 0.05, 900.0, _BLOCK, n_shuffles=3, min_shift=30, min_run=2.0)




@query("apply_decoder")
def _(spark, sf):
    """Sessions 1 to 3 read with session 0's model; their last unit has no partner."""
    from ..plans.decode_session import apply_decoder

    base = model(spark, sf).where("session = 0").drop("session")
    others = binned(spark, sf).where("session > 0")
    pairs = others.select("session").distinct().withColumn("unit", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(4)])))
    return apply_decoder(base, pairs.withColumn("ref_unit", F.col("unit")), others, ["session"], "bin", "counts", "dur", "heading",
                         F.col("n") >= 2, ANGLES, 900.0, True, 1.0, 3.0)


def _shared_units(spark, sf):
    """Sessions 1 to 3 with the units they share with session 0: all but their last."""
    pairs = binned(spark, sf).where("session > 0").select("session").distinct()
    pairs = pairs.withColumn("unit", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(4)])))
    return pairs.withColumn("ref_unit", F.col("unit"))


@query("transfer_decoder")
def _(spark, sf):
    """Sessions 1 to 3 scored with session 0's model, wake and sleep beside their nulls."""
    from ..plans.decode_session import transfer_decoder

    base = model(spark, sf).where("session = 0").drop("session")
    return transfer_decoder(base, _shared_units(spark, sf), binned(spark, sf).where("session > 0"), ["session"], "bin", "counts", "dur",
                            "heading", F.col("n") >= 2, {"REM": F.col("n") < 2}, ANGLES, 900.0, n_shuffles=3, min_shift=30, min_run=2.0)


@query("reference_decode")
def _(spark, sf):
    """Held-out bins of every session read with the units that the others share."""
    from ..plans.decode_session import held_out, reference_decode, train_decoder

    full = held_out(binned(spark, sf), ["session"], "bin", "dur", F.col("n") >= 2, _BLOCK)
    curves = train_decoder(full, ["session"], "counts", "heading", "dur", ANGLES, 20.0, 0.05)
    return reference_decode(full, curves, curves.where("unit < 4"), ["session"], "bin", "counts", "dur", "heading", {"REM": F.col("n") < 2},
                            ANGLES, 900.0, n_shuffles=3, min_shift=30, min_run=2.0)
