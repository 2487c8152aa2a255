"""Queries: signals from field potentials and the scoring built on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.angles import r6
from ..operators import lfp
from ..operators import thresholds as th
from ..operators.channels import even_positions
from . import bindings as b
from .recordings import _ADC, adc
from .registry import query

FS, NWIN, NSTEP = 32.0, 64, 8
RANGE, N_FREQS = (1.0, 14.0), 12
FREQS = lfp.log_frequencies(RANGE, N_FREQS)
CHANNELS = 64
PLACES = [((i % 2) * 32.0, (i // 2) * 20.0) for i in range(CHANNELS)]


def mean_samples(spark, sf):
    from ..operators.traces import mean_trace

    return mean_trace(b.samples(spark, sf), "v").select("frame", F.col("mean").alias("x"))


def spectra(spark, sf):
    return lfp.log_spectrogram(mean_samples(spark, sf), [], "frame", "x", FS, NWIN / FS, NSTEP / FS, RANGE, N_FREQS, 16)


def _interpolation() -> str:
    grid = np.fft.rfftfreq(NWIN, 1 / FS)
    rows = []
    for i, f in enumerate(FREQS):
        k = min(int(np.searchsorted(grid, f, side="right")) - 1, len(grid) - 2)
        share = float((f - grid[k]) / (grid[k + 1] - grid[k]))
        rows += [f"({i}, {k}, {1 - share!r}::DOUBLE)", f"({i}, {k + 1}, {share!r}::DOUBLE)"]
    return ", ".join(rows)


_SPEC = f"""tr AS (SELECT vec_id AS n, list_sum(embedding::DOUBLE[])/len(embedding) AS x FROM embeddings),
wn AS (SELECT w.range AS win FROM range((SELECT 1 + (count(*) - {NWIN}) // {NSTEP} FROM tr)) w),
sg AS (SELECT win, n - win*{NSTEP} AS k, x * (0.5 - 0.5*cos(2*pi()*(n - win*{NSTEP})/{NWIN - 1})) AS v FROM wn JOIN tr ON n >= win*{NSTEP} AND n < win*{NSTEP} + {NWIN}),
ft AS (SELECT win, q.range AS f, pow(sum(v*cos(2*pi()*k*q.range/{NWIN})), 2) + pow(sum(v*sin(2*pi()*k*q.range/{NWIN})), 2) AS p FROM sg, range({NWIN // 2 + 1}) q GROUP BY 1, 2),
ip(i, f, w) AS (VALUES {_interpolation()}), pw AS (SELECT win, i, sum(p*w) AS p FROM ft JOIN ip ON ip.f = ft.f GROUP BY 1, 2)"""


@query("log_spectrogram", f"WITH {_SPEC} SELECT win AS \"window\", i AS freq_index, round(p, 6) AS power, (win*{NSTEP} + {NWIN / 2})/{FS}::DOUBLE AS t FROM pw")
def _(spark, sf):
    s = spectra(spark, sf).select("window", "t", F.posexplode("power").alias("freq_index", "power"))
    return s.select("window", F.col("freq_index").cast("int").alias("freq_index"), r6("power").alias("power"), "t")


def _inside(band) -> str:
    return ", ".join(str(i) for i in np.flatnonzero((FREQS >= band[0]) & (FREQS <= band[1])))


@query("theta_ratio", f"WITH {_SPEC} SELECT win AS \"window\", round(sum(p) FILTER (i IN ({_inside((5, 10))})) / sum(p) FILTER (i IN ({_inside((2, 13))})), 6) AS theta FROM pw GROUP BY 1")
def _(spark, sf):
    return spectra(spark, sf).select("window", r6(lfp.theta_ratio("power", FREQS, (5, 10), (2, 13))).alias("theta"))


@query("broadband_slow_wave")
def _(spark, sf):
    return lfp.broadband_slow_wave(spectra(spark, sf), [], FREQS, 4.0).select("window", "broadband")


_SLOTS = even_positions(CHANNELS, 8)
_FAR = ", ".join(f"({a}, {c})" for n, a in enumerate(_SLOTS) for c in _SLOTS[n + 1:] if np.hypot(PLACES[a][0] - PLACES[c][0], PLACES[a][1] - PLACES[c][1]) >= 100)


def _muscle(spark, sf, band):
    chosen = b.samples(spark, sf).select("frame", lfp.pick_slots("v", CHANNELS, 8).alias("c"))
    return lfp.emg_from_lfp(chosen, [], "frame", "c", [PLACES[i] for i in _SLOTS], FS, NWIN / FS, NSTEP / FS, band, 100.0, 16)


@query("emg_from_lfp_unfiltered", f"""WITH {_ADC}, fp(a, c) AS (VALUES {_FAR}), n AS (SELECT count(*) AS n FROM embeddings), wn AS (SELECT w.range AS win FROM range((SELECT 1 + (n - {NWIN}) // {NSTEP} FROM n)) w),
r AS (SELECT win, a, c, corr(x.v, y.v) AS r FROM wn, fp JOIN ad x ON x.channel = a AND x.frame >= win*{NSTEP} AND x.frame < win*{NSTEP} + {NWIN} JOIN ad y ON y.channel = c AND y.frame = x.frame GROUP BY 1, 2, 3) SELECT win AS "window", round(avg(r), 6) + 0.0 AS emg FROM r GROUP BY 1""")
def _(spark, sf):
    return _muscle(spark, sf, None).select("window", r6("emg").alias("emg"))


@query("emg_from_lfp")
def _(spark, sf):
    return _muscle(spark, sf, (4.0, 10.0))


@query("smooth_boxcar", f"""WITH {b.STATE_BINS} SELECT session, bin, round(sum(n) OVER (PARTITION BY session ORDER BY bin RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING)/6.0, 6) AS n FROM sb""")
def _(spark, sf):
    x = b.state_bins(spark, sf).select("session", "bin", F.col("n").cast("double").alias("n"))
    return lfp.boxcar(x, ["session"], "bin", ["n"], 6).withColumn("n", r6("n"))


_CHANNEL_EM = f"""WITH RECURSIVE {_ADC}, d AS (SELECT channel AS kind, v AS x FROM ad), i0 AS (SELECT kind, count(*) AS total, quantile_cont(x, 0.25) AS m1, quantile_cont(x, 0.75) AS m2, greatest(sum(x*x)/count(*) - (sum(x)/count(*))*(sum(x)/count(*)), 1e-12) AS v FROM d GROUP BY 1),
em AS (SELECT 0 AS it, kind, total, m1, m2, v AS v1, v AS v2, CAST(0.5 AS DOUBLE) AS w1 FROM i0 UNION ALL SELECT it + 1, kind, total, x1/r1, x2/r2, greatest(xx1/r1 - (x1/r1)*(x1/r1), 1e-12), greatest(xx2/r2 - (x2/r2)*(x2/r2), 1e-12), r1/total FROM
 (SELECT it, kind, any_value(total) AS total, sum(r) AS r1, sum(r*x) AS x1, sum(r*x*x) AS xx1, sum(1-r) AS r2, sum((1-r)*x) AS x2, sum((1-r)*x*x) AS xx2 FROM (SELECT em.it, em.kind, em.total, x, (w1*exp(-(x-m1)*(x-m1)/(2*v1))/sqrt(v1)) / (w1*exp(-(x-m1)*(x-m1)/(2*v1))/sqrt(v1) + (1-w1)*exp(-(x-m2)*(x-m2)/(2*v2))/sqrt(v2)) AS r FROM em JOIN d ON d.kind = em.kind WHERE em.it < 20) GROUP BY it, kind)),
sc AS (SELECT kind AS channel, abs(m1 - m2)/greatest(sqrt((v1+v2)/2), 1e-12) AS score FROM em WHERE it = 20)"""


@query("rank_channels_by_bimodality", _CHANNEL_EM + " SELECT channel, round(score, 5) AS score, rank() OVER (ORDER BY round(score, 5) DESC, channel) - 1 AS position FROM sc")
def _(spark, sf):
    from ..operators.scan import number_rows

    s = th.bimodality_score(adc(spark, sf), ["channel"], "v").select("channel", r6("score", 5).alias("score"))
    s = s.withColumn("__o", -F.col("score"))
    return number_rows(s, [], ["__o", "channel"], "position").drop("__o")


@query("pick_bimodal_channels", _CHANNEL_EM + ", t AS (SELECT channel FROM sc WHERE channel % 4 = 0 ORDER BY round(score, 5) DESC, channel LIMIT 8) SELECT channel FROM t")
def _(spark, sf):
    strided = adc(spark, sf).where("channel % 4 = 0")  # candidates are every fourth channel
    s = th.bimodality_score(strided, ["channel"], "v")
    return s.orderBy(F.desc_nulls_last(F.round("score", 5)), "channel").limit(8).select("channel")


CONFIG = {"freq_range": RANGE, "n_freqs": N_FREQS, "n_sw_channels": 8, "n_emg_channels": 8, "window_s": NWIN / FS, "step_s": NSTEP / FS,
          "slow_wave_max_hz": 4.0, "theta_band": (5, 10), "theta_ref_band": (2, 13), "emg_band": (4.0, 10.0), "emg_min_distance_um": 100.0, "smooth_s": 1.0}


@query("score_recording")
def _(spark, sf):
    from ..plans.score_recording import score_recording, state_signals

    s = state_signals(b.samples(spark, sf), [], "frame", "v", CHANNELS, FS, CONFIG, PLACES)
    return score_recording(s, [], NSTEP / FS, 1.0, iterations=8)
