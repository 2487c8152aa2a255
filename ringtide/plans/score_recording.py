"""State scoring of recordings: signals, smoothing, thresholds, rule, minimum duration, veto."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lfp import boxcar, broadband_slow_wave, emg_from_lfp, log_frequencies, log_spectrogram, pick_slots, theta_ratio
from ..operators.quantiles import quantiles
from ..operators.states import apply_movement_veto, classify_states, enforce_min_duration
from ..operators.thresholds import crossing, gaussian_pair, movement_thresholds
from ..scale import cut_lineage

SIGNALS = ["broadband", "theta", "emg"]


def state_signals(samples: DataFrame, keys: list[str], frame: str, traces: str, n_channels: int, fs: float, config: dict,
                  positions: list[tuple[float, float]]) -> DataFrame:
    """Slow-wave, theta and muscle signals per window, smoothed."""
    from ..operators.channels import even_positions

    freqs = log_frequencies(config["freq_range"], config["n_freqs"])
    chosen = pick_slots(traces, n_channels, config["n_sw_channels"])
    mean = F.aggregate("__c", F.lit(0.0), lambda a, x: a + x) / F.size("__c")
    lfp = samples.withColumn("__c", chosen).select(*keys, frame, mean.alias("__x"))
    spectra = log_spectrogram(lfp, keys, frame, "__x", fs, config["window_s"], config["step_s"], config["freq_range"], config["n_freqs"])
    slow = broadband_slow_wave(spectra, keys, freqs, config["slow_wave_max_hz"])
    slow = slow.withColumn("theta", theta_ratio("power", freqs, config["theta_band"], config["theta_ref_band"])).drop("power")
    muscle = samples.select(*keys, frame, pick_slots(traces, n_channels, config["n_emg_channels"]).alias("__c"))
    at = [positions[i] for i in even_positions(n_channels, config["n_emg_channels"])]
    emg = emg_from_lfp(muscle, keys, frame, "__c", at, fs, config["window_s"], config["step_s"], config["emg_band"],
                       config["emg_min_distance_um"])
    both = slow.join(emg, [*keys, "window"])
    return boxcar(both, keys, "window", SIGNALS, max(round(config["smooth_s"] / config["step_s"]), 1))


def signal_thresholds(signals: DataFrame, keys: list[str], iterations: int = 20) -> DataFrame:
    """Cut of each signal between its two modes; all signals and recordings are fitted together."""
    stacked = signals.select(*keys, F.stack(F.lit(len(SIGNALS)), *[x for s in SIGNALS for x in (F.lit(s), F.col(s))]).alias("signal", "value"))
    by = [*keys, "signal"]
    fit = gaussian_pair(stacked, by, "value", iterations)
    middle = {tuple(r[k] for k in by): r["m"] for r in quantiles(stacked, by, "value", {"m": 0.5}).collect()}
    rows = [(*[r[k] for k in by], float(crossing(r, 1000, middle[tuple(r[k] for k in by)]))) for r in fit.collect()]
    schema = stacked.select(*by).schema.add("cut", "double")
    return signals.sparkSession.createDataFrame(rows, schema)


def score_recording(signals: DataFrame, keys: list[str], step_s: float, min_duration: float, speed: DataFrame | None = None,
                    threshold_log10: float | None = None, iterations: int = 20) -> DataFrame:
    """State code per window, with the code before any movement veto."""
    signals = cut_lineage(signals)
    cuts = signal_thresholds(signals, keys, iterations)
    wide = cuts.groupBy(*keys).pivot("signal", SIGNALS).agg(F.first("cut"))
    wide = reduce(lambda d, s: d.withColumnRenamed(s, f"__{s}"), SIGNALS, wide)
    work = signals.join(wide, keys) if keys else signals.withColumns(
        {f"__{s}": wide.select(f"__{s}").scalar() for s in SIGNALS})
    code = classify_states("broadband", "theta", "emg", F.col("__broadband"), F.col("__theta"), F.col("__emg"))
    work = work.withColumn("__code", code).drop(*[f"__{s}" for s in SIGNALS])
    scored = enforce_min_duration(work, keys, "window", "__code", step_s, min_duration, "code").drop("__code")
    if speed is None:
        return scored.withColumn("code_before", F.col("code"))
    moving = scored.join(speed, [*keys, "window"], "left")
    cut = F.lit(threshold_log10).cast("double")
    if threshold_log10 is None:  # one for every recording
        found = movement_thresholds(moving, keys, "speed").select(*keys, F.col("threshold").alias("__cut"))
        moving = moving.join(found, keys, "left") if keys else moving.withColumn("__cut", found.select("__cut").scalar())
        cut = F.col("__cut")
    out = apply_movement_veto(moving, keys, "window", "code", "speed", cut, step_s, min_duration)
    return out.drop("code", "__cut").withColumnRenamed("code_after", "code")
