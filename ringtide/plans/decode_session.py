"""Heading decode of a recording: hold out time, fit, decode, judge against shuffles, read sleep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.circular import decoding_metrics
from ..operators.decoding import (decode, default_variance, exchanged_models, fit_encoding_model, over_shuffles, ring_transition,
                                  shifted_bins, silent_units, split_train_test)
from ..operators.nulls import judge, shifts_by_size
from ..operators.quantiles import quantiles
from ..scale import cut_lineage


def read_out(bins: DataFrame, model: DataFrame, keys: list[str], index: str, counts: str, duration: str, heading: str, wake: Column,
             sleep: dict[str, Column], transition, n_shuffles: int = 100, min_shift: int = 1, acausal: bool = True,
             tolerance_deg: float = 10.0, max_gap=1.0, min_run=1.0, seed: int = 0, silent: DataFrame | None = None) -> DataFrame:
    """One row per recording and state with the scores of `model`'s decode and its null.

    Wake is judged against spikes shifted in time, by `min_shift` bins at least
    and as far as the recording itself allows. Recordings of no more than twice
    `min_shift` bins are refused. Sleep has no heading to score: its confidence
    is judged against models with their units exchanged. `silent` holds curves
    that stay in their places when units are exchanged.
    """
    least = max(1, min_shift)
    room = bins.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") <= 2 * least)
    if n_shuffles and (short := room.limit(5).collect()):
        raise ValueError(f"shifts of {least} bins or more do not fit into {', '.join(f'{tuple(r)[:-1]} of {r[-1]} bins' for r in short)}")
    columns = [*keys, "unit", "angle_bin", "rate_hz"]
    quiet = None if silent is None else silent.select(*columns)

    def read(source: DataFrame, curves: DataFrame, mask: Column, by: list[str], model_keys: list[str]) -> DataFrame:
        # scored in several passes below, so a decode is written once rather than repeated
        d = decode(source, curves, by, index, counts, duration, heading, mask, transition, acausal, max_gap, min_run,
                   model_keys=model_keys)
        return cut_lineage(d.select(*by, "decoded_deg", "actual_deg", "error_deg", "posterior_max"))

    def error(d: DataFrame, by: list[str]) -> DataFrame:
        d = d.withColumn("__e", F.abs("error_deg"))
        return quantiles(d, by, "__e", {"value": 0.5}).select(*by, "value")

    def confidence(d: DataFrame, by: list[str]) -> DataFrame:
        return d.groupBy(*by).agg(F.avg("posterior_max").alias("value"))

    shuffled = [*keys, "shuffle"]
    curves = model.select(*columns) if quiet is None else model.select(*columns).union(quiet)
    awake = read(bins, curves, wake, keys, keys)
    moved = read(shifted_bins(bins, keys, index, counts, shifts_by_size(n_shuffles, least, seed)), curves, wake, shuffled, keys)
    judged = judge(error(moved, shuffled), error(awake, keys), keys, "median_abs_error_deg")
    scores = decoding_metrics(awake, keys, "decoded_deg", "actual_deg", tolerance_deg)
    parts = [judged.join(scores.select(*keys, "frac_within_deg", "offset_deg", "n_bins"), keys).withColumn("state", F.lit("WAKE"))]
    exchanged = exchanged_models(model.select(*columns), keys, n_shuffles, seed)
    if quiet is not None:
        exchanged = exchanged.unionByName(over_shuffles(quiet, n_shuffles))
    for name, mask in sleep.items():
        asleep = read(bins, curves, mask, keys, keys)
        null = read(over_shuffles(bins, n_shuffles), exchanged, mask, shuffled, shuffled)
        judged = judge(confidence(null, shuffled), confidence(asleep, keys), keys, "mean_posterior_max")
        size = asleep.groupBy(*keys).agg(F.count("*").cast("bigint").alias("n_bins"))
        none = F.lit(None).cast("double")
        parts.append(judged.join(size, keys).withColumns({"frac_within_deg": none, "offset_deg": none, "state": F.lit(name)}))
    return reduce(DataFrame.unionByName, parts)


def held_out(bins: DataFrame, keys: list[str], index: str, duration: str, wake: Column, block_s: float = 60.0,
             test_fraction: float = 0.3, seed: int = 0) -> DataFrame:
    """`bins` with `is_test`: whether a wake bin is held out; null in bins outside wake."""
    marked = split_train_test(bins.withColumn("__wake", wake), keys, index, duration, "__wake", block_s, test_fraction, "blocks", seed)
    return bins.join(marked.select(*keys, index, "is_test"), [*keys, index], "left")


def train_decoder(full: DataFrame, keys: list[str], counts: str, heading: str, duration: str, n_angle_bins: int = 180,
                  sigma_deg: float = 10.0, min_rate_hz: float = 0.1) -> DataFrame:
    """The curves (`unit`, `angle_bin`, `rate_hz`) of every recording from the bins of `held_out` that are not held out."""
    return cut_lineage(fit_encoding_model(full.where("NOT is_test"), keys, counts, heading, duration, n_angle_bins, sigma_deg, min_rate_hz))


def run_decoder(bins: DataFrame, keys: list[str], index: str, counts: str, duration: str, heading: str, wake: Column,
                sleep: dict[str, Column], n_angle_bins: int = 180, sigma_deg: float = 10.0, min_rate_hz: float = 0.1,
                variance_deg2: float | None = None, block_s: float = 60.0, test_fraction: float = 0.3, n_shuffles: int = 100,
                min_shift: int = 1, acausal: bool = True, tolerance_deg: float = 10.0, max_gap=1.0, min_run=1.0,
                seed: int = 0, bin_s: float = 1 / 60) -> DataFrame:
    """One row per recording and state: wake is fitted on training blocks and read on the held-out ones, see `read_out`.

    Without a `variance_deg2` the heading's step has the variance that bins of `bin_s` seconds have by `default_variance`.
    """
    full = held_out(bins, keys, index, duration, wake, block_s, test_fraction, seed)
    model = train_decoder(full, keys, counts, heading, duration, n_angle_bins, sigma_deg, min_rate_hz)
    return read_out(full, model, keys, index, counts, duration, heading, F.coalesce("is_test", F.lit(False)), sleep,
                    _transition(n_angle_bins, variance_deg2, bin_s), n_shuffles, min_shift, acausal, tolerance_deg, max_gap, min_run, seed)


def reference_decode(full: DataFrame, model: DataFrame, units: DataFrame, keys: list[str], index: str, counts: str, duration: str,
                     heading: str, sleep: dict[str, Column], n_angle_bins: int = 180, variance_deg2: float | None = None,
                     n_shuffles: int = 100, min_shift: int = 1, acausal: bool = True, tolerance_deg: float = 10.0, max_gap=1.0,
                     min_run=1.0, seed: int = 0, bin_s: float = 1 / 60, label: str = "baseline") -> DataFrame:
    """A baseline's held-out bins read with some of its units (`keys`, `unit`), to compare a transfer with.

    `full` and `model` are of `held_out` and `train_decoder`; the other units say nothing.
    """
    chosen = model.join(units.select(*keys, "unit").distinct(), [*keys, "unit"], "left_semi")
    found = read_out(full, chosen, keys, index, counts, duration, heading, F.coalesce("is_test", F.lit(False)), sleep,
                     _transition(n_angle_bins, variance_deg2, bin_s), n_shuffles, min_shift, acausal, tolerance_deg, max_gap, min_run,
                     seed, silent_units(full, chosen, keys, counts, n_angle_bins))
    return _labelled(found, chosen, keys, label)


def transfer_decoder(model: DataFrame, unit_map: DataFrame, bins: DataFrame, keys: list[str], index: str, counts: str, duration: str,
                     heading: str, wake: Column, sleep: dict[str, Column], n_angle_bins: int = 180, variance_deg2: float | None = None,
                     n_shuffles: int = 100, min_shift: int = 1, acausal: bool = True, tolerance_deg: float = 10.0, max_gap=1.0,
                     min_run=1.0, seed: int = 0, bin_s: float = 1 / 60, label: str = "transfer") -> DataFrame:
    """Scores and nulls of other recordings read with one baseline's `model` through the units matched to it.

    `unit_map` is as for `apply_decoder`. All of a recording's wake is read, since nothing was fitted on it.
    """
    curves = model.select(F.col("unit").alias("ref_unit"), "angle_bin", "rate_hz")
    mapped = unit_map.join(curves, "ref_unit").select(*keys, "unit", "angle_bin", "rate_hz")
    found = read_out(bins, mapped, keys, index, counts, duration, heading, wake, sleep, _transition(n_angle_bins, variance_deg2, bin_s),
                     n_shuffles, min_shift, acausal, tolerance_deg, max_gap, min_run, seed, silent_units(bins, mapped, keys, counts, n_angle_bins))
    return _labelled(found, mapped, keys, label)


def _transition(n_angle_bins: int, variance_deg2: float | None, bin_s: float):
    return ring_transition(n_angle_bins, default_variance(bin_s) if variance_deg2 is None else variance_deg2)


def _labelled(found: DataFrame, model: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Summary rows: the decode's label and the units that it read."""
    units = model.groupBy(*keys).agg(F.countDistinct("unit").alias("n_units"))
    return found.join(units, keys).withColumn("label", F.lit(label))


def apply_decoder(model: DataFrame, unit_map: DataFrame, bins: DataFrame, keys: list[str], index: str, counts: str,
                  duration: str, heading: str, mask: Column, n_angle_bins: int, variance_deg2: float | None = None,
                  acausal: bool = True, max_gap=1.0, min_run=1.0, bin_s: float = 1 / 60) -> DataFrame:
    """Read another recording with a baseline's model through the units matched to it.

    `model` is one baseline's ``unit, angle_bin, rate_hz``; `unit_map` gives, per
    recording, the position ``unit`` in its counts and the baseline's ``ref_unit``.
    Positions without a partner carry no evidence: they get a flat curve.
    """
    curves = model.select(F.col("unit").alias("ref_unit"), "angle_bin", "rate_hz")
    mapped = unit_map.join(curves, "ref_unit").select(*keys, "unit", "angle_bin", "rate_hz")
    full = mapped.union(silent_units(bins, mapped, keys, counts, n_angle_bins).select(*mapped.columns))
    return decode(bins, full, keys, index, counts, duration, heading, mask, _transition(n_angle_bins, variance_deg2, bin_s),
                  acausal, max_gap, min_run)
