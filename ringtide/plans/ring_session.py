"""Ring analysis of one or more recordings: screen, embed, align, decode, test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.angles import circular_difference
from ..operators.blocks import smoothed_rates
from ..operators.circular import align_angles, decoding_metrics
from ..operators.pairs import masked_rates, pairwise_correlations
from ..operators.quantiles import corr_or_null, quantiles
from ..operators.ring import (alignment_apply, embed_pairs, partner_snr, population_vector, ring_coupling,
                              standardised_pairs, unit_weights)
from ..operators.scan import running_sum, scan
from ..scale import cut_lineage


def halves(bins: DataFrame, keys: list[str], index: str, duration: str, mask: str) -> DataFrame:
    """Flag ``first_half``: the masked bins up to half of the masked time."""
    kept = bins.withColumn("__d", F.when(F.col(mask), F.col(duration).cast("double")).otherwise(0.0))
    timed = scan(kept, keys, [index], {"__upto": running_sum("__d")})
    total = kept.groupBy(*keys).agg(F.sum("__d").alias("__total"))
    timed = timed.join(total, keys) if keys else timed.withColumn("__total", total.scalar())
    first = F.col(mask) & (F.col("__upto") <= F.col("__total") / 2)
    return timed.withColumns({"first_half": first, "second_half": F.col(mask) & ~first}).drop("__d", "__upto", "__total")


def fit_ring(bins: DataFrame, keys: list[str], index: str, counts: str, duration: str, mask: str, sigma_bins: float,
             max_lag: int, start_lag: int, k_neighbors: int = 8, min_rate_hz: float = 0.1,
             min_partner_snr: float | None = 4.0) -> dict[str, DataFrame]:
    """Place units on a ring by how they fire together; no heading is used.

    Pair scores come from all of the masked time and from each half of it: the
    halves give the noise that the screen is measured against and the split-half
    reliability. Returns ``screen`` (one row per candidate), ``pairs`` and
    ``units`` (one row per unit on the ring).
    """
    def metric(which: DataFrame, flag: str) -> DataFrame:
        return pairwise_correlations(which, keys, index, counts, duration, flag, sigma_bins, max_lag, start_lag)

    rates = masked_rates(bins, keys, counts, duration, mask)
    active = rates.where(F.col("rate_hz") >= min_rate_hz).select(*keys, "unit")
    cut = halves(bins, keys, index, duration, mask)

    def among(pairs: DataFrame, units: DataFrame) -> DataFrame:
        for side in ("i", "j"):
            pairs = pairs.join(units.withColumnRenamed("unit", side), [*keys, side], "left_semi")
        return pairs

    active = cut_lineage(active)
    # each of these tables holds a row per pair of units and is read several times
    whole = cut_lineage(among(metric(bins, mask), active).where("i <> j"))
    first = among(metric(cut, "first_half"), active).where("i <> j")
    second = among(metric(cut, "second_half"), active).where("i <> j")
    both = first.select(*keys, "i", "j", F.col("metric").alias("a")).join(
        second.select(*keys, "i", "j", F.col("metric").alias("b")), [*keys, "i", "j"])
    both = cut_lineage(both)
    spread = both.withColumn("d", F.col("a") - F.col("b"))
    middle = quantiles(spread, keys, "d", {"m": 0.5}).drop("n_values")
    spread = spread.join(middle, keys) if keys else spread.withColumn("m", middle.scalar())
    spread = spread.withColumn("away", F.abs(F.col("d") - F.col("m")))
    # a half's robust spread, halved: the whole is the mean of two halves
    noise = quantiles(spread, keys, "away", {"mad": 0.5}).select(*keys, (1.4826 * F.col("mad") / 2).alias("noise_sd"))
    scored = whole.join(noise, keys) if keys else whole.withColumn("noise_sd", noise.scalar())
    snr = cut_lineage(partner_snr(scored, keys, "metric", "noise_sd", k_neighbors))
    on = snr if min_partner_snr is None else snr.where(F.col("partner_snr") >= min_partner_snr)
    on = on.select(*keys, "unit")
    status = (F.when(F.col("rate_hz") < min_rate_hz, "silent")
              .when(F.coalesce("__on", F.lit(False)), "ring").otherwise("no partners"))
    screen = rates.join(snr, [*keys, "unit"], "left").join(
        on.withColumn("__on", F.lit(True)), [*keys, "unit"], "left").withColumn("status", status).drop("__on")
    kept = cut_lineage(standardised_pairs(among(whole, on), keys, "metric"))
    placed = cut_lineage(embed_pairs(kept, keys, "metric", k_neighbors))
    slope, overall = ring_coupling(kept, keys, placed)
    split = among(both, on).where("i < j").groupBy(*keys).agg(corr_or_null("a", "b").alias("split_half_r"))
    units = placed.join(slope, [*keys, "unit"])
    for extra in (overall, split):
        units = units.join(extra, keys) if keys else units.withColumn(extra.columns[-1], extra.scalar())
    return {"screen": screen, "pairs": kept, "units": units}


def ring_shift_null(train: DataFrame, test: DataFrame, headings: DataFrame, index: str, shifts: list[int], n_bins: int) -> DataFrame:
    """Median error of a ring decode against headings moved in time, aligned anew for each shift.

    `train` and `test` have the bin and ``ring_deg``; `headings` the bin, from 0,
    and ``heading``. Shift 0, the real pairing, is shuffle -1.
    """
    table = F.array(*[F.struct(F.lit(s).alias("shuffle"), F.lit(d).alias("d")) for s, d in enumerate([0, *shifts], start=-1)])

    def paired(rows: DataFrame) -> DataFrame:
        moved = rows.select("ring_deg", F.col(index).alias("__i"), F.explode(table).alias("__s"))
        moved = moved.select("ring_deg", F.col("__s.shuffle").alias("shuffle"), F.pmod(F.col("__i") - F.col("__s.d"), F.lit(n_bins)).alias(index))
        return moved.join(headings.select(index, "heading"), index)

    fitted = align_angles(paired(train), ["shuffle"], "ring_deg", "heading").select("shuffle", "flip", "offset_deg")
    scored = paired(test).join(fitted, "shuffle")
    turned = alignment_apply("ring_deg", "flip", "offset_deg")
    scored = scored.withColumn("__e", F.abs(circular_difference(turned, F.col("heading"))))
    return quantiles(scored, ["shuffle"], "__e", {"value": 0.5}).select("shuffle", "value")


def ring_unit_null(rates: DataFrame, index: str, values: str, ring: DataFrame, orders: list[list[int]]) -> DataFrame:
    """Mean vector length with the units' angles exchanged, their weights staying; one row per order.

    `ring` has ``unit, angle_deg, weight`` for units 0 to n-1.
    """
    rows = [(s, p, int(q)) for s, o in enumerate([list(range(len(orders[0]))), *orders], start=-1) for p, q in enumerate(o)]
    mapping = ring.sparkSession.createDataFrame(rows, "shuffle int, unit bigint, __from bigint")
    angles = ring.select(F.col("unit").alias("__from"), "angle_deg")
    mixed = mapping.join(ring.select("unit", "weight"), "unit").join(angles, "__from").drop("__from")
    many = rates.withColumn("shuffle", F.explode(F.sequence(F.lit(-1), F.lit(len(orders) - 1))))
    vectors = population_vector(many, ["shuffle"], index, values, mixed)
    return vectors.groupBy("shuffle").agg(F.avg("length").alias("value"))


def decode_ring(rates: DataFrame, keys: list[str], index: str, values: str, ring: DataFrame, heading: str, train: str,
                weights: str = "coupling") -> DataFrame:
    """Heading per bin from where on the ring the population is active, aligned on the training bins."""
    weighted = unit_weights(ring, keys, weights)
    vectors = population_vector(rates, keys, index, values, weighted)
    fitted = align_angles(vectors.where(train), keys, "ring_deg", heading).select(*keys, "flip", "offset_deg")
    if keys:
        out = vectors.join(fitted, keys)
    else:
        one = fitted.select(F.struct("flip", "offset_deg").alias("a"))
        out = vectors.withColumn("__a", one.scalar()).withColumns({"flip": F.col("__a.flip"), "offset_deg": F.col("__a.offset_deg")}).drop("__a")
    decoded = alignment_apply("ring_deg", "flip", "offset_deg")
    return out.withColumn("decoded_deg", decoded).withColumn("error_deg", circular_difference(F.col("decoded_deg"), F.col(heading)))


def run_ring(bins: DataFrame, keys: list[str], index: str, counts: str, duration: str, heading: str, train: str, test: str,
             sigma_bins: float, max_lag: int, start_lag: int, k_neighbors: int = 8, min_rate_hz: float = 0.1,
             min_partner_snr: float | None = 4.0, weights: str = "coupling", tolerance_deg: float = 10.0) -> dict[str, DataFrame]:
    """Fit a ring on the training bins, decode the held-out ones, and score them."""
    fitted = fit_ring(bins, keys, index, counts, duration, train, sigma_bins, max_lag, start_lag, k_neighbors, min_rate_hz, min_partner_snr)
    rates = smoothed_rates(bins, keys, index, counts, duration, sigma_bins)
    read = cut_lineage(decode_ring(rates, keys, index, "rates", fitted["units"], heading, train, weights).select(
        *keys, index, heading, train, test, "ring_deg", "length", "decoded_deg", "error_deg"))
    scores = decoding_metrics(read.where(test), keys, "decoded_deg", heading, tolerance_deg)
    return {**fitted, "decoded": read, "metrics": scores}
