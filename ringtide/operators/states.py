"""Brain-state codes per bin: rules, smoothing of short runs, movement veto, speed."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import finite
from .runs import label_runs, state_epochs
from .scan import last_valid, next_valid, number_rows, plan_cuts, previous, running_sum, scan

# The code stored for each state.
STATE_CODES = {"WAKE": 1, "NREM": 3, "REM": 5}


def state_name(code: Column | str) -> Column:
    """Name of a stored code, '?' for one not known."""
    c = F.col(code) if isinstance(code, str) else code
    out = F.when(c == STATE_CODES["WAKE"], "WAKE")
    for name in ("NREM", "REM"):
        out = out.when(c == STATE_CODES[name], name)
    return out.otherwise("?")


def classify_states(broadband, theta, emg, broadband_cut, theta_cut, emg_cut) -> Column:
    """Slow waves first, then quiet theta, and wakefulness for the rest."""
    return (
        F.when(F.col(broadband) > broadband_cut, STATE_CODES["NREM"])
        .when((F.col(emg) <= emg_cut) & (F.col(theta) > theta_cut), STATE_CODES["REM"])
        .otherwise(STATE_CODES["WAKE"])
    )


def intervals_from_states(bins: DataFrame, keys: list[str], index: str, time: str, code: str,
                          step) -> DataFrame:
    """Spans of each known state, numbered in time order within the state."""
    epochs = state_epochs(bins, keys, index, time, code, step).withColumn("state", state_name(code))
    spans = epochs.where("state <> '?'").select(*keys, "state", "start", "stop")
    return number_rows(spans, [*keys, "state"], ["start"], "position")


def _absorb(lengths: list[int], codes: list, minimum: int, open_start: bool, open_stop: bool) -> list:
    """Final code of each run after short ones join their longer neighbour.

    Shortest run first and the earliest of equals; a linked list of runs with a
    heap, so a segment of n runs costs n log n.
    """
    n = len(lengths)
    owner_code = list(codes)
    size = list(lengths)
    left = list(range(-1, n - 1))
    right = [*range(1, n), -1]
    parent = list(range(n))
    alive = [True] * n
    heap = [(size[i], i) for i in range(n) if size[i] < minimum]
    heapq.heapify(heap)

    def merge(a: int, b: int) -> int:
        """Join neighbours a (before) and b (after); the earlier index stays."""
        parent[b] = a
        alive[b] = False
        size[a] += size[b]
        right[a] = right[b]
        if right[b] >= 0:
            left[right[b]] = a
        return a

    while heap:
        length, i = heapq.heappop(heap)
        if not alive[i] or size[i] != length or size[i] >= minimum:
            continue
        before, after = left[i], right[i]
        if before < 0 and after < 0:
            break
        if before < 0:
            winner = after
        elif after < 0:
            winner = before
        else:
            winner = before if size[before] >= size[after] else after
        owner_code[i] = owner_code[winner]
        kept = i
        if before >= 0 and owner_code[before] == owner_code[kept]:
            kept = merge(before, kept)
        after = right[kept]
        if after >= 0 and owner_code[after] == owner_code[kept]:
            kept = merge(kept, after)
        if size[kept] < minimum:
            heapq.heappush(heap, (size[kept], kept))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    return [owner_code[root(i)] for i in range(n)]


def enforce_min_duration(bins: DataFrame, keys: list[str], index: str, code: str, step: float,
                         min_duration: float, out: str = "code_smoothed",
                         chunks=None) -> DataFrame:
    """Absorb runs shorter than `min_duration` into the longer neighbour, shortest first.

    The bins are first reduced to one row per run. Between two neighbouring runs
    that are both long enough nothing can pass, because neither is ever absorbed
    and each only compares with its other side; the runs are cut there, and each
    piece is resolved by itself.
    """
    minimum = round(min_duration / step)
    if minimum <= 1:
        return bins.withColumn(out, F.col(code))
    runs = label_runs(bins, keys, [index], [code], "__run", chunks=chunks)
    table = runs.groupBy(*keys, "__run").agg(F.first(code).alias("__code"), F.count("*").alias("__n"))
    long_run = F.col("__n") >= minimum
    table = scan(table, keys, ["__run"], {"__prev_long": previous(long_run)}, chunks)
    table = table.withColumn("__cut", (long_run & F.coalesce("__prev_long", F.lit(False))).cast("bigint"))
    table = scan(table, keys, ["__run"], {"__piece": running_sum("__cut")}, chunks)
    fields = [table.schema[k] for k in keys]
    fields += [T.StructField("__run", T.LongType()), T.StructField("__final", bins.schema[code].dataType)]

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__run")
        final = _absorb(pdf["__n"].tolist(), pdf["__code"].tolist(), minimum, True, True)
        return pdf[[*keys, "__run"]].assign(__final=final)

    short = table.groupBy(*keys, "__piece").agg(F.min("__n").alias("__least"))
    short = short.where(F.col("__least") < minimum).select(*keys, "__piece")
    touched = table.join(short, [*keys, "__piece"], "left_semi")
    final = touched.groupBy(*keys, "__piece").applyInPandas(resolve, T.StructType(fields))
    joined = runs.join(final, [*keys, "__run"], "left")
    kept = [c for c in bins.columns if c != out]
    return joined.select(*kept, F.coalesce("__final", code).alias(out))


def apply_movement_veto(bins: DataFrame, keys: list[str], index: str, code: str, speed: str,
                        threshold_log10: float | Column, step: float, min_duration: float,
                        veto: tuple[str, ...] = ("NREM", "REM"), floor: float = 1e-3) -> DataFrame:
    """Bins scored asleep while moving become WAKE; short runs are absorbed again.

    The threshold may be a column of `bins`; a null one moves nothing.

    Adds ``moving``, ``code_before`` and ``code_after``. Bins without a speed stay.
    """
    value = F.log10(F.greatest(F.col(speed).cast("double"), F.lit(floor)))
    moving = F.coalesce(finite(speed) & (value > threshold_log10), F.lit(False))
    targets = F.col(code).isin(*[STATE_CODES[v] for v in veto])
    work = bins.withColumns({"moving": moving, "code_before": F.col(code)})
    work = work.withColumn(
        "__vetoed", F.when(F.col("moving") & targets, STATE_CODES["WAKE"]).otherwise(F.col(code)).cast(
            bins.schema[code].dataType))
    out = enforce_min_duration(work, keys, index, "__vetoed", step, min_duration, "code_after")
    return out.drop("__vetoed")


def veto_summary(vetoed: DataFrame, keys: list[str], speed: str) -> DataFrame:
    """How much the veto touched, per key."""
    changed = F.col("code_after") != F.col("code_before")
    return vetoed.groupBy(*keys).agg(
        F.avg(finite(speed).cast("double")).alias("coverage"),
        F.avg(F.col("moving").cast("double")).alias("fraction_moving"),
        F.sum(changed.cast("bigint")).alias("n_reassigned"),
        F.avg(changed.cast("double")).alias("fraction_reassigned"),
    )


def held_frames(frames: DataFrame, keys: list[str], order: list[str], coordinates: list[str],
                name: str = "held", chunks=None) -> DataFrame:
    """Flag rows that repeat the previous row on every coordinate."""
    out = scan(frames, keys, order, {"__prev": previous(F.struct(*coordinates))}, chunks)
    same = F.lit(True)
    for c in coordinates:
        same = same & (F.col(c) == F.col("__prev")[c])
    return out.withColumn(name, F.coalesce(same, F.lit(False))).drop("__prev")


def frame_speeds(frames: DataFrame, keys: list[str], time: str, coordinates: list[str],
                 max_gap: float, tie: list[str] | None = None, chunks=None) -> DataFrame:
    """Speed between consecutive usable frames; steps over more than `max_gap` get none."""
    order = [time, *(tie or [])]
    chunks = plan_cuts(frames, order, chunks, keyless=not keys)
    work = held_frames(frames, keys, order, coordinates, "held", chunks)
    usable = ~F.col("held")
    for c in coordinates:
        usable = usable & finite(c)
    work = work.where(usable)
    work = scan(work, keys, order, {"__prev": previous(F.struct(time, *coordinates))}, chunks)
    distance = F.lit(0.0)
    for c in coordinates:
        distance = distance + (F.col(c) - F.col("__prev")[c]) * (F.col(c) - F.col("__prev")[c])
    elapsed = F.col(time) - F.col("__prev")[time]
    speed = F.when((elapsed > 0) & (elapsed <= max_gap), F.sqrt(distance) / elapsed)
    return work.withColumn("speed", speed).drop("__prev")


def interpolate_gaps(bins: DataFrame, keys: list[str], index: str, value: str, step: float,
                     max_gap: float = 2.0, out: str | None = None, chunks=None) -> DataFrame:
    """Fill runs of missing values closed on both sides and no longer than `max_gap`."""
    out = out or value
    limit = round(max_gap / step) if max_gap > 0 else 0
    chunks = plan_cuts(bins, index, chunks, keyless=not keys)
    work = number_rows(bins, keys, [index], "__i", chunks)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(value).cast("double").alias("v")))
    work = scan(work, keys, [index], {"__a": last_valid(known), "__b": next_valid(known)}, chunks)
    gap = F.col("__b.i") - F.col("__a.i") - 1
    share = (F.col("__i") - F.col("__a.i")) / (F.col("__b.i") - F.col("__a.i"))
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * share
    filled = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(gap <= limit, line)
    kept = [c for c in bins.columns if c != out]
    return work.select(*kept, filled.alias(out))


def binned_speed(frames: DataFrame, bins: DataFrame, keys: list[str], time: str,
                 coordinates: list[str], index: str, step: float, max_gap: float = 0.5,
                 interpolate: float = 2.0, tie: list[str] | None = None) -> DataFrame:
    """Mean speed per state bin, with short gaps interpolated.

    `bins` holds the grid: bin i spans ``i*step <= t < (i+1)*step``.
    """
    speeds = frame_speeds(frames, keys, time, coordinates, max_gap, tie).where("speed IS NOT NULL")
    means = speeds.groupBy(*keys, F.floor(F.col(time) / step).cast("bigint").alias(index)).agg(
        F.avg("speed").alias("speed"))
    grid = bins.select(*keys, index).join(means, [*keys, index], "left")
    return interpolate_gaps(grid, keys, index, "speed", step, interpolate)
