"""Tuning under circular shifts of the spikes: blocks of the frame clock, then one matrix per unit.

A shift moves every spike to the heading that another frame saw. A block of
frames meets the pieces of the track that its shifts reach, so what is shuffled
is a byte per spike and shift, not a row. A unit's counts by shift and bin are
added up from these; their size is shifts times bins, whatever its spikes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.angles import heading_bin
from ..scale import written
from .scan import number_rows

FRAMES = 16384  # frames of a block
CELLS = 2_000_000  # counts that a task holds at once


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def reached_by(source: int, n_frames: int, shifts: list[int], block: int) -> list[int]:
    """Blocks with a frame ``i`` so that ``(i - s) mod n`` lies in the block `source` for one of the shifts."""
    held, last, found = min(block, n_frames - source * block), (n_frames - 1) // block, set()
    for s in shifts:
        low = (source * block + s) % n_frames
        high = low + held - 1
        found.update(range(low // block, min(high // block, last) + 1))
        if high >= n_frames:
            found.update(range((high - n_frames) // block + 1))
    return sorted(found)


def shifted_cells(frames: DataFrame, unit: str, heading: str, order: list[str], n_bins: int,
                  shifts: list[int], n_frames: int, block: int = FRAMES) -> DataFrame:
    """Where each unit's spikes go, as ``unit, __dense, __cells``; a unit has a row in every block that holds it.

    Cells are the bins of the block's spikes under every shift, `n_bins` for no
    heading; or, if that is shorter, counts by shift and bin.
    """
    numbered = number_rows(frames, [], order, "__frame").select(
        unit, F.col("__frame").cast("bigint").alias("__frame"),
        F.coalesce(heading_bin(F.col(heading), n_bins), F.lit(n_bins)).cast("int").alias("__bin"))
    numbered = written(numbered, "shifted-frames").withColumn("__block", F.expr(f"__frame div {block}"))
    kind, by = np.min_scalar_type(n_bins), np.array(shifts, dtype=np.int64)

    def pack(table: pa.Table) -> pa.Table:
        at = table["__frame"].to_numpy()
        source = int(at[0]) // block
        track = np.full(block, n_bins, kind)
        track[at - source * block] = table["__bin"].to_numpy()
        to = reached_by(source, n_frames, shifts, block)
        return pa.table({"__block": pa.array(to, pa.int64()), "__from": pa.array([source] * len(to), pa.int64()),
                         "__track": pa.array([track.tobytes()] * len(to), pa.binary())})

    def move(spikes: pa.Table, tracks: pa.Table) -> pa.Table:
        source = tracks["__from"].to_numpy()
        by_source = np.argsort(source)
        seen = np.stack([np.frombuffer(t, kind) for t in tracks["__track"].to_pylist()])[by_source]
        units = pa.chunked_array(spikes[unit]).combine_chunks().dictionary_encode(null_encoding="encode")
        of = units.indices.to_numpy()
        grouped = np.argsort(of, kind="stable")
        at = (spikes["__frame"].to_numpy()[grouped, None] - by) % n_frames
        cells = seen[np.searchsorted(source[by_source], at // block), at % block]
        sizes = np.bincount(of, minlength=len(units.dictionary))
        few = sizes * kind.itemsize <= (n_bins + 1) * 8
        ends = np.concatenate([[0], np.cumsum(sizes[few] * cells.shape[1] * kind.itemsize)]).astype(np.int32)
        listed = pa.Array.from_buffers(pa.binary(), int(few.sum()), [
            None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(cells[np.repeat(few, sizes)]))])
        starts = np.cumsum(sizes) - sizes
        counted = [_count(cells[starts[u]:starts[u] + sizes[u]], np.zeros(sizes[u], np.int64), 1, n_bins).tobytes()
                   for u in np.flatnonzero(~few)]
        who = np.concatenate([np.flatnonzero(few), np.flatnonzero(~few)])
        return pa.table({unit: units.dictionary.take(pa.array(who)), "__dense": pa.array(~few[who]),
                         "__cells": pa.concat_arrays([listed, pa.array(counted, pa.binary())])})

    tracks = numbered.select("__block", "__frame", "__bin").groupBy("__block").applyInArrow(
        pack, "__block bigint, __from bigint, __track binary")
    spikes = numbered.select("__block", unit, "__frame")
    return spikes.groupBy("__block").cogroup(tracks.groupBy("__block")).applyInArrow(
        move, f"`{unit}` {_type(frames, unit)}, __dense boolean, __cells binary")


def _count(cells: np.ndarray, of: np.ndarray, n: int, n_bins: int) -> np.ndarray:
    """Counts by group, shift and bin of rows of bins; the last one, `n_bins`, stands for none."""
    shifts = cells.shape[1]
    flat = (of[:, None] * shifts + np.arange(shifts)) * (n_bins + 1) + cells
    return np.bincount(flat.ravel(), minlength=n * shifts * (n_bins + 1)).reshape(n, shifts, n_bins + 1)


def per_unit(cells: DataFrame, unit: str, n_shifts: int, n_bins: int, schema: str,
             work: Callable[[np.ndarray], tuple[int, dict]]) -> DataFrame:
    """``work(counts)`` on the counts of some units by unit, shift and bin; it returns rows per unit and columns.

    A last bin counts spikes without a heading.
    """
    kind = np.min_scalar_type(n_bins)
    step = max(1, CELLS // (n_shifts * (n_bins + 1)))

    def out(units: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        rows, columns = work(counts)
        who = units.take(pa.array(np.repeat(np.arange(len(units)), rows)))
        return pa.RecordBatch.from_arrays([who, *columns.values()], names=[unit, *columns])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, None  # the last unit may go on in the next rows
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                own = part.column(0) if held is None else pa.concat_arrays([held, part.column(0)])
                units = own.dictionary_encode(null_encoding="encode")
                of = units.indices.to_numpy()[0 if held is None else 1:]
                n = len(units.dictionary)
                counts = np.zeros((n, n_shifts, n_bins + 1), np.int64)
                dense, raw = part.column(1).to_numpy(zero_copy_only=False).astype(bool), part.column(2).to_pylist()
                few = np.flatnonzero(~dense)
                if len(few):
                    listed = np.frombuffer(b"".join([raw[i] for i in few]), kind).reshape(-1, n_shifts)
                    each = np.array([len(raw[i]) for i in few]) // (n_shifts * kind.itemsize)
                    rows_at_once = max(1, CELLS // n_shifts)
                    whose = np.repeat(of[few], each)
                    for k in range(0, len(listed), rows_at_once):
                        w = whose[k:k + rows_at_once]
                        low, high = w[0], w[-1] + 1  # sorted, as the rows are
                        counts[low:high] += _count(listed[k:k + rows_at_once], w - low, high - low, n_bins)
                for i in np.flatnonzero(dense):
                    counts[of[i]] += np.frombuffer(raw[i], np.int64).reshape(n_shifts, n_bins + 1)
                if held is not None:
                    counts[0] += sums
                if n > 1:
                    yield out(units.dictionary.slice(0, n - 1), counts[:-1])
                held, sums = units.dictionary.slice(n - 1, 1), counts[-1].copy()
        if held is not None:
            yield out(held, sums[None])

    return cells.repartition(unit).sortWithinPartitions(unit).mapInArrow(gather, f"`{unit}` {_type(cells, unit)}, {schema}")


def _lists(values: np.ndarray, known: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists, null where nothing is known."""
    ends = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(values.ravel(), mask=~known.ravel()))


def smoother(occupancy: list[float], kernel: list[tuple[int, float]], per_second: float) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Counts by bin to smoothed rates, and to whether any spike's kernel reaches the bin."""
    n = len(occupancy)
    spread = np.zeros((n, n))
    for i, w in kernel:
        spread[np.arange(n), (np.arange(n) + i) % n] += w
    seconds = np.array(occupancy, dtype=float) / per_second

    def rates(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hz = np.divide(counts, seconds, out=np.zeros(counts.shape), where=seconds > 0)
        return hz @ spread, (counts > 0).astype(float) @ (spread > 0) > 0

    return rates


def shifted_stats(cells: DataFrame, unit: str, n_shifts: int, rates: Callable, n_bins: int) -> DataFrame:
    """A unit's own curve, which the first shift gives, and its lengths under the others, in one pass over its counts.

    ``n_spikes``; ``total``, ``x``, ``y`` and ``peak_rate_hz`` of the smoothed
    curve; ``null_mvl``, the vector length under each further shift, null where
    the curve is silent.
    """
    theta = np.radians((np.arange(n_bins) + 0.5) * (360.0 / n_bins))
    smooth, _ = rates(np.eye(n_bins))  # a curve is the counts times this matrix, and a length needs three of its sums
    sums = smooth @ np.stack([np.ones(n_bins), np.cos(theta), np.sin(theta)], axis=1)

    def work(counts):
        total, x, y = np.moveaxis(counts[:, :, :n_bins] @ sums, 2, 0)
        size = np.divide(np.sqrt(x * x + y * y), total, out=np.zeros_like(total), where=total > 0)
        return 1, {"n_spikes": pa.array(counts[:, 0].sum(axis=1)), "total": pa.array(total[:, 0].copy()), "x": pa.array(x[:, 0].copy()),
                   "y": pa.array(y[:, 0].copy()), "peak_rate_hz": pa.array((counts[:, 0, :n_bins] @ smooth).max(axis=1)),
                   "null_mvl": _lists(size[:, 1:], total[:, 1:] > 0)}

    return per_unit(cells, unit, n_shifts, n_bins, "n_spikes bigint, total double, x double, y double, peak_rate_hz double, "
                    "null_mvl array<double>", work)


def shifted_bands(cells: DataFrame, unit: str, n_shifts: int, rates: Callable, n_bins: int, skip: int = 0) -> DataFrame:
    """``hz`` of a unit and bin: the smoothed rate under each shift after the first `skip`, null where no spike reaches the bin."""

    def work(counts):
        hz, known = rates(counts[:, skip:, :n_bins])
        hz, known = (x.transpose(0, 2, 1).reshape(-1, n_shifts - skip) for x in (hz, known))
        return n_bins, {"angle_bin": pa.array(np.tile(np.arange(n_bins), len(counts)), pa.int64()), "hz": _lists(hz, known)}

    out = per_unit(cells, unit, n_shifts, n_bins, "angle_bin bigint, hz array<double>", work)
    return out.where(F.exists("hz", lambda x: x.isNotNull()))
