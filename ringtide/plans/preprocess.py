"""Recordings put end to end: filtered, written as one flat file with what is known about it, and opened again."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import apply_preprocessing, steps_of
from ..sources.flat_writer import shared_path, write_traces
from ..sources.streams import Stream, concatenated_sync_times, open_stream

BINARY, INFO = "traces.bin", "concat_info.json"
#: Lines that carry a clock, not a site: names begin with these in the layouts that have them.
SYNC_PREFIXES = ("SY", "SYNC")


@dataclass(frozen=True)
class Concatenated:
    """What `preprocess` has written: the streams, their frames, and the channels of the file."""

    fs: float
    num_samples: list[int]
    streams: list[dict]
    channels: list[str]
    gains: list[float | None]
    offsets: list[float]
    positions: list
    bad: list[str]
    removed_sync: list[str]
    steps: dict

    def stream(self, folder: str) -> Stream:
        """The flat file as a stream; gains, offsets and sites are those of the first recording."""
        places = [tuple(p) if p is not None else None for p in self.positions]
        return Stream("concatenated", f"{folder}/{BINARY}", self.fs, self.channels, self.gains, self.offsets, places)


def _shared(streams: list[Stream], tolerance: float) -> list[list[int]]:
    """For each stream the slots that hold the first stream's sites, in its order; sync lines are left out."""
    def sites(s: Stream):
        return [i for i, c in enumerate(s.channels) if not c.upper().startswith(SYNC_PREFIXES)]

    first = sites(streams[0])
    places = streams[0].positions
    located = places and all(i < len(places) and places[i] is not None for i in first)
    columns = []
    for s in streams:
        here = []
        for i in first:
            if located and s.positions:
                near = [(((s.positions[j][0] - places[i][0]) ** 2 + (s.positions[j][1] - places[i][1]) ** 2) ** 0.5, j)
                        for j in sites(s) if j < len(s.positions) and s.positions[j] is not None]
                best = min(near, default=(float("inf"), -1))
                here.append(best[1] if best[0] <= tolerance else -1)
            else:
                here.append(s.channels.index(streams[0].channels[i]) if streams[0].channels[i] in s.channels else -1)
        columns.append(here)
    kept = [n for n in range(len(first)) if all(c[n] >= 0 for c in columns)]
    if not kept:
        raise ValueError("the recordings share no site")
    for s, c in zip(streams, columns, strict=True):
        if len({c[n] for n in kept}) != len(kept):
            raise ValueError(f"{s.name}: two sites fall on one channel")
    return [[c[n] for n in kept] for c in columns]


def preprocess(spark: SparkSession, streams: list[Stream], folder: str, steps: dict | None = None, bad: list[str] = (), tolerance: float = 1.0,
               rate_tolerance: float = 0.0, overwrite: bool = False) -> Concatenated:
    """Write `streams` end to end into one flat file, with its information beside it.

    Sync lines are dropped and channels are aligned by site, or by name where
    the sidecars have no sites. `steps` run over the channels not in `bad`,
    inside each recording: nothing leaks across a junction. Rates that differ by
    more than `rate_tolerance`, and gains that differ, are refused.
    """
    if not streams:
        raise ValueError("there is nothing to write")
    if any(abs(s.fs - streams[0].fs) > rate_tolerance for s in streams):
        raise ValueError(f"sampling rates differ: {[s.fs for s in streams]}")
    slots = _shared(streams, tolerance)
    names = [streams[0].channels[i] for i in slots[0]]
    gains = [streams[0].gains[i] for i in slots[0]]
    for s, here in zip(streams[1:], slots[1:], strict=True):
        other = [s.gains[i] for i in here]
        if any((a is None) != (b is None) or (a is not None and abs(a - b) > 1e-8 + 1e-5 * abs(a)) for a, b in zip(gains, other, strict=True)):
            raise ValueError(f"{s.name}: gains differ from those of {streams[0].name}")
    unknown = sorted(set(bad) - set(names))
    if unknown:
        raise ValueError(f"no channels {unknown} among {names}")
    good = [i for i, c in enumerate(names) if c not in set(bad)]
    lengths = [s.frames() for s in streams]
    parts = None
    for n, (s, here) in enumerate(zip(streams, slots, strict=True)):
        picked = open_stream(spark, s, "uniform").select(F.lit(n).alias("recording"), "frame", F.array(*[F.col("v")[i] for i in here]).alias("v"))
        parts = picked if parts is None else parts.unionByName(picked)
    if steps:
        parts = apply_preprocessing(parts, ["recording"], "frame", "v", steps_of(steps, streams[0].fs, good), good)
    offset = F.element_at(F.array(*[F.lit(sum(lengths[:n])).cast("bigint") for n in range(len(streams))]), F.col("recording") + 1)
    write_traces(parts.withColumn("frame", F.col("frame") + offset), f"{folder}/{BINARY}", len(names), overwrite=overwrite)
    positions = [streams[0].positions[i] if i < len(streams[0].positions) else None for i in slots[0]]
    sync = [c for c in streams[0].channels if c.upper().startswith(SYNC_PREFIXES)]
    made = Concatenated(streams[0].fs, lengths, [asdict(s) for s in streams], names, gains, [streams[0].offsets[i] for i in slots[0]], positions, sorted(bad), sync, steps or {})
    text = json.dumps(asdict(made), indent=2)
    with open(os.path.join(shared_path(folder), INFO), "w", encoding="utf-8") as f:
        f.write(text)
    return Concatenated(**json.loads(text))


def load_concatenated(spark: SparkSession, folder: str) -> tuple[DataFrame, Concatenated]:
    """``frame, t, v`` of a folder that `preprocess` wrote, and what is known about it.

    Stamps of the recordings are put back where every recording has one for each
    frame; otherwise times follow from the rate.
    """
    with open(os.path.join(shared_path(folder), INFO), encoding="utf-8") as f:
        info = Concatenated(**json.load(f))
    stream = info.stream(folder)
    if stream.frames() != sum(info.num_samples):
        raise ValueError(f"{folder}: {stream.frames()} frames in the file, {sum(info.num_samples)} in {INFO}")
    samples = open_stream(spark, stream, "uniform")
    times = concatenated_sync_times(spark, [Stream(**s) for s in info.streams], info.num_samples)
    if times is not None:
        samples = samples.drop("t").join(times, "frame").select("frame", "t", "v")
    return samples, info
