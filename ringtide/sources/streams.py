"""Streams of a recording folder: layout and gains from the sidecar, samples by byte ranges.

A folder is named by a path or URI that every executor can open. The driver reads
only the small sidecar of a stream; tasks read the bytes of their own frames, and
comparisons on ``frame`` or a list of frame ranges narrow what is read.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .binary import narrowed
from .catalog import only_stream

FORMAT = "recording_stream"
FRAMES_PER_PARTITION, FRAMES_PER_BATCH = 1 << 20, 1 << 14


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a path or URI."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def file_size(uri: str) -> int | None:
    """Bytes of a file; None where there is none."""
    system, path = opened(uri)
    info = system.get_file_info(path)
    return info.size if info.type == pafs.FileType.File else None


def small_file(uri: str) -> str:
    """The text of a sidecar."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        return f.read().decode("utf-8")


def files_below(uri: str) -> list[str]:
    """All files of a folder, as URIs of the same form, sorted."""
    system, path = opened(uri)
    head = uri[:len(uri) - len(path)] if uri.endswith(path) else ""
    found = system.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted(head + i.path for i in found if i.type == pafs.FileType.File)


@dataclass(frozen=True)
class Stream:
    """What a sidecar says about one stream. `gains` and `offsets` make microvolts of samples; `times` names a stamp file."""

    name: str
    binary: str
    fs: float
    channels: list[str]
    gains: list[float | None]
    offsets: list[float]
    positions: list[tuple[float, float] | None] = field(default_factory=list)
    times: str | None = None

    def frames(self) -> int:
        """Frames of the file, which must hold whole ones."""
        size, width = file_size(self.binary), 2 * len(self.channels)
        if size is None:
            raise FileNotFoundError(self.binary)
        if size % width:
            raise ValueError(f"{self.binary}: {size} bytes do not hold whole frames of {len(self.channels)} channels")
        return size // width


def _parenthesised(text: str) -> list[str]:
    return re.findall(r"\(([^()]*)\)", text)


def from_meta(uri: str) -> Stream:
    """The stream of a ``.meta`` sidecar, whose binary lies beside it."""
    values = dict(line.split("=", 1) for line in small_file(uri).splitlines() if "=" in line)
    values = {k.lstrip("~").strip(): v.strip() for k, v in values.items()}
    kind = values.get("typeThis", "imec")
    head = "ni" if kind == "nidq" else "im"
    n = int(values["nSavedChans"])
    names = [entry.split(";")[0] for entry in _parenthesised(values.get("snsChanMap", ""))[1:]]
    if len(names) != n:
        names = [f"CH{i}" for i in range(n)]
    top = float(values.get(f"{head}AiRangeMax", 0) or 0)
    steps = int(values.get(f"{head}MaxInt", 32768 if head == "ni" else 512))
    low_band = uri.endswith(".lf.meta")
    entries = [e.split() for e in _parenthesised(values.get("imroTbl", ""))[1:]]
    gains: list[float | None] = []
    for i, name in enumerate(names):
        if head == "ni":
            kind_of = {"MN": "niMNGain", "MA": "niMAGain"}.get(name[:2])
            divide = float(values.get(kind_of, 1)) if kind_of else 1.0
        elif name.startswith(("AP", "LF")) and i < len(entries) and len(entries[i]) >= 5:
            divide = float(entries[i][4 if low_band else 3])
        elif name.startswith("SY"):
            divide = 0.0
        else:
            divide = float(values.get("imChan0lfGain" if low_band else "imChan0apGain", 80.0))
        gains.append(1e6 * top / steps / divide if top and divide else None)
    places: list[tuple[float, float] | None] = [None] * n
    geometry = _parenthesised(values.get("snsGeomMap", ""))[1:]
    for i, entry in enumerate(geometry[:n]):
        parts = [float(x) for x in entry.split(":")]
        if len(parts) != 4:
            raise ValueError(f"{uri}: a site with {len(parts) - 2} coordinates; two are supported")
        places[i] = (parts[1], parts[2])
    binary = uri[:-len(".meta")] + ".bin"
    return Stream(re.sub(r".*[_/](?:t\d+\.)?", "", uri[:-len(".meta")]) or uri, binary, float(values[f"{head}SampRate"]), names, gains, [0.0] * n, places)


def from_structure(uri: str) -> list[Stream]:
    """The continuous streams of a ``structure.oebin`` file, with their stamp files where these exist."""
    folder, out = uri.rsplit("/", 1)[0], []
    for s in json.loads(small_file(uri)).get("continuous", []):
        place = f"{folder}/continuous/{s['folder_name'].strip('/')}"
        rows = s["channels"]
        positions = [tuple(c["position"]) if c.get("position") is not None else None for c in rows]
        if any(p is not None and len(p) != 2 for p in positions):
            raise ValueError(f"{uri}: sites with other than two coordinates")
        stamps = f"{place}/timestamps.npy"
        out.append(Stream(s["folder_name"].strip("/"), f"{place}/continuous.dat", float(s["sample_rate"]), [c["channel_name"] for c in rows],
                          [float(c["bit_volts"]) if c.get("bit_volts") is not None else None for c in rows], [0.0] * len(rows), positions,
                          stamps if file_size(stamps) is not None else None))
    return out


def streams_of(folder: str) -> tuple[str, list[Stream]]:
    """Layout ("meta" or "structured") and all streams of a folder."""
    files = files_below(folder)
    metas = [f for f in files if f.endswith(".meta")]
    if metas:
        return "meta", [from_meta(f) for f in metas]
    structures = [f for f in files if f.endswith("/structure.oebin")]
    if structures:
        return "structured", [s for f in structures for s in from_structure(f)]
    raise ValueError(f"{folder}: no recording layout recognised")


def find_stream(folder: str, name: str | None = None, band: str = "ap") -> Stream | None:
    """One stream by name, or the one of a band; None where a side band is absent."""
    layout, found = streams_of(folder)
    chosen = name if name is not None else only_stream([s.name for s in found], layout, band)
    if chosen is None:
        return None
    same = [s for s in found if s.name == chosen]
    if len(same) != 1:
        raise ValueError(f"{folder}: {len(same)} streams are named {chosen!r}; there are {[s.name for s in found]}")
    return same[0]


class Piece(InputPartition):
    """Frames ``start <= frame < stop`` of one file, whose first frame has the number `base`."""

    def __init__(self, file: int, start: int, stop: int, base: int):
        super().__init__((file, start, stop, base))
        self.file, self.start, self.stop, self.base = file, start, stop, base


def pieces(file: int, spans: list[tuple[int, int]], per_partition: int, base: int = 0) -> list[Piece]:
    return [Piece(file, a, min(a + per_partition, stop), base) for start, stop in spans for a in range(start, stop, per_partition)]


def cut(spans: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """The parts of `spans` inside ``low <= frame < high``."""
    return [(max(a, low), min(b, high)) for a, b in spans if max(a, low) < min(b, high)]


class NpyFile:
    """One-dimensional array file read by ranges: its header first, then the bytes asked for."""

    KINDS = {"f8": np.float64, "f4": np.float32, "i8": np.int64, "i4": np.int32, "u4": np.uint32, "u8": np.uint64}

    def __init__(self, uri: str):
        self.uri = uri
        system, path = opened(uri)
        with system.open_input_file(path) as f:
            start = f.read_at(12, 0)
            if start[:6] != b"\x93NUMPY":
                raise ValueError(f"{uri} is no array file")
            wide = start[6] >= 2
            size = int.from_bytes(start[8:12] if wide else start[8:10], "little")
            first = 12 if wide else 10
            header = ast.literal_eval(f.read_at(size, first).decode("latin1"))
            whole = f.size()
        if header["fortran_order"] and len(header["shape"]) > 1 or len(header["shape"]) != 1 or header["descr"][1:] not in self.KINDS or header["descr"][0] not in "<|":
            raise ValueError(f"{uri}: {header} is no vector of little-endian numbers")
        self.kind, self.length, self.offset = np.dtype(header["descr"]), int(header["shape"][0]), first + size
        if whole < self.offset + self.length * self.kind.itemsize:
            raise ValueError(f"{uri} ends before its {self.length} values do")

    def read(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` to ``stop``."""
        system, path = opened(self.uri)
        with system.open_input_file(path) as f:
            return np.frombuffer(f.read_at((stop - start) * self.kind.itemsize, self.offset + start * self.kind.itemsize), self.kind)


class StreamReader(DataSourceReader):
    """Frames of one stream; the ranges asked for are cut into partitions before anything is read."""

    def __init__(self, options: dict):
        self.stream = Stream(**json.loads(options["stream"]))
        self.per_partition = int(options.get("framesPerPartition", FRAMES_PER_PARTITION))
        self.per_batch = int(options.get("framesPerBatch", FRAMES_PER_BATCH))
        total = self.stream.frames()
        self.spans = cut([tuple(s) for s in json.loads(options.get("ranges", "null")) or [(0, total)]], 0, total)
        self.low, self.high = 0, total
        if self.stream.times is not None:
            length = NpyFile(self.stream.times).length
            if length != total:
                raise ValueError(f"{self.stream.times} has {length} stamps for {total} frames")

    def pushFilters(self, filters):
        for f in filters:
            self.low, self.high = narrowed(f, self.low, self.high)
            yield f  # the rows are checked again after the scan

    def partitions(self):
        return pieces(0, cut(self.spans, self.low, self.high), self.per_partition) or [Piece(0, 0, 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.stop <= piece.start:
            return
        width = len(self.stream.channels)
        times = NpyFile(self.stream.times) if self.stream.times is not None else None
        system, path = opened(self.stream.binary)
        with system.open_input_file(path) as f:
            for a in range(piece.start, piece.stop, self.per_batch):
                b = min(a + self.per_batch, piece.stop)
                samples = np.frombuffer(f.read_at((b - a) * width * 2, a * width * 2), "<i2")
                frames = np.arange(a, b, dtype=np.int64)
                t = times.read(a, b).astype(np.float64) if times is not None else frames / self.stream.fs
                offsets = pa.array(np.arange(0, (b - a) * width + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(frames), pa.array(t), pa.ListArray.from_arrays(offsets, pa.array(samples))], names=["frame", "t", "v"])


class StreamSource(DataSource):
    """``spark.read.format("recording_stream")``; the options are made by `open_stream`."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "frame bigint, t double, v array<smallint>"

    def reader(self, schema):
        return StreamReader(self.options)


class StampReader(DataSourceReader):
    """Values of array files, one behind the other."""

    def __init__(self, options: dict):
        self.files = [NpyFile(u) for u in json.loads(options["files"])]
        self.per_partition = int(options.get("framesPerPartition", FRAMES_PER_PARTITION))

    def partitions(self):
        return [p for i, f in enumerate(self.files) for p in pieces(i, [(0, f.length)], self.per_partition)] or [Piece(0, 0, 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        for a in range(piece.start, piece.stop, FRAMES_PER_BATCH):
            b = min(a + FRAMES_PER_BATCH, piece.stop)
            values = self.files[piece.file].read(a, b).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, piece.file, np.int32)), pa.array(np.arange(a, b, dtype=np.int64)), pa.array(values)], names=["file", "frame", "t"])


class StampSource(DataSource):
    """``spark.read.format("npy_stamps")``: file (its place in the list), frame, t."""

    @classmethod
    def name(cls):
        return "npy_stamps"

    def schema(self):
        return "file int, frame bigint, t double"

    def reader(self, schema):
        return StampReader(self.options)


def open_stream(spark: SparkSession, stream: Stream, clock: str = "sync", ranges: list[tuple[int, int]] | None = None,
                frames_per_partition: int = FRAMES_PER_PARTITION) -> DataFrame:
    """A stream as ``samples(frame, t, v)``, or only the frames of `ranges`.

    ``clock="sync"`` takes the stamps of the acquisition where the layout has
    them, else (or with ``"uniform"``) frame / rate. Stamps whose number differs
    from that of the frames are refused.
    """
    if clock not in ("sync", "uniform"):
        raise ValueError(f"no clock {clock!r}")
    kept = asdict(stream) | ({"times": None} if clock == "uniform" else {})
    spark.dataSource.register(StreamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(FORMAT).option("stream", json.dumps(kept)).option("framesPerPartition", frames_per_partition)
    return (reader if ranges is None else reader.option("ranges", json.dumps([list(map(int, r)) for r in ranges]))).load()


def channel_table(spark: SparkSession, stream: Stream) -> DataFrame:
    """``slot, channel_id, x, y, gain, offset`` of a stream; null where the sidecar does not say."""
    rows = [(i, c, *(stream.positions[i] if i < len(stream.positions) and stream.positions[i] is not None else (None, None)), stream.gains[i], stream.offsets[i])
            for i, c in enumerate(stream.channels)]
    return spark.createDataFrame([(i, c, None if x is None else float(x), None if y is None else float(y), g, o) for i, c, x, y, g, o in rows],
                                 "slot int, channel_id string, x double, y double, gain double, offset double")


def microvolts(stream: Stream, traces: str = "v") -> Column:
    """The samples of a row in microvolts; null for channels without a gain."""
    scale = F.array(*[F.struct(F.lit(g).cast("double").alias("g"), F.lit(float(o)).alias("o")) for g, o in zip(stream.gains, stream.offsets, strict=True)])
    return F.zip_with(F.col(traces), scale, lambda x, s: x.cast("double") * s["g"] + s["o"])


def stream_timestamps(spark: SparkSession, stream: Stream) -> DataFrame | None:
    """``frame, t`` for every stamp of a stream; None where it has no stamp file."""
    return None if stream.times is None else _stamps(spark, [stream.times]).select("frame", "t")


def _stamps(spark: SparkSession, files: list[str]) -> DataFrame:
    spark.dataSource.register(StampSource)
    return spark.read.format("npy_stamps").option("files", json.dumps(files)).load()


def concatenated_sync_times(spark: SparkSession, streams: list[Stream], num_samples: list[int]) -> DataFrame | None:
    """``frame, t`` over recordings put end to end.

    None where a recording has no stamps or another number of them than was
    recorded for it: later samples would be mistimed. Only headers are read to
    find out; the stamps stay in tasks, which add each recording's offset from a
    table of one row per recording.
    """
    if len(streams) != len(num_samples) or not streams:
        return None
    if any(s.times is None for s in streams) or any(NpyFile(s.times).length != n for s, n in zip(streams, num_samples, strict=True)):
        return None
    offsets = [(i, sum(num_samples[:i])) for i in range(len(streams))]
    table = spark.createDataFrame(offsets, "file int, first bigint")
    return _stamps(spark, [s.times for s in streams]).join(F.broadcast(table), "file").select((F.col("frame") + F.col("first")).alias("frame"), "t")
