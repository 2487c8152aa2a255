"""Flat files written by many tasks: each writes the bytes of its own frames, the commit publishes the file.

Samples are interleaved int16 without a header. Stamps are doubles behind the
header of an array file, which the commit writes when their number is known.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse
from urllib.request import url2pathname

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "flat_traces"
#: Bytes before the first stamp.
HEADER = 128


def shared_path(uri: str) -> str:
    """The path of a file that tasks write into at their own places; only mounted file systems allow that."""
    found = urlparse(uri)
    if found.scheme in ("", "file"):
        return url2pathname(found.path) if found.scheme else uri
    raise ValueError(f"{uri}: a flat file is written at many places at once, which {found.scheme} does not allow; use a mounted folder")


@dataclass
class Runs(WriterCommitMessage):
    """Spans of frames (start, stop) that one task has written."""

    spans: list[tuple[int, int]]


class FlatWriter(DataSourceArrowWriter):
    """Tasks write into a hidden file beside the target; it gets the target's name when all frames are there."""

    def __init__(self, path: str, channels: int, overwrite: bool, stamps: bool = False):
        self.path, self.channels, self.stamps = shared_path(path), channels, stamps
        self.offset, self.width = (HEADER, 8) if stamps else (0, 2 * channels)
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{path} exists; pass overwrite=True to replace it")
        folder, name = os.path.split(os.path.abspath(self.path))
        self.hidden = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        os.makedirs(folder, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Runs:
        spans: list[tuple[int, int]] = []
        file = os.open(self.hidden, os.O_CREAT | os.O_WRONLY, 0o644)
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                frames, values = batch.column("frame"), batch.column("t" if self.stamps else "v")
                if frames.null_count or values.null_count:
                    raise ValueError("a row without a frame or without samples")
                frames = frames.to_numpy()
                if self.stamps:
                    samples = values.to_numpy().astype("<f8", copy=False)
                else:
                    if (values.value_lengths().to_numpy() != self.channels).any() or values.flatten().null_count:
                        raise ValueError(f"a frame without {self.channels} samples")
                    samples = values.flatten().to_numpy().astype("<i2", copy=False).reshape(-1, self.channels)
                breaks = [0, *(np.flatnonzero(np.diff(frames) != 1) + 1).tolist(), len(frames)]
                for a, b in zip(breaks, breaks[1:]):
                    first = int(frames[a])
                    data, at = memoryview(np.ascontiguousarray(samples[a:b])).cast("B"), self.offset + first * self.width
                    while len(data):
                        done = os.pwrite(file, data, at)
                        data, at = data[done:], at + done
                    if spans and spans[-1][1] == first:
                        spans[-1] = (spans[-1][0], first + b - a)
                    else:
                        spans.append((first, first + b - a))
            os.fsync(file)
        finally:
            os.close(file)
        return Runs(spans)

    def commit(self, messages) -> None:
        end = 0
        for start, stop in sorted(s for m in messages if m is not None for s in m.spans):
            if start != end:
                self.abort(messages)
                raise ValueError(f"frame {end} is missing" if start > end else f"frame {start} was written twice")
            end = stop
        if not end:
            open(self.hidden, "wb").close()
        if self.stamps:
            text = f"{{'descr': '<f8', 'fortran_order': False, 'shape': ({end},), }}"
            head = b"\x93NUMPY\x01\x00" + (HEADER - 10).to_bytes(2, "little") + text.encode().ljust(HEADER - 11) + b"\n"
            file = os.open(self.hidden, os.O_WRONLY)
            try:
                os.pwrite(file, head, 0)
            finally:
                os.close(file)
        os.replace(self.hidden, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


class FlatTarget(DataSource):
    """``df.write.format("flat_traces")`` with options path and channels, or stamps."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "frame bigint, v array<smallint>"

    def writer(self, schema, overwrite):
        return FlatWriter(self.options["path"], int(self.options.get("channels", 1)), overwrite, "stamps" in self.options)


def to_int16(traces: str) -> Column:
    """Samples as whole numbers of 16 bits: halves to even, what lies outside at the ends."""
    return F.transform(traces, lambda x: F.rint(F.least(F.greatest(x.cast("double"), F.lit(-32768.0)), F.lit(32767.0))).cast("smallint"))


def write_traces(samples: DataFrame, path: str, channels: int, frame: str = "frame", traces: str = "v", overwrite: bool = False) -> None:
    """Frames 0 to n-1 of `samples`, each once, as a flat file of interleaved int16.

    Frames are cut into ranges, so each task writes one stretch of the file. A
    missing or repeated frame fails the job and leaves no file; a task that runs
    twice writes the same bytes again.
    """
    samples.sparkSession.dataSource.register(FlatTarget)
    rows = samples.select(F.col(frame).cast("bigint").alias("frame"), to_int16(traces).alias("v"))
    rows = rows.repartitionByRange("frame").sortWithinPartitions("frame")
    rows.write.format(FORMAT).option("path", path).option("channels", channels).mode("overwrite" if overwrite else "append").save()


def write_stamps(stamps: DataFrame, path: str, frame: str = "frame", time: str = "t", overwrite: bool = False) -> None:
    """Stamps of frames 0 to n-1 as an array file of doubles, as `write_traces` writes samples."""
    stamps.sparkSession.dataSource.register(FlatTarget)
    rows = stamps.select(F.col(frame).cast("bigint").alias("frame"), F.col(time).cast("double").alias("t"))
    rows = rows.repartitionByRange("frame").sortWithinPartitions("frame")
    rows.write.format(FORMAT).option("path", path).option("stamps", "true").mode("overwrite" if overwrite else "append").save()
