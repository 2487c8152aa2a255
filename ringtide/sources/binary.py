"""Flat interleaved int16 recordings as a Spark data source, split by frame ranges."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition,
                                    LessThan, LessThanOrEqual)

FORMAT = "int16_traces"
SCHEMA = "frame bigint, t double, v array<smallint>"


class FrameRange(InputPartition):
    """Frames ``start <= frame < stop`` of one file."""

    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


def narrowed(condition, low: int, high: int) -> tuple[int, int]:
    """``low <= frame < high`` after a pushed comparison of ``frame``; others change nothing."""
    if getattr(condition, "attribute", None) != ("frame",):
        return low, high
    if isinstance(condition, (GreaterThan, GreaterThanOrEqual)):
        return max(low, int(condition.value) + isinstance(condition, GreaterThan)), high
    if isinstance(condition, (LessThan, LessThanOrEqual)):
        return low, min(high, int(condition.value) + isinstance(condition, LessThanOrEqual))
    return low, high


class TraceReader(DataSourceReader):
    """Reads frame ranges in Arrow batches; comparisons on ``frame`` narrow the ranges."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.channels = int(options["channels"])
        self.fs = float(options.get("fs", 1.0))
        self.per_partition = int(options.get("framesPerPartition", 1 << 20))
        self.per_batch = int(options.get("framesPerBatch", 1 << 14))
        size = os.path.getsize(self.path)
        width = 2 * self.channels
        if size % width:
            raise ValueError(f"{self.path}: {size} bytes do not hold whole frames of {self.channels} channels")
        self.low, self.high = 0, size // width

    def pushFilters(self, filters):
        for f in filters:
            self.low, self.high = narrowed(f, self.low, self.high)
            yield f  # the rows are checked again after the scan

    def partitions(self):
        if self.high <= self.low:
            return [FrameRange(0, 0)]
        return [FrameRange(a, min(a + self.per_partition, self.high))
                for a in range(self.low, self.high, self.per_partition)]

    def read(self, partition):
        if partition.stop <= partition.start:
            return
        samples = np.memmap(self.path, dtype="<i2", mode="r").reshape(-1, self.channels)
        for a in range(partition.start, partition.stop, self.per_batch):
            b = min(a + self.per_batch, partition.stop)
            frames = np.arange(a, b, dtype=np.int64)
            flat = pa.array(np.ascontiguousarray(samples[a:b]).ravel())
            offsets = pa.array(np.arange(0, (b - a) * self.channels + 1, self.channels, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(frames), pa.array(frames / self.fs), pa.ListArray.from_arrays(offsets, flat)], names=["frame", "t", "v"])


class TraceSource(DataSource):
    """``spark.read.format("int16_traces")`` with options path, channels, fs, framesPerPartition."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TraceReader(self.options)


def read_traces(spark: SparkSession, path: str, channels: int, fs: float, frames_per_partition: int = 1 << 20) -> DataFrame:
    """A flat binary as ``samples(frame, t, v)``. The folder must be one every executor can reach."""
    spark.dataSource.register(TraceSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return (spark.read.format(FORMAT).option("path", path).option("channels", channels).option("fs", fs)
            .option("framesPerPartition", frames_per_partition).load())
