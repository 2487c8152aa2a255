"""Range reads of interleaved traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import estimated_bytes
from .joins import interval_join
from .scan import number_rows


def time_range_to_frames(samples: DataFrame, keys: list[str], time: str, frame: str, t0, t1) -> DataFrame:
    """Frame span of the samples with ``t0 <= time < t1``; the filter reaches the file scan."""
    kept = samples.where((F.col(time) >= F.lit(t0).cast(samples.schema[time].dataType))
                         & (F.col(time) < F.lit(t1).cast(samples.schema[time].dataType)))
    return kept.groupBy(*keys).agg(
        F.min(frame).alias("first_frame"), (F.max(frame) + 1).alias("stop_frame"), F.count("*").cast("bigint").alias("n_frames"))


def get_traces(samples: DataFrame, frame: str, start: int, stop: int, channels: dict[str, int],
               traces: str = "v", gain: float = 1.0, offset: float = 0.0, max_gb: float | None = None) -> DataFrame:
    """Selected channels of a frame range, scaled on request; refused beyond `max_gb`."""
    kept = samples.where((F.col(frame) >= start) & (F.col(frame) < stop))
    columns = [(F.col(traces)[slot].cast("double") * gain + offset).alias(name) for name, slot in channels.items()]
    if max_gb is not None and estimated_bytes(kept) > max_gb * 1e9:
        raise ValueError(f"the range may exceed max_gb={max_gb}; narrow it or raise the limit")
    return kept.select(frame, *columns)


def mean_trace(samples: DataFrame, traces: str) -> DataFrame:
    """Mean over channels per sample."""
    total = F.aggregate(traces, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return samples.withColumn("mean", total / F.size(traces))


def around_events(samples: DataFrame, events: DataFrame, by: list[str], frame: str, at: str, reach: int) -> DataFrame:
    """Samples within `reach` frames of an event, with their lag from it."""
    spans = events.withColumns({"__lo": F.col(at) - reach, "__hi": F.col(at) + reach + 1})
    out = interval_join(samples, spans, by, frame, "__lo", "__hi", 2 * reach + 1)
    return out.withColumn("lag", F.col(frame) - F.col(at)).drop("__lo", "__hi")


def slice_to_spans(rows: DataFrame, spans: DataFrame, by: list[str], time: str, order: list[str], min_duration,
                   width: float) -> DataFrame:
    """Rows inside spans of at least `min_duration`, renumbered without the gaps."""
    long = spans.where(F.col("stop") - F.col("start") >= min_duration).select(*by, "start", "stop")
    kept = interval_join(rows, long, by, time, "start", "stop", width, "left_semi")
    return number_rows(kept, by, order, "new_frame")
