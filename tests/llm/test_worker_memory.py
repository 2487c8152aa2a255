"""What a Python worker holds between operators and of a batch."""

import gc
import weakref

import pyarrow as pa

from ringtide.llm import common


class Held:
    """Something that names itself, as tables with bound functions do."""

    def __init__(self):
        self.own = self


def test_what_others_held_is_gone_when_the_next_begins():
    kept = {"x": Held()}
    seen = weakref.ref(kept["x"])
    gc.disable()
    try:
        common.holds("one", kept.clear)
        assert seen() is not None
        common.holds("two", dict)
        assert seen() is None  # not when the collector happens to run
    finally:
        gc.enable()


def test_a_task_gives_back_when_it_ends():
    seen = []

    def task(batches):
        held = Held()
        seen.append(weakref.ref(held))
        yield from batches

    gc.disable()
    try:
        batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
        assert list(common.frugal(task)(iter([batch, batch]))) == [batch, batch]
        assert seen[0]() is None
    finally:
        gc.enable()


def test_rows_reach_the_work_in_slices(spark):
    docs = spark.range(1000).coalesce(1)
    found = common.arrow_task(docs, "id long, n int", lambda b: {"id": b.column(0), "n": pa.array([b.num_rows] * b.num_rows, pa.int32())}, sliced=True).collect()
    assert [r.id for r in found] == list(range(1000)) and max(r.n for r in found) <= common.SLICE
    assert common.arrow_task(docs.limit(0), "id long", lambda b: {"id": b.column(0)}, sliced=True).collect() == []
