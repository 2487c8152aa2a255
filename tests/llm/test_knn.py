"""Top-k against all products."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from ringtide.llm import knn


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 400)
    monkeypatch.setattr(knn, "QUERY_ROWS", 5)
    draw = random.Random(2)
    rows = [(i, [draw.choice([-1.0, -0.3, 0.0, 0.25, 0.7]) for _ in range(3)]) for i in range(900)]  # many ties
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(900, 1300)]
    rows += [(1300, None), (1301, [1.0, None, 2.0]), (1302, [1.0, math.nan, 2.0]), (1303, [math.inf, 0.0, 0.0]), (1304, []), (None, [1.0, 1.0, 1.0]), (1400, [1.0, 2.0]), (1500, [3.0, 1.0]), (100, [0.1, 0.2, 0.3]), (100, [0.1, 0.2, 0.3])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, score int")
    found = {}
    for r in knn.top_k(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for query in {i for i, _ in good if i % 100 == 0 and i != 100}:
        own = [v for i, v in good if i == query][0]
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != query and len(v) == len(own))[:10]
        assert sorted(found.get(query, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)], query
    assert len(found[100]) == 20  # asks with both of its vectors
    assert len(found[1400]) == 1
    assert knn.top_k(df.limit(0), F.lit(True)).count() == 0


def test_large_components():
    a = np.array([[2**40, 1], [2**31, -5]], dtype=np.int64)
    assert knn.products(a, a).tolist() == [[2**80 + 1, 2**71 - 5], [2**71 - 5, 2**62 + 25]]


def test_boxes_bound_their_rows():
    draw = np.random.default_rng(4)
    rows = draw.integers(-50, 50, (2000, 6))
    tree, queries = knn.Tree(rows), draw.integers(-50, 50, (20, 6))
    assert sorted(tree.order.tolist()) == list(range(2000))
    bounds = tree.bounds(queries)
    for node, (start, stop) in enumerate(tree.span):
        assert (bounds[:, node] >= (queries @ rows[tree.order[start:stop]].T).max(axis=1)).all()
