"""Hard negatives against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringtide.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, dim int, shard int, v string"


def brute(rows, k=5, least=80, percent=100):
    kept = {}
    for vec, v, label, *_ in rows:
        if vec is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * x) for x in v])
        kept[vec] = min(kept.get(vec, row), row)
    out = []
    for a, (label, v) in kept.items():
        if a % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, (m, w) in kept.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            inside = [(n, i) for n, i, m in scored if m != label and least * -s <= 100 * -n <= percent * -s][:k]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(inside)]
    return sorted(out)


def sample(kind, n, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, 8))
    rows = []
    for i in range(n):
        label = int(draw.integers(0, 6)) if draw.random() < 0.6 else 2
        v = centres[label] * (kind == "clustered") + draw.normal(size=8) * 0.3
        rows.append((i, [float(x) for x in v], label, 1, 2, "x"))
    rows += [(n + i, rows[5][1], i % 3, 0, 0, "") for i in range(40)]  # ties
    rows += [rows[10]] * 5 + [(20, [0.1] * 8, 0, 0, 0, ""), (None, [1.0] * 8, 1, 0, 0, ""), (n + 50, None, 1, 0, 0, ""), (n + 60, [], 1, 0, 0, ""), (n + 70, [1.0] * 7 + [None], 1, 0, 0, ""),
             (n + 80, [1.0] * 7 + [math.inf], 1, 0, 0, ""), (n + 90, [1.0] * 8, None, 0, 0, ""), (1000 * n, [0.5, 0.5], 1, 0, 0, ""), (1000 * n + 1, [0.5, 0.6], 1, 0, 0, ""), (1000 * n + 2, [0.5, 0.5], 2, 0, 0, ""),
             (2000 * n, [0.0] * 8, 2, 0, 0, "")]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize(("kind", "shard", "leaf", "fan"), [("plain", 8192, 64, 64), ("clustered", 60, 4, 5), ("plain", 100, 3, 4)])
def test_equals_all_products(spark, monkeypatch, kind, shard, leaf, fan):
    for name, value in (("SHARD_ROWS", shard), ("LEAF_ROWS", leaf), ("FAN", fan)):
        monkeypatch.setattr(negatives, name, value)
    rows = sample(kind, 400, shard + leaf)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = negatives.hard_negatives(docs, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_bounds_hold_and_skip(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF_ROWS", 8)
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 6)) * 300
    rows = np.floor(centres[draw.integers(0, 40, 2000)] + draw.normal(size=(2000, 6)) * 9).astype(np.int64)
    labels = draw.integers(0, 3, 2000)
    tree = negatives.Cover(rows, labels)
    assert sorted(tree.order.tolist()) == list(range(2000))

    def members(node):
        n = tree.nodes[node]
        return list(tree.order[slice(*n["span"])]) if n["span"] else [m for c in n["children"] for m in members(c)]

    for node, n in enumerate(tree.nodes):  # covering, nesting, separation
        chord = np.sqrt(((tree.points[members(node)] - tree.points[n["centre"]])**2).sum(axis=1))
        assert chord.max() <= n["radius"] + 1e-12
        if n["children"]:
            kids = [tree.nodes[c] for c in n["children"]]
            assert kids[0]["centre"] == n["centre"]
            points = tree.points[[k["centre"] for k in kids]]
            apart = np.sqrt(((points[:, None] - points[None])**2).sum(axis=2))[~np.eye(len(kids), dtype=bool)]
            assert apart.min() >= max(k["radius"] for k in kids) - 1e-9
    import pyarrow as pa
    table = pa.table({"id": np.arange(2000), "label": labels, "dim": pa.array([6] * 2000, pa.int32()), "v": pa.array(rows.tolist(), pa.list_(pa.int64()))})
    packed = negatives.tree_row(table)
    search = negatives.Searcher(packed, 6)
    anchors = rows[:50]
    low, high = search.bounds(anchors)
    scores = anchors @ rows.T
    for node in range(len(tree.nodes)):
        s = scores[:, members(node)]
        assert (s <= high[:, node:node + 1]).all() and (s >= low[:, node:node + 1]).all()
    scored = []
    plain = negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, b: scored.append(len(a) * len(b)) or plain(a, b))
    best, _ = search.search(np.arange(50), anchors, labels[:50], True, np.full((50, 1), negatives.NONE + 1), np.full((50, 1), negatives.ANY), 5)
    want = np.sort(np.where((labels[None] == labels[:50, None]) & (np.arange(2000)[None] != np.arange(50)[:, None]), scores, negatives.NONE), axis=1)[:, :-6:-1]
    assert (best[:, 0] == want).all() and sum(scored) < 0.2 * 50 * 2000


def test_one_label_and_no_rows(spark):
    docs = spark.createDataFrame([(i, [float(i), 1.0], 1, 0, 0, "") for i in range(30)], SCHEMA)
    assert negatives.hard_negatives(docs, F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(docs.limit(0), F.col("vec_id") % 10 == 0).count() == 0
