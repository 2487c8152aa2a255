"""Classes of near-duplicates against all pairs, and components against union-find."""

import random

import pytest

from ringtide.llm import neardup
from ringtide.llm.components import components


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def join(parent, a, b):
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def brute(rows):
    sets = [(doc, shingles(text)) for doc, text in rows if doc is not None]
    parent = {doc: doc for doc, _ in sets}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                join(parent, a, b)
    return {doc: find(parent, doc) for doc in parent}


def families(seed):
    draw, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(40)]
    for size in (1, 2, 3, 30, 90):
        base = [f"b{draw.randint(0, 3000)}" for _ in range(draw.choice([60, 120, 300]))]
        for _ in range(size):
            words = list(base)
            for _ in range(draw.randint(0, 5)):
                words[draw.randrange(len(words))] = f"c{draw.randint(0, 9999)}"
            rows.append(" ".join(words))
    for _ in range(60):  # a shared passage alone makes no link
        rows.append(" ".join(passage + [f"d{draw.randint(0, 99999)}" for _ in range(40)]))
    rows += [rows[3]] * 40 + ["few words", "Few  WORDS", "few", None, "", " \n", "É é", "é é"]
    draw.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("small", "depths"), [(32, (3, 6, 12)), (2, (3, 5))])
def test_classes_equal_all_pairs(spark, monkeypatch, small, depths):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "DEPTHS", depths)
    rows = families(small)
    want = brute(rows)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    sets = {doc: len(shingles(text)) for doc, text in rows}
    for r in found:
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sets[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())


@pytest.mark.parametrize("block", [512, 30])
def test_pairs_inside_a_dense_family(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
    passage, rows = [f"p{i}" for i in range(144)], []
    for i in range(200):  # 140 of 200 shingles are common: 0.70; the twins 2k and 2k + 1 below 24 share 7 more: 0.76
        tail = [f"d{i}x{j}" for j in range(30)]
        if i < 24:
            tail[:7] = [f"t{i // 2}x{j}" for j in range(7)]
        rows.append((i, " ".join(passage + tail)))
    random.Random(2).shuffle(rows)
    want = brute(rows)
    assert want == {i: i // 2 * 2 if i < 24 else i for i in range(200)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == want


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    rows = families(9)[:150]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == brute(rows)


def test_null_and_repeated_ids(spark):
    same = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, same), (7, same), (7, same), (9, same), (3, None), (3, None)], "doc_id long, text string")
    rows = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=str)
    assert rows == sorted([(None, 26, None, None), (7, 26, 7, True), (7, 26, 7, True), (9, 26, 7, False), (3, 0, 3, True), (3, 0, 3, True)], key=str)
    assert sorted(str(r.doc_id) for r in neardup.keep_first(docs).collect()) == ["3", "3", "7", "7", "None"]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(50)] + [(draw.randint(300, 360), draw.randint(300, 360)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        join(parent, a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    assert {r.node: r.comp for r in components(df).collect()} == {x: find(parent, x) for x in linked}
    assert components(df.limit(0)).count() == 0
