"""Manifests against a direct construction."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ringtide.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, idx int, grp string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    out = []
    for v in (row[0], row[1], row[2], row[3], text):
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*out)


def climb(nodes):
    """The root of `nodes` and for each of them its siblings, level by level."""
    path, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i in range(len(path)):
            first = at[i] // 8 * 8
            path[i].append((nodes[first:at[i]], nodes[at[i] + 1:first + 8]))
            at[i] //= 8
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], path


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    made = {k: climb([x[2] for x in sorted(langs[k], key=lambda x: x[:3])]) for k in order}
    if not order:
        return []
    root, above = climb([made[k][0] for k in order])
    out = []
    for k, up in zip(order, above, strict=True):
        for (_, _, leaf, r), path in zip(sorted(langs[k], key=lambda x: x[:3]), made[k][1], strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            node = leaf_of(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])) if changed else leaf
            for left, right in path + up:
                node = h(*left, node, *right)
            out.append((r[0], leaf, made[k][0], root, h(*[s for a, b in path + up for s in a + b]), node, node == root))
    return out


def sample(n, seed=0):
    draw, rows = random.Random(seed), []
    for i in range(n):
        lang = draw.choice(["en"] * 6 + ["de", "é", "", None, "fr"])
        rows.append((draw.choice([i, i, i, 7, 2**60 + i]), draw.choice(["a", None, "Süß"]), lang, draw.choice([None, 3, -4]), draw.choice([None, "", "Some TEXT", "lower", "ÄB"]), "x", 1, "g"))
    return rows + [rows[0]] * 9 + [(None, None, None, None, None, None, None, None), (3, "s", "only", 1, "Alone", None, None, None)]


@pytest.mark.parametrize(("n", "levels"), [(1, 4), (300, 4), (300, 1), (700, 2)])
def test_equals_direct_construction(spark, monkeypatch, n, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = sample(n, n + levels)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = sorted(map(tuple, merkle.manifest(docs, merkle.third()).collect()), key=str)
    assert found == sorted(brute(rows), key=str)


def test_one_row_no_row_and_long_text(spark):
    one = [(5, None, None, None, "A" * 3_000_000, None, None, None)]
    got = merkle.manifest(spark.createDataFrame(one, SCHEMA), F.lit(True)).collect()
    assert got[0].root == got[0].subroot == got[0].leaf == leaf_of(one[0], one[0][4]) and not got[0].verified
    assert got[0].proof_sha256 == h("") and got[0].folded_root == leaf_of(one[0], one[0][4].lower())
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), merkle.third()).count() == 0


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    rows = [(i, "s", f"l{i % 83}", 1, f"Text {i}", None, None, None) for i in range(200)]
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), merkle.third()).collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows))
