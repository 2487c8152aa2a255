"""Resharding, mixing and licenses."""

import itertools
import math
import random
import zlib
from fractions import Fraction
from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringtide.llm import licenses, mixing, reshard
from ringtide.llm.common import shared_folder


def test_transfers_move_the_fewest_bytes():
    draw = random.Random(6)
    for _ in range(60):
        sizes = [draw.randint(0, 5) for _ in range(3)]
        capacities = [draw.randint(0, 6) for _ in range(3)]
        if sum(sizes) > sum(capacities):
            with pytest.raises(ValueError):
                reshard.cheapest_transfers(sizes, capacities)
            continue
        price = {(i, j): draw.randint(0, 3) for i in range(3) for j in range(3)}
        flow = reshard.cheapest_transfers(sizes, capacities, lambda i, j: price[i, j])
        assert all(sum(f for (a, _), f in flow.items() if a == i) == s for i, s in enumerate(sizes))
        assert all(sum(f for (_, b), f in flow.items() if b == j) <= c for j, c in enumerate(capacities))
        ways = [[x for x in itertools.product(range(s + 1), repeat=3) if sum(x) == s] for s in sizes]
        least = min(sum(price[i, j] * x[j] for i, x in enumerate(way) for j in range(3)) for way in itertools.product(*ways)
                    if all(sum(x[j] for x in way) <= capacities[j] for j in range(3)))
        assert sum(price[k] * f for k, f in flow.items()) == least


def test_places(spark):
    rows = [(i, "x" * (i % 50)) for i in range(1000)] + [(i, "hot text") for i in range(1000, 1500)] + [(None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, slot int").repartition(6)
    found = reshard.shard_digest(docs).collect()
    assert len(found) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == want
    sizes = [sum(r.size for r in found if r.shard == s) for s in range(24)]
    assert max(sizes) - min(sizes) <= 6 * 60  # a document at each cut
    for s in range(24):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    assert {r.grown_shard for r in found} == {None}
    assert reshard.shard_digest(docs.limit(0)).count() == 0


def test_rewrite_only_what_changes(spark):
    docs = spark.createDataFrame([(i, "t" * 20, i % 2) for i in range(100)] + [(100 + i, "u" * 20, 2) for i in range(50)], "doc_id long, text string, lies int")
    folder = shared_folder(spark, "test-shards")
    state = {r.shard: r for r in reshard.rewrite_affected(docs, folder, 3, F.col("lies"), 3).collect()}
    assert [state[s].rows for s in range(3)] == [50, 50, 50] and not any(r.rewritten for r in state.values())
    folder = shared_folder(spark, "test-shards")
    state = {r.shard: r for r in reshard.rewrite_affected(docs, folder, 4, F.col("lies"), 3).collect()}
    assert all(r.rewritten for r in state.values())
    back = spark.read.parquet(folder)
    assert sorted(r.doc_id for r in back.collect()) == list(range(150)) and back.groupBy("shard").count().count() == 4


def flow_of(blocks, weights, slots):
    """Blocks of every source that the flow has passed after each slot, by stepping from one leaving source to the next."""
    left, done, out = dict(blocks), dict.fromkeys(blocks, Fraction(0)), []
    for _ in range(slots):
        room = Fraction(1)
        while room > 0:
            active = [s for s in blocks if done[s] < left[s]]
            total = sum(weights[s] for s in active)
            step = min([room / total, *[(left[s] - done[s]) / weights[s] for s in active]])
            for s in active:
                done[s] += weights[s] * step
            room -= total * step
            if not active:
                break
        out.append(dict(done))
    return out


def test_schedule_stays_within_a_block_of_the_flow():
    draw = random.Random(8)
    for _ in range(40):
        blocks = {f"s{i}": draw.randint(1, 25) for i in range(draw.randint(1, 9))}
        weights = {s: draw.choice([1.0, 0.25, 3.5, 7.0, draw.random() + 0.01]) for s in blocks}
        found = list(mixing.schedule(blocks, weights))
        n = sum(blocks.values())
        assert [x[0] for x in found] == list(range(n))
        done, flow = dict.fromkeys(blocks, 0), flow_of(blocks, {s: Fraction(w) for s, w in weights.items()}, n)
        for slot, s, k, _ in found:
            assert k == done[s]
            done[s] += 1
            assert all(abs(done[t] - flow[slot][t]) < 1 for t in blocks)
        assert done == blocks


def earliest_deadlines(blocks, weights):
    """The schedule from the definition: at every slot the released block with the earliest deadline."""
    flow = [dict.fromkeys(blocks, Fraction(0)), *flow_of(blocks, weights, sum(blocks.values()))]
    window = {}
    for s, n in blocks.items():
        for k in range(n):
            release = next(t for t in range(len(flow) - 1) if flow[t + 1][s] > k)
            window[s, k] = release, next(t for t in range(1, len(flow)) if flow[t][s] >= k + 1)
    at, out = dict.fromkeys(blocks, 0), []
    for slot in range(sum(blocks.values())):
        _, s = min((window[s, at[s]][1], s) for s in blocks if at[s] < blocks[s] and window[s, at[s]][0] <= slot)
        out.append((slot, s, at[s]))
        at[s] += 1
    return out


def test_schedule_is_earliest_deadline_first():
    draw = random.Random(9)
    for _ in range(25):
        blocks = {f"s{i}": draw.randint(1, 12) for i in range(draw.randint(1, 7))}
        weights = {s: float(draw.randint(1, 9)) for s in blocks}
        assert [x[:3] for x in mixing.schedule(blocks, weights)] == earliest_deadlines(blocks, {s: Fraction(w) for s, w in weights.items()})


@pytest.mark.parametrize(("sources", "weight"), [(20, 0.24), (200, 0.1), (20, 0.0001), (1000, 0.3)])
def test_shares_follow_exact_weights(sources, weight):
    weights = {f"s{i:03}": weight if i == 0 else (1 - weight) * (i + 1) for i in range(sources)}
    total = sum(w for s, w in weights.items() if s != "s000") / (1 - weight)
    weights["s000"] = weight * total
    length = 40_000  # blocks; every source has enough for all of them
    found = [x for x in mixing.schedule({s: math.ceil(w / total * length) + 2 for s, w in weights.items()}, weights) if x[0] < length]
    for s in [*list(weights)[:5], *list(weights)[-5:]]:
        done = np.zeros(length)
        done[[x[0] for x in found if x[1] == s]] = 1
        assert np.abs(np.cumsum(done) - weights[s] / total * np.arange(1, length + 1)).max() < 1 + 1e-6


def test_equal_sources_are_equal_however_many_there_are():
    found = list(islice(mixing.schedule({f"s{i:03}": 100 for i in range(400)}, dict.fromkeys([f"s{i:03}" for i in range(400)], 2.0)), 4000))
    counts = {}
    for _, s, _, _ in found:
        counts[s] = counts.get(s, 0) + 1
    assert len(counts) == 400 and set(counts.values()) == {10}
    long_tail = {f"s{i:04}": 1 for i in range(3000)} | {"big": 2000}
    assert len(list(mixing.schedule(long_tail, mixing.square_roots(long_tail)))) == 5000
    assert list(mixing.schedule({}, {})) == []
    odd = list(mixing.schedule({"a": 7, "b": 100, "c": 1, "d": 33}, {"a": 1.0, "b": 2.0, "c": 0.0, "d": None}))
    assert len(odd) == 141 and {x[1] for x in odd} == set("abcd")


def test_mixed_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 30)
    rows = [(i, ["a", "a", "a", "b", "c", "d", "e", None][i % 8]) for i in range(700)] + [(1, "a"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(4)
    found = mixing.mixed(docs, block_rows=4).collect()
    assert len(found) == len(rows) and len({r["__at"] for r in found}) == len(rows)
    assert {r["__key"] for r in found} == {"sa", "sb", "sc", "sd", "se", "null"}
    counts = {k: sum(r["__key"] == k for r in found) for k in {r["__key"] for r in found}}
    blocks = {k: math.ceil(n / 4) for k, n in counts.items()}
    want = {(s, k): (slot, phase) for slot, s, k, phase in mixing.schedule(blocks, mixing.square_roots(counts))}
    assert all(want[r["__key"], r["__block"]] == (r["__slot"], r["__phase"]) and r["__at"] // 4 == r["__slot"] for r in found)
    out = mixing.mix(docs, block_rows=4)
    assert out.columns == docs.columns and out.count() == len(rows)
    placed = mixing.mix(docs, block_rows=4, position="place")
    assert sorted(r.place for r in placed.collect()) == sorted(r["__at"] for r in found)
    assert mixing.mix(docs.limit(0)).count() == 0
    for bad in (docs.withColumn("__x", F.lit(1)), docs.withColumn("place", F.lit(1))):
        with pytest.raises(ValueError, match="may not"):
            mixing.mix(bad, position="place")


def test_licenses_equal_brute_force(spark):
    draw = random.Random(12)
    notices = [(k, t) for k, ts in licenses.NOTICES.items() for t in ts]
    rows, want = [(0, None), (1, ""), (2, "License"), (2, "License")], []
    for i in range(3, 60):
        words = [f"w{draw.randint(0, 500)}" for _ in range(draw.choice([0, 5, 60, 400, 40_000 if i == 9 else 90]))]
        name, text = draw.choice(notices)
        at = draw.randint(0, len(words))
        rows.append((i, " ".join(words[:at] + ["x1", text.upper() if i % 2 else text, "x2"] + words[at:])))
        want.append((i, name, at + 1, at + len(licenses.WORD.findall(text.lower()))))
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, contained int").repartition(3)
    found = licenses.scan(docs).collect()
    assert sorted((r.doc_id, r.license, r.first_word, r.last_word) for r in found) == want
    assert {r.contained for r in found} == {1.0}
    assert licenses.scan(docs.limit(0)).count() == 0


def every_span(scanner, text):
    """The definition: all spans of a text and template, the fullest first, then the shortest and the earliest; none may overlap a chosen one."""
    stream, found = licenses.shingles(text).tolist(), set()
    for template in itertools.chain(*scanner.classes.values()):
        own = set(template.shingles.tolist())
        for a in range(len(stream)):
            held, b = set(), a
            for i in range(a, min(len(stream), a + template.length + template.length // 4)):
                if stream[i] in own and stream[i] not in held:
                    held.add(stream[i])
                    b = i
            if stream[a] in own and len(held) >= licenses.CONTAINED * len(own):
                found.add((template.license, a, b + licenses.SHINGLE - 1, len(held) / len(own)))
    kept = []
    for m in sorted(found, key=lambda m: (-m[3], m[2] - m[1], m[1], m[0])):
        if not any(k[0] == m[0] and k[1] <= m[2] and m[1] <= k[2] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m[1], m[0]))


@pytest.mark.parametrize("name", list(licenses.NOTICES))
def test_licenses_side_by_side(name):
    """Runs of 2 to 9 copies at all offsets are found copy by copy."""
    scanner = licenses.Scanner(licenses.NOTICES)
    for notice in licenses.NOTICES[name]:
        n = len(licenses.WORD.findall(notice))
        for copies in range(2, 10):
            for offset in range(0, 2 * n, 1 if n < 12 else 5):
                text = " ".join(["w"] * offset + [notice] * copies + ["v"] * 7)
                assert scanner.find(text) == [(name, offset + i * n, offset + (i + 1) * n - 1, 1.0) for i in range(copies)]


def test_licenses_changed_and_long():
    """Copies with words lost, changed or put in, beside and inside each other, and a template of 600 words, by the definition."""
    draw = random.Random(31)
    long = " ".join(f"t{draw.randint(0, 3000)}" for _ in range(600))
    scanner = licenses.Scanner({**licenses.NOTICES, "long": [long]})
    assert scanner.find(f"a {long} {long} b") == [("long", 1, 600, 1.0), ("long", 601, 1200, 1.0)]
    scanner = licenses.Scanner({**licenses.NOTICES, "hundred": [" ".join(long.split()[:100])]})
    found = 0
    for _ in range(60):
        words = []
        for _ in range(draw.randint(1, 6)):
            copy = draw.choice([*itertools.chain(*licenses.NOTICES.values()), " ".join(long.split()[:100])]).split()
            for _ in range(draw.choice([0, 0, 1, 2])):
                at = draw.randrange(len(copy))
                copy[at:at + draw.randint(0, 1)] = draw.choice([[], ["new"], ["two", "new"]])
            words += copy + ["w"] * draw.choice([0, 0, 1, 9])
        want = every_span(scanner, " ".join(words))
        found += len(want)
        assert scanner.find(" ".join(words)) == want
    assert found > 100
