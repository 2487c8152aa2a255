"""Classes of the n-gram join against all pairs."""

import random

import pytest

from ringtide.llm import ngram_join


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def brute(rows):
    sets = [(doc, shingles(text)) for doc, text in rows if doc is not None]
    parent = {doc: doc for doc, _ in sets}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                u, v = find(parent, a), find(parent, b)
                parent[max(u, v)] = min(u, v)
    return {doc: find(parent, doc) for doc in parent}


def sample(seed):
    """Families around the threshold, a passage that many share, short texts that differ little, copies."""
    draw, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(60)]
    for size in (1, 2, 3, 12, 60, 120):
        base = [f"b{draw.randint(0, 3000)}" for _ in range(draw.choice([8, 60, 120, 300]))]
        for _ in range(size):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 40))):
                words[draw.randrange(len(words))] = f"c{draw.randint(0, 9999)}"
            if draw.random() < 0.3:
                words += [f"e{draw.randint(0, 9)}" for _ in range(draw.randint(1, 20))]
            rows.append(" ".join(words))
    for i in range(90):
        rows.append(" ".join(passage + [f"d{draw.randint(0, 99999)}" for _ in range(draw.choice([3, 8, 14, 40]))]))
    rows += [f"one two three four five six {i % 9}" for i in range(60)]
    rows += [rows[3]] * 40 + ["few words", "Few  WORDS", "few", None, "", " \n", "É é", "é é"]
    draw.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("frequent", "most", "medium", "block", "columns"), [(32, 1 << 18, 512, 512, 2048), (2, 1 << 18, 3, 7, 16), (4, 0, 5, 40, 50), (3, 60, 20, 512, 2048)])
def test_classes_equal_all_pairs(spark, monkeypatch, frequent, most, medium, block, columns):
    for name, value in (("FREQUENT", frequent), ("MOST_FREQUENT", most), ("MEDIUM", medium), ("BLOCK", block), ("COLUMNS", columns), ("SLICE", 50)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = sample(frequent + block)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, col int").repartition(3)
    sizes = {doc: len(shingles(text)) for doc, text in rows}
    found = sorted(map(tuple, ngram_join.join_classes(docs).collect()))
    assert found == [(doc, sizes[doc], comp) for doc, comp in sorted(brute(rows).items())]


@pytest.mark.parametrize("medium", [512, 8])
def test_pairs_at_the_threshold_inside_a_family(spark, monkeypatch, medium):
    """Unlinked relatives, most of whose columns are frequent, with twins among them that are just linked or just not."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 8)
    monkeypatch.setattr(ngram_join, "MEDIUM", medium)
    passage, rows = [f"p{i}" for i in range(144)], []
    for i in range(120):  # 140 of 164 shingles are common to all: 0.74; twins share 6 more (0.80) or 5 more (0.79)
        tail = [f"d{i}x{j}" for j in range(24)]
        shared = 6 if i < 20 else 7 if i < 40 else 0
        tail[:shared] = [f"t{i // 2}x{j}" for j in range(shared)]
        rows.append((i, " ".join(passage + tail)))
    want = brute(rows)
    assert {i for i in want if want[i] != i} <= set(range(40)) and 0 < len({i for i in want if want[i] != i}) < 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.join_classes(docs).collect()} == want


def test_null_and_repeated_ids_and_a_long_text(spark):
    same = " ".join(f"w{i}" for i in range(30))
    long_text = " ".join(f"v{i}" for i in range(60_000))
    rows = [(None, same), (7, same), (7, same), (9, same), (3, None), (3, None), (40, long_text), (41, long_text + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, ngram_join.join_classes(docs).collect()), key=str)
    assert found == sorted([(None, 26, None), (7, 26, 7), (7, 26, 7), (9, 26, 7), (3, 0, 3), (3, 0, 3), (40, 59_996, 40), (41, 59_997, 40)], key=str)
    assert ngram_join.join_classes(docs.limit(0)).count() == 0


def test_prefixes_meet():
    for m in range(1, 60):
        for n in range(m, 60):
            if 100 * m < ngram_join.PERCENT * n:
                continue
            o = ngram_join.need(m, n)  # the least overlap leaves the prefixes no room to miss each other
            assert (n - ngram_join.prefix_length(n)) < o and (m - ngram_join.prefix_length(m)) < o and 180 * o >= 80 * (m + n) > 180 * (o - 1)


def shuffled_rows(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_only_the_sets_of_pairs_are_shuffled(spark, monkeypatch):
    """Sets are the largest rows of the join; those that no pair names stay where they are."""
    seen, real = [], ngram_join.checkpointed
    monkeypatch.setattr(ngram_join, "checkpointed", lambda df: seen.append(df) or real(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    try:
        sets = spark.range(200).selectExpr("id AS node", "sequence(id div 2, id div 2 + 50) AS shingles").repartition(3)
        pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 50)], "a long, b long")
        found = sorted(map(tuple, ngram_join.linked(pairs, sets).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == [(0, 1), (2, 3)]
    assert shuffled_rows(seen[-1]._jdf.queryExecution().executedPlan()) < 2 * 200  # 200 of them by the repartition
