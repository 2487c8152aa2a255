"""Counts and certified cutoffs against plain Python."""

import math
import random
import re

from pyspark.sql import functions as F

from ringtide.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    places, covered = {}, set()
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i:i + 8]), []).append(i)
    for found in places.values():
        if len(found) > 1:
            for i in found:
                covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_of_whole_texts(spark):
    draw = random.Random(5)
    texts = [None, "", "  \n", "one", "a\xa0b c\x0bd", "é" * 30, "x " * 9, "x " * 20_000]
    for _ in range(200):
        words = [draw.choice(["a", "b#", "é&", "line", "😀"]) for _ in range(draw.randint(0, 60))]
        texts.append("".join(w + draw.choice([" ", "\n", "\t", "  "]) for w in words))
        block = " ".join(f"w{draw.randint(0, 99)}" for _ in range(12))
        texts.append(f"{block} gap {block}\n{block}\n{block}")
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        n, chars, symbols, lines, repeats = counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), text
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n) and r.kept == (not r.base_failed)


def test_binomial_tail(spark):
    cases = [(0, 50), (3, 400), (0, 1), (5, 5), (17, 2000), (40, 3000), (2500, 200_000), (0, 0), (7, 21)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p"))
    for k, n, p in df.collect():
        if n == 0 or k >= n * 0.02:
            assert p == 1
        else:
            exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.02) + (n - i) * math.log(0.98)) for i in range(k + 1))
            assert math.isclose(p, exact, rel_tol=1e-6) or k > quality.TAIL_TERMS and p >= exact


def corpus(spark, good, junk):
    clean = " ".join(f"w{i}" for i in range(40))
    noisy = " ".join(f"w{i}###" for i in range(40))
    rows = [(i, clean, "en", 1) for i in range(good)] + [(good + i, noisy, "en", 0) for i in range(junk)] + [(10**6, noisy, None, None), (10**6 + 1, clean, None, None)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(0, 1), (None, 1)], "doc_id long, quality int")
    return docs, labels


def test_cutoffs_are_certified_or_absent(spark):
    docs, labels = corpus(spark, 400, 30)
    rows = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert rows[0].kept and not rows[400].kept and rows[0].cut_symbols == 0.1
    assert rows[10**6].kept and rows[10**6].cut_symbols is None  # its stratum has no labels
    few_docs, few_labels = corpus(spark, 50, 30)
    assert all(r.kept for r in quality.judge(few_docs, few_labels).collect())  # too few to prove anything
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 402


def test_share_of_good_documents_stays_bounded(spark):
    """Half of the good documents have symbols: no cutoff below theirs can be certified."""
    clean, odd = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}#" for i in range(40))
    docs = spark.createDataFrame([(i, odd if i % 2 else clean, "en") for i in range(600)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(600)], "doc_id long, quality int")
    rows = quality.judge(docs, labels).collect()
    assert all(r.kept for r in rows) and {r.cut_symbols for r in rows} == {0.3}


def test_no_documents(spark):
    docs, labels = corpus(spark, 1, 1)
    assert quality.judge(docs.limit(0), labels).count() == 0
