"""Languages: held-out accuracy and the edges."""

import numpy as np

from ringtide.llm import language


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", language.held_out().alias("held_out"))
    model = language.fit(docs.where("NOT held_out"))
    rows = language.predict(docs.where("held_out"), model).collect()
    right = [r.lang == r.lang_pred for r in rows]
    assert len(rows) > 20 and np.mean(right) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    train = spark.createDataFrame([("en", "the house and the garden"), ("de", "das haus und der garten"), (None, "nope"), ("en", None)], "lang string, text string")
    model = language.fit(train)
    assert model.langs == ["de", "en"]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 ²³ !"), (4, "THE garden"), (5, "der hausgarten"), (5, "der hausgarten"), (6, "日本語"), (7, "the " * 600_000)], "score long, text string")
    rows = language.predict(docs, model).collect()
    assert len(rows) == 8 and sorted(r.lang_pred for r in rows)[-3:] == ["und"] * 3
    found = {r.text[:3] if r.text else r.text: r for r in rows}
    assert found["THE"].lang_pred == "en" and found["der"].lang_pred == "de" and found["the"].lang_pred == "en"
    assert found["日本語"].score == 0.5  # no gram of it is known: both are as likely
    empty = language.fit(train.limit(0))
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_backoff_takes_the_longest_known_gram(spark):
    model = language.Model(["x", "y"], {"word": np.array([-1.0, -9.0])}, {"wo": np.array([-2.0, -1.0]), "w": np.array([-1.0, -5.0])}, (4, 3, 2, 1))
    assert model.word_score("word").tolist() == [-1, -9]
    assert model.word_score("wow").tolist() == [-1, -0.5]  # of order 2
    assert model.word_score("w").tolist() == [-1, -5]  # of order 1
    assert model.word_score("q").tolist() == [0, 0]


def test_keep_identified(spark):
    docs = spark.createDataFrame([(1, "the house", "en"), (2, "das haus", "de"), (3, "12", None), (4, None, "en")], "doc_id long, text string, lang string")
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
