import pickle
import tracemalloc

import numpy as np
import pyarrow as pa

from ringtide.llm import language


def test_model_is_held_in_one_matrix():
    arrays = {f"word{i}": np.full(4, float(i)) for i in range(20_000)}
    model = language.Model(["a", "b", "c", "d"], arrays, {}, (4, 3, 2, 1))
    raw = pickle.dumps(model)
    assert len(raw) < 60 * len(arrays)  # an array each takes over 100 bytes
    tracemalloc.start()
    again = pickle.loads(raw)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 200 * len(arrays)  # an array each takes over 300 bytes
    assert again.word_score("word7").tolist() == [7.0] * 4 and again.word_score("none").tolist() == [0.0] * 4
    assert language.Model([], {}, {}, (1,)).predict("text") == ("und", 0.0)


def test_batches_are_taken_in_slices():
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    parts = list(language.slices(batch))
    assert max(p.num_rows for p in parts) <= language.SLICE < 1000
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(1000))


def test_driver_holds_the_model_packed(spark):
    docs = spark.range(400).selectExpr("'x' AS lang", "concat_ws(' ', transform(sequence(0, 49), i -> translate(cast(10000 + id * 50 + i AS string), '0123456789', 'abcdefghij'))) AS text")
    language.fit(docs.limit(1))  # what is imported on the way does not count
    tracemalloc.start()
    model = language.fit(docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 * 20_000  # an object for each row and an array for each word take over 500 bytes
    assert len(model.words.matrix) == 20_000


def test_words_of_a_text_are_scored_together(monkeypatch):
    draw = np.random.default_rng(5)
    words = {w: draw.normal(size=2) for w in ("the", "house", "été", "ὀδός")}
    grams = {g: draw.normal(size=2) for g in ("a", "b", "ab", " q", "zz ", "ii")}
    text = " ".join(["The house, l'été; İstanbul x²y ² a_b ΟΔΟΣ “the” 日本語 1st"] + [f"q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(500)] * 2)
    plain = language.Model(["x", "y"], words, grams, (2, 1))
    want = sum(plain.word_score(w) for w in language.WORD.findall(text.lower()))
    calls = []
    single = language.Model.word_score
    monkeypatch.setattr(language.Model, "word_score", lambda self, word: calls.append(word) or single(self, word))
    monkeypatch.setattr(language, "KEPT", 50)
    model = language.Model(["x", "y"], words, grams, (2, 1))
    for _ in range(3):  # what the model holds stays in the table when the rest is forgotten
        lang, score = model.predict(text)
        assert lang == "xy"[int(np.argmax(want))] and np.isclose(score, 1 / np.exp(want - want.max()).sum())
    assert not calls
