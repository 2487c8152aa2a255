"""Language of a text, word first (operator 7).

A known word scores by its log frequency in every language. A word that no
language knows falls back to its character n-grams: the longest order of which
some language knows a gram decides. Frequencies are counted over all training
texts; the model keeps the most frequent words and grams of every language.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SLICE, arrow_task, checkpointed, columns_of, frugal, holds, slices  # noqa: F401

#: Runs of letters (and the few letter-like numbers that the class lets through).
WORD = re.compile(r"[^\W\d_]+")
#: Everything in ASCII but letters ends a token.
ENDS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
#: Counts that a task holds before it passes them on.
HELD = 100_000
#: Tokens beside the words of the model whose scores a worker keeps.
KEPT = 100_000
#: Characters of a text that are split into words at a time.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Size:
    """Bounds of the model, which a task holds whole: words and grams of each order, of all languages together."""

    words: int = 120_000
    grams: int = 40_000
    orders: tuple[int, ...] = (4, 3, 2, 1)


def parts_of(text: str) -> Iterator[str]:
    """A whole text; one beyond CHUNK characters in parts cut between words."""
    start = 0
    while len(text) - start > CHUNK:
        stop = start + CHUNK
        while stop < len(text) and text[stop].isalpha():
            stop += 1
        yield text[start:stop]
        start = stop
    yield text[start:]


def tokens_of(part: str) -> list[bytes]:
    """The text in lower case, cut at all of ASCII but letters. A token is a word, or holds some beside other characters."""
    return part.lower().encode("utf-8", "surrogatepass").translate(ENDS).split()


def words_of(token: bytes) -> list[str]:
    """The words of a token."""
    lower = token.decode("utf-8", "surrogatepass")
    return [lower] if lower.isalpha() else WORD.findall(lower)


def grams_of(word: str, order: int) -> list[str]:
    """Character n-grams of a word with a blank before and behind; a single character only inside."""
    marked = word if order == 1 else f" {word} "
    return [marked[i:i + order] for i in range(len(marked) - order + 1)]


def _passed_on(counts: dict[str, Counter], name: str) -> pa.RecordBatch:
    """The counts by language as rows `lang`, `name` and `n`; they are forgotten."""
    columns = {
        "lang": pa.array([lang for lang, found in counts.items() for _ in found], pa.string()),
        name: pa.array([key for found in counts.values() for key in found], pa.string()),
        "n": pa.array([n for found in counts.values() for n in found.values()], pa.int64())}
    counts.clear()
    return pa.RecordBatch.from_pydict(columns)


def _word_counts(rows: DataFrame) -> DataFrame:
    """lang, word and n for `rows` (language, text): sums by task, passed on whenever HELD tokens are held."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("language", lambda: None)
        tokens, held = defaultdict(Counter), 0

        def words() -> dict[str, Counter]:
            out = defaultdict(Counter)
            for lang, found in tokens.items():
                into = out[lang]
                for token, n in found.items():
                    for word in words_of(token):
                        into[word] += n
            tokens.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    for piece in parts_of(text):
                        into = tokens[lang]
                        before = len(into)
                        into.update(tokens_of(piece))
                        held += len(into) - before
                        if held > HELD:
                            yield _passed_on(words(), "word")
                            held = 0
        if tokens:
            yield _passed_on(words(), "word")

    return rows.mapInArrow(frugal(task), "lang string, word string, n long")


def _gram_counts(words: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    """lang, gram and n for the words of `words` (lang, word, n): sums by task, passed on whenever HELD grams are held."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("language", lambda: None)
        grams, held = defaultdict(Counter), 0
        for batch in batches:
            for part in slices(batch):
                for lang, word, n in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    into = grams[lang]
                    before = len(into)
                    for order in orders:
                        for gram in grams_of(word, order):
                            into[gram] += n
                    held += len(into) - before
                    if held > HELD:
                        yield _passed_on(grams, "gram")
                        held = 0
        if grams:
            yield _passed_on(grams, "gram")

    return words.mapInArrow(frugal(task), "lang string, gram string, n long")


def _frequent(counts: DataFrame, by: list[str], limit: str) -> DataFrame:
    """Rows whose count is so large that at most `limit` rows of their group have it or more; ties go together."""
    tally = counts.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("rows"))
    above = Window.partitionBy(*by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    least = tally.withColumn("above", F.sum("rows").over(above)).where(F.col("above") <= F.expr(limit)).groupBy(*by).agg(F.min("n").alias("least"))
    return counts.join(least, by).where("n >= least").drop("least")


def _totals(counts: DataFrame, by: list[str]) -> list:
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()


class Scores:
    """Scores in every language by key, as the rows of one matrix. The keys stay packed until one is looked for."""

    def __init__(self, keys: pa.Array, matrix: np.ndarray):
        self.keys, self.matrix, self.known = keys, matrix, None

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Scores:
        return cls(pa.array(list(arrays), pa.string()), np.stack(list(arrays.values())) if arrays else np.zeros((0, 0)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    @property
    def rows(self) -> dict[str, int]:
        if self.known is None:
            self.known = dict(zip(self.keys.to_pylist(), range(len(self.keys)), strict=True))
        return self.known


class Model:
    """Log frequencies by word and gram, an array over the languages each."""

    def __init__(self, langs: list[str], words: Scores | dict[str, np.ndarray], grams: Scores | dict[str, np.ndarray], orders: tuple[int, ...]):
        self.langs, self.orders = langs, orders
        self.words, self.grams = (x if isinstance(x, Scores) else Scores.of(x) for x in (words, grams))
        self.place: dict[bytes, int] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": None, "table": None}

    def start(self) -> None:
        """Begin the table of scores by token with the words of the model, and a row of zeros for a token without words."""
        self.place = dict(zip(self.words.keys.cast(pa.binary()).to_pylist(), range(len(self.words.keys)), strict=True))
        self.own = self.filled = len(self.place)
        self.table = np.zeros((self.own + 4096, len(self.langs)))
        self.table[:self.own] = self.words.matrix if self.own else 0
        self.put([b""], np.zeros((1, len(self.langs))))

    def forget(self) -> None:
        """Leave only what the table began with; entries are in the order in which they came."""
        if len(self.table) > 4 * (self.own + KEPT):  # a long text has left much room behind it
            return self.start()
        while len(self.place) > self.own + 1:
            self.place.popitem()
        self.filled = self.own + 1

    def put(self, tokens: list[bytes], scores: np.ndarray) -> None:
        """Give every token a row with its scores."""
        end = self.filled + len(tokens)
        if end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(tokens)), len(self.langs)))])
        self.table[self.filled:end] = scores
        self.place.update(zip(tokens, range(self.filled, end), strict=True))
        self.filled = end

    def learn(self, fresh: set[bytes]) -> None:
        """Rows for tokens that are not in the table: one for a word that the model does not hold, or the sum of several words."""
        words = {token: words_of(token) for token in fresh}
        named = {w.encode("utf-8", "surrogatepass"): w for found in words.values() for w in found}
        unknown = [raw for raw in named if raw not in self.place]
        self.put(unknown, self.gram_scores([named[raw] for raw in unknown]))
        for token in fresh.difference(self.place):
            places = [self.place[w.encode("utf-8", "surrogatepass")] for w in words[token]]
            if len(places) > 1:
                self.put([token], self.table[places].sum(axis=0))
            else:
                self.place[token] = places[0] if places else self.place[b""]

    def gram_scores(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of words from the longest grams of theirs that the model holds; a row of zeros if it holds none."""
        known, places, ends, orders = self.grams.rows, [], [0], []
        for word in words:
            for order in self.orders:
                if found := [at for x in grams_of(word, order) if (at := known.get(x)) is not None]:
                    places += found
                    break
            ends.append(len(places))
            orders.append(order)
        starts = np.array(ends[:-1], np.int64)
        some = np.diff(ends) > 0
        scores = np.zeros((len(words), len(self.langs)))
        if places:
            scores[some] = np.add.reduceat(self.grams.matrix[places], starts[some], axis=0) / np.array(orders)[some, None]
        return scores

    def word_score(self, word: str) -> np.ndarray:
        """Log likelihood of a word in every language, up to a constant of the word."""
        return self.gram_scores([word])[0] if (at := self.words.rows.get(word)) is None else self.words.matrix[at]

    def scores(self, part: str) -> np.ndarray:
        """Sum of the scores of the words in a part of a text; those of tokens already seen are remembered."""
        if self.place is None:
            self.start()
        elif len(self.place) > self.own + KEPT:
            self.forget()
        tokens = tokens_of(part)
        if fresh := set(tokens).difference(self.place):
            self.learn(fresh)
        places = np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
        return self.table[places].sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its posterior under equal priors; `und` and 0 without a letter."""
        if not text or not self.langs or not any(c.isalpha() for c in text):
            return "und", 0.0
        total = np.zeros(len(self.langs))
        for part in parts_of(text):
            total += self.scores(part)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def fit(docs: DataFrame, size: Size = Size(), text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count words and grams of all rows with a language and a text, and keep the most frequent.

    Null languages and texts teach nothing. Without a row the model knows no language.
    """
    rows = columns_of(docs, lang_col, text_col).where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())

    orders = size.orders
    words = checkpointed(_word_counts(rows).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    grams = checkpointed(_gram_counts(words, orders).groupBy("lang", F.length("gram").alias("o"), "gram").agg(F.sum("n").alias("n")))
    word_totals = {r["lang"]: r for r in _totals(words, ["lang"])}
    gram_totals = {(r["lang"], r["o"]): r for r in _totals(grams, ["lang", "o"])}
    langs = sorted(word_totals)
    if not langs:
        return Model([], {}, {}, orders)
    at = {lang: i for i, lang in enumerate(langs)}
    # half a count for what a language has not shown
    word_all = {at[x]: r["n"] + r["kinds"] for x, r in word_totals.items()}
    gram_all = {(at[x], o): r["n"] + r["kinds"] for (x, o), r in gram_totals.items()}
    word_floor = np.array([math.log(0.5 / word_all[i]) for i in range(len(langs))])
    gram_floor = {o: np.array([math.log(0.5 / n) if (n := gram_all.get((i, o))) else -20.0 for i in range(len(langs))]) for o in orders}

    def scores(found: pa.Table, key: str, floor, total) -> Scores:
        """The most frequent keys, which come as Arrow columns: a Python object for each would fill the driver."""
        keys, held = (found.column(c).combine_chunks().dictionary_encode() for c in (key, "lang"))
        lang = np.array([at[x] for x in held.dictionary.to_pylist()], np.int64)[held.indices.to_numpy()]
        order = found.column("o").to_numpy() if "o" in found.column_names else np.zeros(len(lang), np.int64)
        place, matrix = keys.indices.to_numpy(), np.empty((len(keys.dictionary), len(langs)))
        for o in np.unique(order):
            matrix[place[order == o]] = floor(int(o))
        share = found.column("n").to_numpy() / np.array([total(int(i), int(o)) for i, o in zip(lang, order, strict=True)], np.float64)
        matrix[place, lang] = [math.log(x) for x in share]
        return Scores(keys.dictionary, matrix)

    known = scores(_frequent(words, ["lang"], str(max(1, size.words // len(langs)))).toArrow(), "word", lambda _: word_floor, lambda i, _: word_all[i])
    parts = scores(_frequent(grams, ["lang", "o"], str(max(1, size.grams // len(langs)))).toArrow(), "gram", lambda o: gram_floor[o], lambda i, o: gram_all[i, o])
    return Model(langs, known, parts, orders)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score` (0 to 1) from each row's whole text alone.

    `und` and 0 for a null text, a text without a letter, or a model without
    languages. Other columns stay; two of those names are replaced.
    """
    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        holds("language", lambda: None)
        found = [shared.value.predict(t.as_py()) for t in batch.column(text_col)]  # one text at a time
        return {**{c: batch.column(c) for c in rest}, "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return arrow_task(docs.select(*[F.col(f"`{c}`") for c in rest]), f"{kinds}, lang_pred string, score double", work, sliced=True)


def held_out() -> Column:
    """Documents that teach nothing: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, least: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows whose language is told with a posterior of `least` or more, by a model of the rows with a language on record."""
    model = fit(docs, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("language", lambda: None)
        for batch in batches:
            for part in slices(batch):
                found = [shared.value.predict(t.as_py()) for t in part.column(text_col)]
                yield part.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(frugal(task), docs.schema)
