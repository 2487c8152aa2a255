"""Byte-pair encoding by a table of prefixes, and decoding (operator 10).

For every prefix of a word there is exactly one token with which its encoding
ends. A suffix automaton over the vocabulary names the tokens that a prefix ends
with; the right one is the token that is *compatible* with the last token of the
prefix before it, that is, no merge crosses their border at any time. Following
the stored tokens back from the end of the word gives the ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import arrow_task, columns_of, holds, written
from .pieces import PieceCache, Recent

#: Pair tests kept in a worker.
PAIRS_KEPT = 200_000
#: A word that the file's normaliser only makes lower case, and its splitter leaves whole.
LETTERS = re.compile(r"[ \t-\r]*([A-Za-z]+)")


class PrefixEncoder:
    """Ids of words of a BPE vocabulary whose last symbol carries an end mark.

    A word is given as its symbols: one character per byte of the word in the
    vocabulary's own alphabet. The last symbol is another letter of the automaton
    than the same symbol inside a word.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.end = end
        self.rank, self.left, self.right, self.merged = {}, {}, {}, {}
        for rank, (a, b) in enumerate(merges):
            x, y, token = vocab[a], vocab[b], vocab[a + b]
            self.merged.setdefault((x, y), rank)
            if token not in self.rank:
                self.rank[token], self.left[token], self.right[token] = rank, x, y
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for text, token in vocab.items():
            symbols = self.letters(text.removesuffix(end), text.endswith(end)) if end else text
            if symbols and (token in self.rank and self.whole(token) or len(symbols) == 1):
                self.automaton.add_word(symbols, (len(symbols), token))
        self.automaton.make_automaton()

    @staticmethod
    def letters(symbols: str, last: bool) -> str:
        """Symbols as letters of the automaton."""
        return symbols[:-1] + chr(ord(symbols[-1]) + 0x10000) if last and symbols else symbols

    def whole(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token: its parts are, and meet only in its merge."""
        x, y, rank = self.left[token], self.right[token], self.rank[token]
        return (x not in self.rank or self.whole(x)) and (y not in self.rank or self.whole(y)) and self.apart(x, y, rank)

    def apart(self, x: int, y: int, limit: float) -> bool:
        """Whether no merge before `limit` crosses the border of two neighbouring tokens.

        Their merges are undone from the latest on. Equal merges run from left
        to right, so one across the border precedes an equal one to its right.
        """
        rank, merged = self.rank, self.merged
        while True:
            if merged.get((x, y), limit) < limit:
                return False
            in_x, in_y = rank.get(x, -1), rank.get(y, -1)
            if in_x > in_y:
                limit, x = in_x, self.right[x]
            elif in_y >= 0:
                limit, y = in_y + 1, self.left[y]
            else:
                return True

    def compatible(self, x: int, y: int) -> bool:
        """`apart` without a limit, remembered."""
        key = x << 32 | y
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self.apart(x, y, float("inf"))
        return known

    def word(self, symbols: str) -> list[int]:
        """Ids of one word."""
        n = len(symbols)
        size, last = [0] * (n + 1), [-1] * (n + 1)
        for stop, (length, token) in self.automaton.iter(self.letters(symbols, bool(self.end))):
            stop += 1
            start = stop - length
            if size[stop] == 0 and (start == 0 or size[start] and self.compatible(last[start], token)):
                size[stop], last[stop] = length, token
        ids, at = [], n
        while at:
            if not size[at]:
                raise ValueError(f"no token ends at symbol {at} of {symbols[:100]!r}")
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]


class WordBpe:
    """Encoding and decoding of whole texts with a vocabulary file of words with end marks.

    The file's normaliser and splitter make words of a piece of text; the merges are done by `PrefixEncoder`.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model = parts["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.encoder = PrefixEncoder(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")")
        texts = self.library.get_vocab(with_added_tokens=True)
        self.token_text = [b""] * (max(texts.values(), default=-1) + 1)
        for text, i in texts.items():
            self.token_text[i] = b" " + text.encode()
        self.words = Recent(lambda word: array("I", self.encoder.word(word)).tobytes())
        self.cache = PieceCache(self.encoded, lambda letters: self.encoded(" " + letters), lambda a, b: a + b)

    def encoded(self, piece: str) -> bytes:
        """Ids of a piece of text as bytes; words in the vocabulary's own alphabet are remembered."""
        if m := LETTERS.fullmatch(piece):
            return self.words[m[1].lower()]
        out = b""
        for part in self.split_special.split(piece):
            if part in self.special:
                out += array("I", [self.special[part]]).tobytes()
            elif part:
                plain = self.library.normalizer.normalize_str(part)
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(plain):
                    out += self.words[word]
        return out

    def decoded(self, raw: bytes) -> bytes:
        """Token texts, each behind a blank: the file names no decoder, so the library joins tokens by blanks."""
        return b"".join(map(self.token_text.__getitem__, array("I", raw)))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of tokens, hash of the ids, hash of the decoded text."""
        for raw in self.ids(texts):
            yield len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(memoryview(self.decoded(raw))[1:]).hexdigest()

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """For each text, its ids as bytes."""
        for values in self.cache.values(texts):
            self.words.trim()
            yield b"".join(values)


_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The vocabulary of a file, loaded once per Python worker."""
    holds("bpe", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text and the text that they decode to: id, `ids`, `decoded`.

    A null text counts as empty and gives no ids and an empty text. Repeated rows
    each give their row; other columns are not looked at. An empty table gives
    an empty table. A text of any length is encoded whole.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        bpe, ids, texts = word_bpe(path), [], []
        for raw in bpe.ids(batch.column(1).to_pylist()):
            ids.append(np.frombuffer(raw, "<i4"))
            texts.append(bpe.decoded(raw)[1:].decode())
        return {id_col: batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}

    texts = columns_of(df, id_col, text_col).withColumn(text_col, F.coalesce(text_col, F.lit("")))
    return arrow_task(texts, f"`{id_col}` {kind}, ids array<int>, decoded string", work, sliced=True)


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """As `encode_ids`, with hashes in place of the ids and texts: id, `n_tokens`, `ids_sha256`, `decoded_sha256`.

    Rows come in the order of `order_col`, a whole number, if one is named.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        bpe = word_bpe(path)
        n, ids, decoded = zip(*bpe.digests(batch.column(1).to_pylist()), strict=True)
        out = {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()),
               "decoded_sha256": pa.array(decoded, pa.string())}
        return {**out, "__order": batch.column(2)} if order_col else out

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if not order_col:
        return arrow_task(columns_of(df, id_col, text_col).withColumn(text_col, F.coalesce(text_col, F.lit(""))), schema, work, sliced=True)
    some = df.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{order_col}`").cast("long"))
    # written, because a sort by ranges reads its input twice
    return written(arrow_task(some, f"{schema}, __order long", work, sliced=True), "digests").orderBy("__order").drop("__order")
