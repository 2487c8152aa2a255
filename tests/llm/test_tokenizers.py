"""Encoding and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ringtide.llm import bpe, tokens
from ringtide.llm.common import shared_folder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcxyzABC éÉßİ'stresllmd0123²Ⅷ .,!#$%<>|\t\n\r\x0b\x1c\x85\xa0 　éé日本語😀Σς'  "


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    out = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    parts = ["<|endoftext|>", "a<|startoftext|>b", "aaaaaaaa", "x" * 39, "don't", "hahahaha", "....", "!!!!", "ababababab", "the", "ﬃ", "Å", "It's", "we'll"]
    out += [" ".join(draw.choice(parts) for _ in range(9)) for _ in range(300)]
    return [*out, "", " ", "\n", "\xa0", " \xa0 a", "<|endoftext|>", "a  b", "end ", " end", "word " * 5000]


def test_prefix_table_gives_the_librarys_ids(texts):
    own, library = bpe.WordBpe(WORDS), Tokenizer.from_file(WORDS)
    for text, found, raw in zip(texts, own.digests(texts), own.ids(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids, text
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_pieces_give_the_librarys_ids(texts):
    library = Tokenizer.from_file(BYTES)
    for text, found in zip(texts, tokens.encode(BYTES, texts), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_caches_forget(texts, monkeypatch):
    monkeypatch.setattr("ringtide.llm.tokens.KEPT_BYTES", 10_000)
    monkeypatch.setattr("ringtide.llm.pieces.LONG", 30)
    library, tokens._LOADED = Tokenizer.from_file(BYTES), {}
    for text, found in zip(texts, tokens.encode(BYTES, texts), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_serialized_ids():
    for ids in ([], [5, 70_000], [1, 2, 65_535]):
        assert tokens.deserialized(tokens.serialized(np.array(ids, "<u4").tobytes(), 0)).tolist() == [*ids, 0]


def test_encode_ids_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (2, "Hello World", 7), (2, "Hello World", 7), (None, "a b", None)], "doc_id long, text string, n_tokens int")
    rows = sorted(map(tuple, bpe.encode_ids(df, WORDS).collect()), key=str)
    library = Tokenizer.from_file(WORDS)
    want = []
    for doc, text in ((1, ""), (2, ""), (2, "Hello World"), (2, "Hello World"), (None, "a b")):
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((doc, ids, library.decode(ids, skip_special_tokens=False)))
    assert rows == sorted(want, key=str)
    assert [r.n_tokens for r in bpe.encode_digests(df.where("doc_id = 1"), WORDS).collect()] == [0]
    assert bpe.encode_digests(df.limit(0), WORDS).count() == 0


def test_token_files(spark, texts, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_DOCS", 7)
    rows = [(i, t if i % 97 else None) for i, t in enumerate(texts[-400:])] + [(5, "again"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    folder = shared_folder(spark, "test-tokens")
    tokens.write_tokens(docs, BYTES, folder)
    library, want = Tokenizer.from_file(BYTES), {}
    for doc, text in rows:
        want.setdefault(doc, []).append([*library.encode(text or "", add_special_tokens=False).ids, 0])
    found = tokens.read_index(spark, folder).collect()
    assert len(found) == len(rows)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        assert r.ids_crc32 in {zlib.crc32(np.array(x, "<u4").tobytes()) for x in want[r.doc_id]}
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    one = tokens.read_documents(spark, folder, [11]).collect()
    assert [r.ids for r in one] == want[11]
    assert tokens.read_documents(spark, folder).count() == len(rows)


def test_token_files_of_nothing(spark):
    assert tokens.token_files(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0
