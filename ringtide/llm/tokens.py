"""Token ids in files from which one short document can be read alone (operator 2).

A file is a Parquet table of blocks. A block holds some consecutive documents:
their ids compressed one document at a time with one zstandard dictionary, the
offset of every document inside the payload, and the hash of the dictionary.
The dictionary lies beside the blocks and is trained on serialized id arrays.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import arrow_task, checkpointed, columns_of, holds, shared_folder, sums_before
from .pieces import RARE_SPACE, PieceCache

#: Documents and bytes of a block, whichever is reached first.
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20
#: The dictionary is trained on so many documents, none longer than so many characters: it serves short documents.
SAMPLE_DOCS, SAMPLE_CHARS = 512, 6000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Bytes of each table of pieces that a worker keeps.
KEPT_BYTES = 110 << 20

# Fixed values of byte-level vocabularies: visible bytes stand for themselves, the others for characters from U+0100 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SYMBOLS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}

_LOADED: dict[str, PieceCache] = {}


def _encoder(path: str) -> PieceCache:
    """Bytes of ids (little-endian, 32 bits) of every piece; loaded once per Python worker."""
    holds("token files", _LOADED.clear)
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work; the library's threads only add to it
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        model = library.model

        def encode(piece: str) -> bytes | None:
            return None if piece[-1] in RARE_SPACE else array("I", library.encode(piece, add_special_tokens=False).ids).tobytes()

        def encode_word(letters: str) -> bytes:
            # letters behind a blank are one part of the splitter, so that the model may take them directly
            raw = " " + letters
            symbols = "Ġ" + letters if raw.isascii() else raw.encode().decode("latin-1").translate(SYMBOLS)
            return array("I", [t.id for t in model.tokenize(symbols)]).tobytes()

        cache = _LOADED[path] = PieceCache(encode, encode_word, lambda a, b: a + b, KEPT_BYTES)
        cache.library = library
    return _LOADED[path]


def encode(path: str, texts: list[str]) -> Iterator[bytes]:
    """Ids of whole texts. Where white space that cuts meets other white space, the library gets the text itself."""
    cache = _encoder(path)
    for text, values in zip(texts, cache.values(texts), strict=True):
        if values == [None]:
            yield np.array(cache.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            yield b"".join(values)


def serialized(ids: bytes, end: int) -> bytes:
    """Ids and the end id as a document's bytes: its width in the first byte, then ids of 2 or 4 bytes."""
    array = np.append(np.frombuffer(ids, "<u4"), np.uint32(end))
    narrow = int(array.max()) < 1 << 16
    return (b"\2" + array.astype("<u2").tobytes()) if narrow else (b"\4" + array.astype("<u4").tobytes())


def deserialized(raw: bytes) -> np.ndarray:
    """Ids of a document's bytes."""
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1).astype("<u4")


def train_dictionary(docs: DataFrame, path: str, id_col: str, text_col: str, end: int) -> bytes:
    """A dictionary from the serialized ids of at most SAMPLE_DOCS short documents, dealt by a hash.

    With too few documents for training their bytes are the dictionary; without any there is none.
    """
    short = docs.where(F.length(text_col).between(1, SAMPLE_CHARS)).select(text_col, F.xxhash64(F.lit(2), F.col(id_col), text_col).alias("__h"))
    sample = short.orderBy("__h", text_col).limit(SAMPLE_DOCS).select(text_col)

    def work(batch: pa.RecordBatch) -> dict:
        return {"raw": pa.array([serialized(x, end) for x in encode(path, batch.column(0).to_pylist())], pa.binary())}

    raw = [bytes(r[0]) for r in arrow_task(sample, "raw binary", work).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, raw).as_bytes()
    except zstandard.ZstdError:
        return b"".join(raw)[:DICTIONARY_BYTES]


def write_tokens(docs: DataFrame, path: str, folder: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, each document ended by `end`, below `folder` in ascending order of the id.

    A null text is an empty one: its document holds only the end id. Rows with a
    null id come first. Repeated ids stand together, ordered by a hash of their
    text. Ids above 65,535 widen only their own document. An empty table gives a
    folder without blocks. Columns other than the two are not looked at.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    docs = columns_of(docs, id_col, text_col).withColumn(text_col, F.coalesce(text_col, F.lit("")))
    dictionary = train_dictionary(docs, path, id_col, text_col, end)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary))], "dict_sha256 string, dictionary binary").write.parquet(f"{folder}/dictionary")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.withColumn("__h", F.xxhash64(text_col)).repartitionByRange(parts, id_col, "__h").sortWithinPartitions(id_col, "__h", text_col)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        part, block, start, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            frames = [f for _, f, _ in held]
            row = {"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int64()), "start_in_part": pa.array([start], pa.int64()),
                   "doc_ids": pa.array([[i for i, _, _ in held]], pa.list_(ids_type)), "n_tokens": pa.array([[n for _, _, n in held]], pa.list_(pa.int64())),
                   "offsets": pa.array([np.cumsum([0, *map(len, frames)])], pa.list_(pa.int64())), "dict_sha256": pa.array([sha]),
                   "payload": pa.array([b"".join(frames)], pa.binary())}
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        for batch in batches:
            ids_type = batch.schema.field(0).type
            for doc, found in zip(batch.column(0).to_pylist(), encode(path, batch.column(1).to_pylist()), strict=True):
                raw = serialized(found, end)
                held.append((doc, packer.compress(raw), (len(raw) - 1) // raw[0]))
                size += len(held[-1][1])
                if len(held) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield flush()
                    start += sum(n for _, _, n in held)
                    block, held, size = block + 1, [], 0
        if held:
            yield flush()

    schema = f"part int, block long, start_in_part long, doc_ids array<{kind}>, n_tokens array<long>, offsets array<long>, dict_sha256 string, payload binary"
    ordered.select(id_col, text_col).mapInArrow(pack, schema).write.option("compression", "none").parquet(f"{folder}/blocks")


def dictionaries(spark: SparkSession, folder: str) -> dict[str, bytes]:
    """The dictionary of a folder by its hash: one of at most DICTIONARY_BYTES."""
    found = {r[0]: bytes(r[1]) for r in spark.read.parquet(f"{folder}/dictionary").collect()}
    for sha, raw in found.items():
        if hashlib.sha256(raw).hexdigest() != sha:
            raise ValueError(f"the dictionary in {folder} is not the one with the hash {sha}")
    return found


def unpack(row: dict, known: dict[str, bytes]) -> Iterator[np.ndarray]:
    """The ids of a block's documents, one frame at a time."""
    raw = known[row["dict_sha256"]]
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    payload = row["payload"]
    for a, b in zip(row["offsets"], row["offsets"][1:]):
        yield deserialized(unpacker.decompress(payload[a:b]))


def read_documents(spark: SparkSession, folder: str, doc_ids: list | None = None) -> DataFrame:
    """`doc_id` and `ids` of all documents, or of some: other blocks are skipped and other frames stay compressed."""
    known = dictionaries(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    if doc_ids is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(x) for x in doc_ids]).cast(f"array<{kind}>")))
    wanted = None if doc_ids is None else set(doc_ids)

    def work(batch: pa.RecordBatch) -> dict:
        docs, ids = [], []
        for row in batch.to_pylist():
            raw = known[row["dict_sha256"]]
            unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
            for doc, a, b in zip(row["doc_ids"], row["offsets"], row["offsets"][1:]):
                if wanted is None or doc in wanted:
                    docs.append(doc)
                    ids.append(deserialized(unpacker.decompress(row["payload"][a:b])))
        return {"doc_id": pa.array(docs, batch.schema.field("doc_ids").type.value_type), "ids": pa.array(ids, pa.list_(pa.int64()))}

    return arrow_task(blocks, f"doc_id {kind}, ids array<long>", work)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """From the files, per document: doc_id, `start` (ids before it), `n_tokens`, `ids_crc32` over its ids as 32 bits each."""
    known = dictionaries(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        part, docs, starts, counts, sums = [], [], [], [], []
        for row in batch.to_pylist():
            at = row["start_in_part"]
            for doc, ids in zip(row["doc_ids"], unpack(row, known), strict=True):
                part.append(row["part"])
                docs.append(doc)
                starts.append(at)
                counts.append(len(ids))
                sums.append(zlib.crc32(ids.tobytes()))
                at += len(ids)
        return {"part": pa.array(part, pa.int32()), "doc_id": pa.array(docs, batch.schema.field("doc_ids").type.value_type),
                "start_in_part": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}

    rows = arrow_task(blocks, f"part int, doc_id {kind}, start_in_part long, n_tokens long, ids_crc32 long", work)
    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)
    ends = blocks.groupBy("part").agg(F.sum(size).alias("tokens")).withColumn("one", F.lit(0))
    before = checkpointed(sums_before(ends, ["one"], ["part"], "tokens", "before").select("part", "before"))  # a row per file
    joined = rows.join(before, "part")
    return joined.select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """Write `docs` with `write_tokens` into the shared folder and return `read_index` of the files."""
    folder = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, folder, end)
    return read_index(docs.sparkSession, folder)
