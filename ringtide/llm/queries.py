"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, extract, knn, language, licenses, merkle, mixing, neardup, negatives, ngram_join, quality, reshard, tokens

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under its name."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written with a shared dictionary and read back."""
    return tokens.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents, as hashes."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; cutoffs certified on the labels, per language on record."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model of three quarters of those with a language on record."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out().alias("held_out"))
    model = language.fit(docs.where(~docs["held_out"]))
    return language.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors for every hundredth vector."""
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from 16 shards into 24 of equal bytes."""
    return reshard.shard_digest(table(spark, sf_dir, "documents"))


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document when its source is mixed by the square root of its size."""
    placed = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return placed.select("doc_id", "source", F.col("__block").alias("block"), F.col("__phase").alias("phase"), F.col("__slot").alias("slot"), F.col("__at").alias("position"))


@query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return extract.extract(pages, extract.fit_pages(pages))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; each seventh has its label moved on."""
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(moved, F.col("vec_id") % 100 == 0)


@query
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document under links of similarity 0.80 or more."""
    return ngram_join.join_classes(table(spark, sf_dir, "documents"))


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and check of every document; those whose id has a CRC-32 that three divides are tampered with."""
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.third())


ORACLES["op1_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM r WHERE place <= 10
"""

_GRID = ", ".join(f"('{name}', {i}, {cut}::DOUBLE)" for name, cuts in quality.RATIOS.items() for i, cut in enumerate(cuts))
_RISK = quality.Risk()
_SHARE = _RISK.share / len(quality.RATIOS)

ORACLES["op6_quality"] = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
win AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS win FROM starts),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM win GROUP BY doc_id, win HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
f AS (
  SELECT doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbols,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS lines,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeats FROM f),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
grid(ratio, step, cut) AS (VALUES {_GRID}),
tests AS (
  SELECT lang, ratio, step, cut, count(*) AS n,
    count(*) FILTER (WHERE CASE ratio WHEN 'symbols' THEN symbols WHEN 'lines' THEN lines ELSE repeats END > cut) AS k
  FROM b, grid WHERE NOT base_failed AND doc_id IN (FROM good) GROUP BY lang, ratio, step, cut),
terms AS (SELECT lang, ratio, step, n, unnest(range(0, k + 1)) AS i FROM tests),
tails AS (
  SELECT lang, ratio, step, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE}))) AS p
  FROM terms GROUP BY lang, ratio, step),
passed AS (
  SELECT t.*, coalesce(k < n * {_SHARE} AND p <= {1 - _RISK.confidence} / ({len(quality.RATIOS)} * (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM tests)), false) AS ok
  FROM tests t JOIN tails s ON t.lang IS NOT DISTINCT FROM s.lang AND t.ratio = s.ratio AND t.step = s.step),
held AS (SELECT *, min(ok) OVER (PARTITION BY lang, ratio ORDER BY step) AS held FROM passed),
cuts AS (
  SELECT lang, min(cut) FILTER (WHERE ratio = 'symbols') AS cut_symbols, min(cut) FILTER (WHERE ratio = 'lines') AS cut_lines,
    min(cut) FILTER (WHERE ratio = 'repeats') AS cut_repeats FROM held WHERE held GROUP BY lang)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, cut_symbols, cut_lines, cut_repeats, base_failed,
  NOT (base_failed OR coalesce(symbols > cut_symbols, false) OR coalesce(lines > cut_lines, false) OR coalesce(repeats > cut_repeats, false)) AS kept
FROM b LEFT JOIN cuts ON b.lang IS NOT DISTINCT FROM cuts.lang
"""

ORACLES["op8_near_duplicates"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(words, i, i + 4) AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id, w.doc_id <= coalesce(least.b, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.a = w.doc_id
"""

ORACLES["op13_manifest"] = """
WITH RECURSIVE bytes AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, lang, text, 'x' || coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
    coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, bytes),
l AS (
  SELECT doc_id, lang, sha256(substr(head, 2) || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(substr(head, 2) || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered FROM d),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM l),
up AS (
  SELECT 0 AS level, grp, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, grp, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY level, grp, idx // 8, n),
tops AS (SELECT grp, h AS subroot, count(*) OVER () AS n FROM up WHERE n = 1),
high AS (
  SELECT 0 AS level, grp AS idx, n, subroot AS h FROM tops
  UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, idx // 8, n),
every AS (
  SELECT 0 AS part, grp, level, idx, h FROM up WHERE n > 1
  UNION ALL SELECT 1, NULL, level, idx, h FROM high WHERE n > 1),
steps AS (
  SELECT e.part, e.level, e.grp, e.idx, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (WHERE s.idx < e.idx), '') AS a,
    coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (WHERE s.idx > e.idx), '') AS z
  FROM every e JOIN every s ON e.part = s.part AND e.level = s.level AND e.grp IS NOT DISTINCT FROM s.grp AND e.idx // 8 = s.idx // 8 GROUP BY ALL),
path AS (
  SELECT l.doc_id, l.grp, l.idx, row_number() OVER (PARTITION BY l.grp, l.idx ORDER BY s.part, s.level) AS step, a, z
  FROM leaves l JOIN steps s ON (s.part = 0 AND s.grp = l.grp AND s.idx = l.idx // (8 ** s.level)::BIGINT) OR (s.part = 1 AND s.idx = l.grp // (8 ** s.level)::BIGINT)),
folded AS (
  SELECT grp, idx, 0 AS step, coalesce(tampered, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.grp, f.idx, f.step + 1, sha256(a || f.h || z) FROM folded f JOIN path p ON p.grp = f.grp AND p.idx = f.idx AND p.step = f.step + 1),
proofs AS (SELECT grp, idx, sha256(string_agg(a || z, '' ORDER BY step)) AS proof FROM path GROUP BY grp, idx),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT l.doc_id, l.leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN tops USING (grp) CROSS JOIN root LEFT JOIN proofs p ON p.grp = l.grp AND p.idx = l.idx
JOIN (SELECT grp, idx, max_by(h, step) AS h FROM folded GROUP BY grp, idx) f ON f.grp = l.grp AND f.idx = l.idx
"""

ORACLES["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (
  SELECT s.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY s.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM s JOIN p ON p.anchor_id = s.anchor_id AND p.place <= 5 WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 5
"""

ORACLES["op12_ngram_join"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(words, i, i + 4) AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.a = w.doc_id
"""
