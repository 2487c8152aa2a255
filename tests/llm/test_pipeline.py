"""The stages one after another on the smallest tables."""

import math

import corpus_pipeline
from ringtide.llm import mixing, neardup, quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "MinHash near-dedup", "mixing sources", "BPE"]
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    good = {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert {r.doc_id for r in first.collect()} == good < before
    classes = neardup.near_duplicates(first)
    kept = {r.doc_id for r in classes.where("kept").collect()}
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = [r.doc_id for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == kept  # every text has a language here
    # rows come in the order that the mixing stage gave them
    sources = {r.doc_id: "null" if r.source is None else f"s{r.source}" for r in docs.collect()}
    order = [sources[d] for d in found]
    rows = {s: order.count(s) for s in set(order)}
    slots = {slot: (s, k) for slot, s, k, _ in mixing.schedule({s: math.ceil(n / 32) for s, n in rows.items()}, mixing.square_roots(rows))}
    assert order == [s for _, (s, k) in sorted(slots.items()) for _ in range(min(32, rows[s] - 32 * k))]
