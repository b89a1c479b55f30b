from __future__ import annotations

from collections import Counter

import public_tokenizers
from oracle import DATA
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        assert docs.columns == columns, name
        rows = docs.collect()
        assert rows and all(r == before[r["doc_id"]] for r in rows), name
        if name == "exact_dedup":
            assert len({r["text"] for r in rows}) == len(rows)
        if name == "mixing":
            assert max(Counter(r["doc_id"] for r in rows).values()) <= 3
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert sum(r["length"] for r in packed) == total
    assert len({r["sequence_id"] for r in packed}) <= 1.02 * total / 2048 + 1


def test_run_agrees_with_itself(spark):
    one, two = (sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, DATA).collect()) for _ in range(2))
    assert one == two and one


def test_clean_documents_stay(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, DATA).collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").join(docs, "doc_id").collect()}
    assert len(good & kept) >= 0.95 * len(good)


def test_stages_on_odd_tables(spark, irregular, empty):
    """Nulls, repeated rows and ids, clashing column names, and no rows at all."""
    for docs in (irregular[0], empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() > 0) == (not docs.isEmpty())
