"""The pipeline's stages against brute force on a small corpus."""

from __future__ import annotations

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from cadenza.llm import common, contamination


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = common.table(spark, sf_dir, "documents")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = common.materialize(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "mix":
            assert docs.columns == inputs[name].columns
    before = {r["doc_id"]: r["text"] for r in inputs["near_duplicates"].collect()}
    groups = brute.jaccard_components(list(before.items()), 5, 80)
    assert {i for i, (_, c) in groups.items() if c == i} == {r["doc_id"] for r in inputs["decontamination"].select("doc_id").collect()}
    items = [contamination.fold(r["text"]) for r in common.table(spark, sf_dir, "benchmark").collect()]
    kept = inputs["personal_data"].collect()
    assert not any(i in contamination.fold(r["text"]) for r in kept for i in items)
    dropped = {r["doc_id"] for r in inputs["decontamination"].collect()} - {r["doc_id"] for r in kept}
    assert dropped and all(any(i in contamination.fold(before[d]) for i in items) for d in dropped)
    clean = {r["doc_id"]: r for r in inputs["mix"].collect()}
    for r in kept:
        spans = brute.base_spans(r["text"], brute.PII, brute.is_pii)
        assert (clean[r["doc_id"]]["text"] == r["text"]) == (not spans)
        assert not brute.base_spans(clean[r["doc_id"]]["text"], brute.PII, brute.is_pii)
        assert clean[r["doc_id"]]["n_chars"] == len(clean[r["doc_id"]]["text"])
    assert docs.count() == len(kept) and docs.where(F.col("taken") > 3 * F.col("size")).count() == 0


def test_stages_on_nothing(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_registered():
    names = queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
