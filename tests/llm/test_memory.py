"""What tasks hold at once: batches that go to Python, and written rows of megabytes."""

from __future__ import annotations

import glob
import os

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cadenza.llm import bm25, common, jaccard, nearest
from cadenza.session import shared_dir


@pytest.fixture()
def unbounded(spark):
    """The session without a bound of its own, as a query may find it."""
    spark.conf.unset(common.BATCH_KEY)
    yield
    spark.conf.unset(common.BATCH_KEY)


def sent(rows):
    """Characters of each batch of texts that Python gets."""

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [int(batch["text"].str.len().sum())]})

    return [r["n"] for r in rows.select("text").mapInPandas(sizes, "n long").collect()]


def long_texts(spark, path):
    text = F.repeat(F.concat(F.col("id").cast("string"), F.lit(" words ")), 12_000)
    spark.range(200, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(path)


def test_long_texts_go_to_python_by_few(spark, unbounded, tmp_path):
    long_texts(spark, f"{tmp_path}/documents.parquet")
    found = sent(common.table(spark, str(tmp_path), "documents").coalesce(1))
    assert sum(found) > 3 * common.BATCH_BYTES and max(found) <= 1.1 * common.BATCH_BYTES
    spark.conf.unset(common.BATCH_KEY)
    found = sent(common.materialize(spark.read.parquet(f"{tmp_path}/documents.parquet"), "long-texts").coalesce(1))
    assert sum(found) > 3 * common.BATCH_BYTES and max(found) <= 1.1 * common.BATCH_BYTES


def test_a_bound_of_the_session_stays(spark, unbounded):
    for bound in ("64k", "512m"):
        spark.conf.set(common.BATCH_KEY, bound)
        common.bounded_batches(spark)
        assert spark.conf.get(common.BATCH_KEY) == bound


def groups_of(spark, name):
    """Rows of each row group of the newest table of this name."""
    root = shared_dir(spark).removeprefix("file://")
    newest = max(glob.glob(f"{root}/{name}-*"), key=os.path.getmtime)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{newest}/*.parquet")]
    return [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]


def test_packed_indexes_are_not_read_many_at_once(spark, monkeypatch):
    monkeypatch.setitem(common.LARGE_ROWS, "parquet.block.size", "1024")
    rows = [(i, " ".join(f"w{i * j % 977}" for j in range(200))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert len(bm25.search(docs, docs.where("doc_id = 20"), shard_words=400).collect()) == 10
    groups = groups_of(spark, "bm25-index")
    assert sum(groups) == 20 and max(groups) == 1
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)], "vec_id long, embedding array<double>")
    assert nearest.nearest(vectors.coalesce(1), F.col("vec_id") == 20, shard=20).count() == 20
    groups = groups_of(spark, "vantage-points")
    assert sum(groups) >= 20 and max(groups) == 1


def test_counted_chunks_are_let_go(spark, monkeypatch):
    """A chunk counts once, whether it is full or the last."""
    docs = spark.createDataFrame([(f"a b c d e {i % 3}",) for i in range(30)], "body string").coalesce(1)
    whole = jaccard.frequent(docs, 3)
    shingles, texts = whole
    assert sorted(texts.tolist()) == [10, 10, 10, 30, 30, 30]
    monkeypatch.setattr(jaccard, "CHUNK", 40)  # ten texts of four shingles
    again = jaccard.frequent(docs, 3)
    assert (again[0] == shingles).all() and sorted(again[1].tolist())[-3:] == [30, 30, 30]
