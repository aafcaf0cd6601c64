"""Nearest neighbours against brute force."""

from __future__ import annotations

import math

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from cadenza.llm import nearest

SCHEMA = "vec_id long, embedding array<double>, rank int, score string, v int"


def by_hand(rows, k):
    """(query_id, rank, vec_id, score) of rows of (id, vector)."""
    fine = [
        (i, tuple(float(x) for x in v)) for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = []
    for at, (i, q) in enumerate(fine):
        if i is None or i % 20:
            continue
        others = [
            (-float((np.array(q) * np.array(v)).sum()), j is None, j or 0, j)
            for other, (j, v) in enumerate(fine) if other != at and len(v) == len(q)
        ]
        out += [(i, n, j, -s) for n, (s, _, _, j) in enumerate(sorted(others, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=lambda r: (r[0], r[1], repr(r)))


def found(spark, rows, k, **options):
    df = spark.createDataFrame([(i, v, 5, "s", 6) for i, v in rows], SCHEMA).repartition(3)
    got = nearest.nearest(df, F.col("vec_id") % 20 == 0, k=k, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[1], repr(r)))


def test_small_whole_numbers_with_ties_copies_and_unusable_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(400)]
    rows += [(i, [1.0, 2.0, 0.0, -1.0]) for i in range(400, 520)]
    rows += [(None, [1.0, 2.0, 0.0, -1.0])] * 2 + [(40, [1.0, 2.0, 0.0, -1.0]), (40, [3.0, 0.0, 0.0, 0.0]), (60, rows[60][1])]
    rows += [(600, None), (620, []), (640, [0.0, -0.0, 0.0, 0.0]), (660, [1.0, None, 0.0, 1.0]), (680, [float("nan"), 1.0, 1.0, 1.0]), (700, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(720, [1.0, 2.0]), (721, [2.0, 1.0]), (740, [7.0] * 7), (760, [100.0, 0.0, -0.0, 50.0])]
    for options in ({}, {"shard": 64}):
        assert found(spark, rows, 5, **options) == by_hand(rows, 5)


def test_fewer_candidates_than_asked_and_empty_tables(spark):
    rows = [(i, [float(i), 1.0]) for i in range(18, 24)]
    assert found(spark, rows, 20) == by_hand(rows, 20)
    assert len(found(spark, rows, 20)) == 5
    assert found(spark, [(20, [1.0, 1.0])], 20) == []
    assert found(spark, [], 20) == []


def test_query_agrees_with_sql(spark, sf_dir):
    con = oracle.connect(sf_dir)
    assert oracle.compare(nearest.op13_nearest_vectors(spark, sf_dir), con, nearest.OP13_SQL) is None
    con.close()


def clusters(rng, n, width=16):
    centres = rng.normal(size=(20, width))
    points = centres[rng.integers(0, 20, n)] + 0.15 * rng.normal(size=(n, width))
    return points * rng.uniform(0.9, 1.1, (n, 1))


@pytest.mark.parametrize("factor, recall, share", [(1.0, 1.0, 0.6), (1.5, 0.97, 0.35), (2.5, 0.9, 0.25)])
def test_factor_trades_recall_for_fewer_comparisons(factor, recall, share):
    rng = np.random.default_rng(8)
    points = clusters(rng, 6000)
    most = float(np.sqrt((points**2).sum(1).max())) * (1 + 1e-12)
    tree = nearest.Tree.build(points, most, 32)
    queries = points[::60]
    search = nearest.Search(queries, 10, most, factor)
    search.visit(tree, tree.order, tree.order)
    true = np.argsort(-(queries @ points.T), axis=1)[:, :10]
    hit = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(true, search.point)])
    assert hit >= recall
    assert search.compared <= share * len(queries) * len(points)


def test_several_shards_with_a_factor(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(clusters(rng, 3000))]
    exact = found(spark, rows, 10, shard=200)
    assert exact == by_hand(rows, 10)
    near = found(spark, rows, 10, shard=200, factor=1.2)
    assert len(near) == len(exact)
    assert len({(r[0], r[2]) for r in near} & {(r[0], r[2]) for r in exact}) >= 0.9 * len(exact)


def test_shards_met_in_slices(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SLICE", 7)
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(clusters(rng, 800, 3))]
    assert found(spark, rows, 6, shard=100) == by_hand(rows, 6)
