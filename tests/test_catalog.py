from __future__ import annotations

import oracle
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from cadenza import catalog_stores, catalog_streams
from cadenza.catalog import catalog
from cadenza.catalog_sql import oracles

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = oracle.connect(SMALL)
    yield connection
    connection.close()


def test_queries_and_sql_match():
    assert set(oracles()) == set(catalog())
    assert set(oracle_sql()) <= set(queries()) and set(catalog()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracles()))
def test_agrees_with_sql(spark, con, name):
    assert oracle.compare(catalog()[name](spark, SMALL), con, oracles()[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0


#: queries that write and read tables; what they return is the plan of a read, seen by their own tests
STORED = set(catalog_stores.SQL) | set(catalog_streams.SQL)


@pytest.mark.parametrize("name", sorted(set(catalog()) - STORED))
def test_plans_hold_at_scale(spark, name):
    """No cross joins, no broadcast of everything, no Python unless that is the point."""
    df = catalog()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan
    if name != "geocode_resolver":
        assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["song_hot_10s", "singer_hot_10s"])
def test_play_filter_reaches_the_aggregate_input(spark, tmp_path, name):
    from cadenza.operators import windows
    from cadenza.schemas import SONG_PLAY_WIDE

    path = str(tmp_path / "wide")
    spark.createDataFrame([], SONG_PLAY_WIDE).write.parquet(path)
    wide = spark.read.parquet(path)
    stats = windows.song_hot(wide) if name.startswith("song") else windows.singer_hot(wide)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(action,play)" in plan


def test_region_logins_compare_text_only_among_adcodes(spark):
    df = catalog()["region_login_10s"](spark, SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert all("struct" in line for line in plan.splitlines() if "SortAggregate" in line)


def test_a_small_configuration_has_a_known_size(spark):
    from cadenza.operators import changes

    rows = spark.sparkContext.parallelize([(i, "x") for i in range(20)]).toDF("a long, b string")
    assert changes.with_known_size(rows, 10) is rows
    local = changes.with_known_size(rows, 20)
    assert sorted(local.collect()) == sorted(rows.collect())
    assert "LocalTableScan" in local._jdf.queryExecution().executedPlan().toString()
