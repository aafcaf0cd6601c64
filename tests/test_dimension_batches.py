"""What a micro-batch costs a store of dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.schemas import ROUTING_CONFIG
from cadenza.sources.dimensions import DimensionStore


def test_the_changes_of_a_batch_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(name):
        made.add(1)
        return name

    rows = [(f"T{i % 2}", str(i), "update", "a", {"a": str(i)}, i) for i in range(40)]
    latest = spark.createDataFrame(
        rows, "phoenix_table_name string, pk string, type string, cols string, data map<string,string>, seq bigint"
    ).withColumn("phoenix_table_name", noted("phoenix_table_name"))
    config = spark.createDataFrame([(t, "d", "dim", "id", "a", t, "x") for t in ("T0", "T1", "T2")], ROUTING_CONFIG)
    store = DimensionStore(spark, str(tmp_path / "store"))
    assert store.apply(latest, config, 0) == ["T0", "T1"]
    assert made.value == 40
    assert sorted(r.a for r in store.read("T1").collect()) == sorted(str(i) for i in range(1, 40, 2))
