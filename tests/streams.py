"""Feed a stream file by file and read back what it emitted."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def write_in_order(spark: SparkSession, batches: list[DataFrame], path: str) -> None:
    """One file per batch; modification times give the order."""
    for i, batch in enumerate(batches):
        if i:
            time.sleep(1.05)
        batch.coalesce(1).write.mode("append").parquet(path)


def run(
    spark: SparkSession,
    source: str,
    schema,
    build: Callable[[DataFrame], DataFrame],
    work: str,
    no_data_batches: bool = True,
) -> DataFrame:
    """Run ``build`` over all files, one per micro-batch, and return its rows.

    With processing-time timers a query always has another empty batch to run, so
    a run that should end turns those off.
    """
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(no_data_batches).lower())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = build(stream)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out/batch_id={batch_id}")

    query = (
        out.writeStream.outputMode("append")
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    assert query.awaitTermination(180)
    return (
        spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(f"{work}/out")
    )
