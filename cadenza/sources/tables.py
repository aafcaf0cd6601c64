"""Tables: routing configuration, JDBC in and out, and serving tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.fixed_values import JDBC_BATCH_SIZE
from cadenza.schemas import ROUTING_CONFIG
from cadenza.sources.files import write_batch

CONFIG_TABLE = "config_info"
BatchSink = Callable[[DataFrame, int], None]


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Routing configuration from files; read anew it shows later changes."""
    return spark.read.schema(ROUTING_CONFIG).parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None,
    partition_column: str | None = None, bounds: tuple[int, int] | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A database table; with a numeric ``partition_column`` read in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.options(**(properties or {}))
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.load()


def read_config_jdbc(
    spark: SparkSession, url: str, properties: dict[str, str] | None = None
) -> DataFrame:
    return read_jdbc(spark, url, CONFIG_TABLE, properties).select(*ROUTING_CONFIG.names)


def jdbc_sink(
    url: str, table: str, properties: dict[str, str] | None = None,
    batch_size: int = JDBC_BATCH_SIZE,
) -> BatchSink:
    """Append each micro-batch to a database table (at-least-once)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        del batch_id
        writer = batch.write.format("jdbc").option("url", url).option("dbtable", table)
        writer.options(**(properties or {})).option("batchsize", batch_size).mode("append").save()

    return write


def table_sink(path: str) -> BatchSink:
    """Append each micro-batch to a parquet table, exactly once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return write


def read_table(spark: SparkSession, path: str, schema, stream: bool = False) -> DataFrame:
    """A table written by :func:`table_sink`, as a table or as a stream of its batches."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).option("recursiveFileLookup", "true").parquet(path)
