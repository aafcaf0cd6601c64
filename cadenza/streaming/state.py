"""Reading what the attribution stream keeps: waiting feedback, known intents, timers.

Spark's ``statestore`` source reads the state of a checkpoint as tables, without the
stream running, and as of an older micro-batch too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, checkpoint: str, batch_id: int | None, **options: str) -> DataFrame:
    reader = spark.read.format("statestore").options(**options)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint)


def _rows(spark: SparkSession, checkpoint: str, batch_id: int | None, name: str, *columns: str) -> DataFrame:
    """The rows of a table that the buckets keep in pieces."""
    pieces = _read(spark, checkpoint, batch_id, stateVarName=name).select("key._bucket", "list_element.*")
    return pieces.select("_bucket", F.inline(F.arrays_zip(*columns)))


def waiting_feedback(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """Feedback that waits for a response: per request, time and kind, with its count."""
    columns = ("requestId", "feedbackTime", "feedbackType", "times")
    return _rows(spark, checkpoint, batch_id, "waiting", *columns).drop("_bucket")


def known_intents(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """The last intent of each request."""
    return _rows(spark, checkpoint, batch_id, "intent", "requestId", "intentType", "intentGroup").drop("_bucket")


def registered_timers(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """When the waiting feedback of each request is dropped (milliseconds of wall clock).

    A bucket has one timer for all requests that began to wait in the same micro-batch.
    """
    rows = _read(spark, checkpoint, batch_id, readRegisteredTimers="true")
    timers = rows.select("key._bucket", F.col("expiration_timestamp_ms").alias("at")).distinct()
    waits = _rows(spark, checkpoint, batch_id, "waiting", "requestId", "until").withColumnRenamed("until", "at")
    return waits.distinct().join(timers, ["_bucket", "at"]).select("requestId", "at")


def operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stateful operators of a checkpoint, with their number of partitions."""
    rows = spark.read.format("state-metadata").load(checkpoint)
    return rows.select("operatorId", "operatorName", "stateStoreName", "numPartitions", "minBatchId", "maxBatchId").distinct()
