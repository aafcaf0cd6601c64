"""Late rows counted and set aside, and what each micro-batch of a query did.

Spark drops rows of windows that the watermark has passed and reports how many state
rows that were, after partial aggregation.  Two things make it visible:

* :class:`LateRows` is fed by a stream of its own beside an aggregate.  It keeps the greatest
  event time of the micro-batches before, and writes every row whose window they had
  closed to a table, with the reason; its counts are exact counts of rows.
* :class:`BatchMetrics` listens to all queries of a session and writes one small record
  per micro-batch: rows in, the watermark, state rows that it dropped, and whatever the
  query observes (:func:`observe_refusals`).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from cadenza.operators.windows import EVENT_TIME
from cadenza.sources import files, manifests
from cadenza.sources.files import write_batch
from cadenza.sources.manifests import Manifests

METRICS = (
    "query string, run string, batch long, rows_in long, watermark string, dropped_state_rows long, observed map<string,long>"
)


class BatchMetrics(StreamingQueryListener):
    """Writes a record per micro-batch below ``path``; add it to ``spark.streams``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        observed = {
            f"{name}.{key}": int(value)
            for name, row in (p.observedMetrics or {}).items()
            for key, value in row.asDict().items()
            if isinstance(value, int)
        }
        record = {
            "query": p.name, "run": str(p.id), "batch": p.batchId, "rows_in": p.numInputRows,
            "watermark": (p.eventTime or {}).get("watermark"),
            "dropped_state_rows": sum(s.numRowsDroppedByWatermark for s in p.stateOperators or ()),
            "observed": observed,
        }
        # progress of a batch without rows may be reported again under its number
        files.publish(self.spark, self.path, f"{p.id}-{p.batchId:012d}.json", json.dumps(record))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The records of :class:`BatchMetrics`."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], METRICS)
    return spark.read.schema(METRICS).json(path)


def observe_refusals(rows: DataFrame, name: str, reasons: dict[str, Column]) -> DataFrame:
    """``rows`` that count themselves, and those to which each reason applies."""
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in reasons.items()]
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), *counts)


@dataclass(frozen=True)
class LateRows:
    """Micro-batches of rows in event time, of which the late ones are set aside."""

    spark: SparkSession
    path: str
    length: str
    delay_seconds: float

    @property
    def log(self) -> Manifests:
        return Manifests(self.spark, f"{self.path}/state")

    def each(self, batch: DataFrame, batch_id: int) -> None:
        """Set the late rows of a micro-batch aside and note its counts.

        The observation counts while the late rows are written, so the micro-batch is
        read once.
        """
        run, _ = manifests.batch_of(self.spark, batch_id)
        state = self.log.load() or {"applied": {}, "seen": None}
        if manifests.is_applied(state, run, batch_id):
            return
        seen = state["seen"]
        closed = F.lit(False)
        if seen is not None:
            watermark = F.timestamp_micros(F.lit(seen - round(self.delay_seconds * 1e6)))
            closed = F.window(EVENT_TIME, self.length)["end"] <= watermark
        marked = batch.withColumn("_late", closed)
        measures = [
            F.count(F.lit(1)).alias("rows"), F.count_if("_late").alias("late"),
            F.max(F.unix_micros(F.col(EVENT_TIME))).alias("seen"),
        ]
        folder = f"{self.path}/rows"
        written = files.exists(self.spark, f"{folder}/{files.batch_name(self.spark, batch_id)}")
        counted = Observation()
        late = marked.observe(counted, *measures).filter("_late").drop("_late")
        write_batch(late.withColumn("reason", F.lit("window was closed")), folder, batch_id)
        # a replay that finds its rows written has not passed the observation
        got = marked.agg(*measures).first().asDict() if written else counted.get
        newest = max((s for s in (seen, got["seen"]) if s is not None), default=None)
        files.publish(
            self.spark, f"{self.path}/counts", f"{run}-{batch_id:012d}.json",
            json.dumps({"batch": batch_id, "rows": got["rows"], "late": got["late"]}),
        )
        self.log.commit(lambda old: {"seen": newest, "applied": manifests.with_applied(old or state, run, batch_id)})
        self.log.expire(2, lambda m: set(), "_segment")

    def counts(self) -> DataFrame:
        """Rows and late rows per micro-batch."""
        return self.spark.read.schema("batch long, rows long, late long").json(f"{self.path}/counts")

    def rows(self, schema: T.StructType) -> DataFrame:
        reader = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("reason", T.StringType())]))
        return reader.option("recursiveFileLookup", "true").parquet(f"{self.path}/rows")
