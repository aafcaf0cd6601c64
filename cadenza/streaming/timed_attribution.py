"""Attribution of feedback on streams in event time, without a task per request.

:mod:`cadenza.streaming.attribution` lets the order of arrival decide and keeps the
state of a request in one task.  Here event time decides, as in the batch form, and a
request may hold any part of the rows: every micro-batch is a few Spark jobs over
(request, time bucket), and what is kept between micro-batches are tables:

* ``open``: seconds that later rows may still change, first and last response of each
  and the counts of its feedback.  Its size follows ``delay`` and ``wait``.
* ``carry``: the last response of each request before those, one row a request, in a
  bucketed :class:`~cadenza.sources.dimensions.DimensionStore`; a micro-batch adds
  only the requests that it closes.

A feedback second is decided once no response within ``wait`` after it can come any
more, that is when the watermark (the greatest time seen, less ``delay``) is ``wait``
past it.  Rows at or before what is closed already are late: they are set aside with
the reason, and counted.  A replayed micro-batch finds its tables written and adds
nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.fixed_values import PENDING_FEEDBACK_MINUTES
from cadenza.functions.once import evaluated_once
from cadenza.functions.time import local_text_to_timestamp
from cadenza.operators.attribution import INTENT, seconds_in_reach
from cadenza.operators.windows import valid_feedback
from cadenza.sources import files, manifests
from cadenza.sources.dimensions import DimensionStore
from cadenza.sources.files import write_batch
from cadenza.sources.manifests import Manifests

CARRY = "carry"
_CARRIED = ("at", "tie", *INTENT)
_RESPONSE = "struct<at: bigint, tie: string, intentType: string, intentGroup: string>"
_OPEN = f"requestId string, _at bigint, _first {_RESPONSE}, _last {_RESPONSE}, feedbackTime string, feedbackType string, times bigint"


def arrivals(responses: DataFrame, feedback: DataFrame, tie: str = "eventId") -> DataFrame:
    """Both inputs as one: ``requestId, _at`` and a response, or a feedback time and kind."""
    at = {"_at": F.unix_seconds(local_text_to_timestamp(F.col("_when")))}
    answered = responses.dropna(subset=["requestId", "responseTime", *INTENT]).select(
        "requestId", F.col("responseTime").alias("_when"), F.coalesce(F.col(tie), F.lit("")).alias("tie"), *INTENT
    )
    given = valid_feedback(feedback).select(
        "requestId", F.col("feedbackTime").alias("_when"), "feedbackTime", "feedbackType"
    )
    both = evaluated_once(answered.unionByName(given, allowMissingColumns=True), at).filter("_at is not null")
    return both.drop("_when")


def _combined(rows: DataFrame) -> DataFrame:
    """New rows as open ones: one per (request, second), and one per (request, time, kind)."""
    answered, given = rows.filter("feedbackType is null"), rows.filter("feedbackType is not null")
    one = F.struct(F.col("_at").alias("at"), "tie", *INTENT)
    per_second = answered.groupBy("requestId", "_at").agg(F.min(one).alias("_first"), F.max(one).alias("_last"))
    counts = given.groupBy("requestId", "_at", "feedbackTime", "feedbackType").agg(F.count(F.lit(1)).alias("times"))
    return per_second.unionByName(counts, allowMissingColumns=True)


def _merged(rows: DataFrame) -> DataFrame:
    """Open rows of several micro-batches, again one each."""
    answered, given = rows.filter("feedbackType is null"), rows.filter("feedbackType is not null")
    per_second = answered.groupBy("requestId", "_at").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    counts = given.groupBy("requestId", "_at", "feedbackTime", "feedbackType").agg(F.sum("times").alias("times"))
    return per_second.unionByName(counts, allowMissingColumns=True)


@dataclass(frozen=True)
class TimedAttribution:
    """The tables of one attribution stream below ``root``."""

    spark: SparkSession
    root: str
    delay_seconds: int
    wait_seconds: int = PENDING_FEEDBACK_MINUTES * 60
    bucket_seconds: int = 3600
    #: segments of the carry table after which it is merged
    compact_after: int = 16

    @property
    def log(self) -> Manifests:
        return Manifests(self.spark, self.root)

    @property
    def carry(self) -> DimensionStore:
        return DimensionStore(self.spark, f"{self.root}/state")

    @property
    def output(self) -> str:
        return f"{self.root}/attributed"

    @property
    def late(self) -> str:
        return f"{self.root}/late"

    def state(self) -> dict:
        """What is closed, the greatest time seen, the open rows and how many rows were late."""
        return self.log.load() or {"closed": None, "seen": None, "open": None, "late": 0, "applied": {}}

    def waiting(self) -> DataFrame:
        """Feedback that is not decided yet: per request, time and kind, with its count."""
        rows = self._open(self.state()).filter("feedbackType is not null")
        return rows.select("requestId", "feedbackTime", "feedbackType", "times")

    def _open(self, state: dict) -> DataFrame:
        if state["open"] is None:
            return self.spark.createDataFrame([], _OPEN)
        return self.spark.read.schema(_OPEN).parquet(f"{self.root}/_open={state['open']}")

    def each(self, batch: DataFrame, batch_id: int) -> None:
        """A micro-batch of :func:`arrivals`."""
        run, segment = manifests.batch_of(self.spark, batch_id)
        state = self.state()
        if manifests.is_applied(state, run, batch_id):
            return
        batch = batch.persist()
        try:
            if state["closed"] is None:
                on_time, late = batch, 0
            else:
                too_late = F.col("_at") <= state["closed"]
                on_time = batch.filter(~too_late)
                late = batch.filter(too_late).count()
                if late:
                    write_batch(batch.filter(too_late).withColumn("reason", F.lit("late")), self.late, batch_id)
            seen = on_time.agg(F.max("_at")).first()[0]
            seen = max((s for s in (seen, state["seen"]) if s is not None), default=None)
            closed = None if seen is None else seen - self.delay_seconds - self.wait_seconds
            if closed is not None and state["closed"] is not None:
                closed = max(closed, state["closed"])
            rows = _merged(self._open(state).unionByName(_combined(on_time).select(*_names())))
            rows = rows.persist()
            try:
                if closed is not None:
                    self._decide(rows, closed, batch_id)
                left = rows if closed is None else rows.filter(F.col("_at") > closed)
                left.write.mode("overwrite").parquet(f"{self.root}/_open={segment}")
            finally:
                rows.unpersist()
        finally:
            batch.unpersist()
        new = {"closed": closed, "seen": seen, "open": segment, "late": state["late"] + late}
        self.log.commit(lambda old: {**new, "applied": manifests.with_applied(old or state, run, batch_id)})
        self.carry.compact(CARRY, self.compact_after)
        self.log.expire(2, lambda m: {m["open"]}, "_open")

    def _decide(self, rows: DataFrame, closed: int, batch_id: int) -> None:
        """Write the feedback up to ``closed`` with its intents; carry the last responses on."""
        due = rows.filter((F.col("_at") <= closed) & F.col("feedbackType").isNotNull())
        answered = rows.filter(F.col("feedbackType").isNull()).select("requestId", "_at", "_first", "_last")
        # a response that may still be missing lies after what feedback that is due can reach
        known = answered.filter(F.col("_at") <= closed + self.wait_seconds)
        if self.carry.versions(CARRY):
            asked = due.select("requestId").distinct()
            carried = self.carry.read(CARRY).join(asked, "requestId", "left_semi")
            last = F.struct(F.col("at").cast("bigint").alias("at"), "tie", *INTENT)
            known = known.unionByName(
                carried.select("requestId", F.col("at").cast("bigint").alias("_at"), last.alias("_first"), last.alias("_last"))
            )
        chosen = seconds_in_reach(
            known, due.select("requestId", "_at").distinct(), self.wait_seconds, self.bucket_seconds
        )
        decided = due.select("requestId", "_at", "feedbackTime", "feedbackType", "times").join(chosen, ["requestId", "_at"])
        write_batch(decided.drop("_at"), self.output, batch_id)
        closing = answered.filter(F.col("_at") <= closed).groupBy("requestId").agg(F.max("_last").alias("last"))
        data = F.create_map(*[x for c in _CARRIED for x in (F.lit(c), F.col("last")[c].cast("string"))])
        latest = closing.select(
            F.lit(CARRY).alias("phoenix_table_name"), F.col("requestId").alias("pk"), F.lit("update").alias("type"),
            F.lit(",".join(_CARRIED)).alias("cols"), data.alias("data"), F.col("last.at").alias("seq"),
        )
        config = self.spark.createDataFrame(
            [(CARRY, "requestId", ",".join(_CARRIED))], "phoenix_tbl_name string, pk_col string, cols string"
        )
        self.carry.apply(latest, config, batch_id)

    def read(self) -> DataFrame:
        """Decided feedback, counted per request, time and kind, with its intent."""
        schema = "requestId string, feedbackTime string, feedbackType string, times bigint, intentType string, intentGroup string"
        if not files.exists(self.spark, self.output):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.output)


def _names() -> list[str]:
    return ["requestId", "_at", "_first", "_last", "feedbackTime", "feedbackType", "times"]
