"""The warehouse as streaming jobs.

A line of business is cut once, at its wide table.  Before the cut a micro-batch is
decoded, split, enriched from the newest dimension snapshots and written to its
tables; after it a stateful query aggregates windows into the serving table.  All
writes are keyed by the batch id, so replays after a lost executor or driver
change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cadenza import schemas
from cadenza.fixed_values import TOPICS, WATERMARK_DELAY, WINDOW_LENGTH
from cadenza.operators import (
    answers, assistant, boards, changes, decode, distinct, enrich, geocode, user_log, windows,
)
from cadenza.session import configured_dir
from cadenza.sources.dimensions import DimensionStore, Snapshots
from cadenza.sources import files
from cadenza.sources.files import write_batch
from cadenza.sources.places import PlaceStore
from cadenza.sources.serving import ServingTable, serving_sink
from cadenza.sources.tables import BatchSink, read_table, table_sink
from cadenza.sources.topics import FolderTopics, KafkaTopics
from cadenza.streaming.attribution import intent_deltas
from cadenza.streaming.late import LateRows

Topics = FolderTopics | KafkaTopics

#: jobs that do not start at the newest messages
DEFAULT_START = {"assistant_log": "earliest"}

#: tables between the two halves of each line
WIDE_TABLES: dict[str, T.StructType] = {
    "dwm_song_play": schemas.SONG_PLAY_WIDE,
    "dwm_login": schemas.LOGIN_WIDE,
    "dwm_consume": schemas.CONSUME_WIDE,
    "dwm_ai_response": schemas.AI_RESPONSE_WIDE,
    "dwd_ai_feedback": schemas.AI_FEEDBACK,
    "ai_intent_delta": schemas.INTENT_DELTA,
}


@contextmanager
def _kept(batch: DataFrame) -> Iterator[DataFrame]:
    """Keep a micro-batch while its branches are written (it is spilled, not lost)."""
    held = batch.persist()
    try:
        yield held
    finally:
        held.unpersist()


@dataclass(frozen=True)
class Warehouse:
    """Where a deployment reads and writes, and how its streams are paced."""

    spark: SparkSession
    root: str
    topics: Topics
    config: Callable[[SparkSession], DataFrame] | None = None
    trigger: Mapping[str, object] = field(default_factory=lambda: {"processingTime": "10 seconds"})
    max_files_per_trigger: int | None = None
    #: layers also published as JSON messages to their topic
    publish: frozenset[str] = frozenset()
    sinks: Mapping[str, BatchSink] = field(default_factory=dict)
    #: where a job's topic starts if it has no checkpoint yet: ``latest`` or ``earliest``
    starting: Mapping[str, str] = field(default_factory=dict)
    #: keep resolved places, so that later micro-batches do not ask for them again
    keep_places: bool = False
    #: let ``latest`` hold for folder topics: files that are there at a job's first start are left out
    mark_folders: bool = False
    _snapshots: Snapshots = field(default_factory=Snapshots, compare=False, repr=False)

    def path(self, table: str) -> str:
        return f"{self.root}/tables/{table}"

    @property
    def dimensions(self) -> DimensionStore:
        return DimensionStore(self.spark, f"{self.root}/dimensions")

    @property
    def places(self) -> PlaceStore:
        return PlaceStore(DimensionStore(self.spark, f"{self.root}/places"))

    def serving(self, table: str) -> ServingTable:
        return ServingTable(self.spark, self.path(table))

    def snapshot(self, table: str, schema: T.StructType) -> DataFrame:
        """The newest version of a dimension, read anew only when it has changed."""
        return self._snapshots.get(self.dimensions, table, schema)

    def checkpoint(self, name: str) -> str:
        """Where a stream keeps its progress and state.

        Below the cluster's shared folder if it names one; warehouses of
        different roots never share it.
        """
        shared = configured_dir(self.spark)
        if shared is None:
            return f"{self.root}/streams/{name}"
        return f"{shared}/streams/{hashlib.md5(self.root.encode()).hexdigest()}/{name}"

    def read(self, table: str, stream: bool = False) -> DataFrame:
        schema = WIDE_TABLES[table]
        if not stream:
            return read_table(self.spark, self.path(table), schema)
        reader = self.spark.readStream.schema(schema).option("recursiveFileLookup", "true")
        if self.max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.max_files_per_trigger)
        return reader.parquet(self.path(table))

    def messages(self, topic: str, job: str) -> DataFrame:
        """The stream of a raw topic, from where the job starts."""
        mode = self.starting.get(job, DEFAULT_START.get(job, "latest"))
        topics = self.topics
        if self.mark_folders and isinstance(topics, FolderTopics):
            topics = replace(topics, mark=f"{self.checkpoint(job)}.start")
        return topics.read(self.spark, TOPICS.get(topic, topic), mode)

    def write(self, rows: DataFrame, layer: str, batch_id: int) -> None:
        """One layer of a micro-batch: its table, and its topic if published."""
        write_batch(rows, self.path(layer), batch_id)
        if layer in self.publish:
            self.topics.write_batch(decode.to_json_value(rows), batch_id, TOPICS[layer])

    def start(
        self, stream: DataFrame, name: str, each: BatchSink, mode: str = "append"
    ) -> StreamingQuery:
        return (
            stream.writeStream.queryName(name)
            .outputMode(mode)
            .option("checkpointLocation", self.checkpoint(name))
            .trigger(**self.trigger)
            .foreachBatch(each)
            .start()
        )

    def serve(self, stats: DataFrame, table: str) -> StreamingQuery:
        """Window results into a serving table (one with a manifest unless told otherwise)."""
        sink = self.sinks.get(table) or serving_sink(self.serving(table))
        return self.start(windows.to_serving(stats, table), table, sink)


# --- first halves: raw messages to wide tables -------------------------------

def user_log_job(
    wh: Warehouse,
    regions: Callable[[SparkSession], DataFrame] | None = None,
    resolver: geocode.Resolver | None = None,
) -> StreamingQuery:
    """User log to plays, other operations, logins; plays and logins enriched.

    Logins get their region from a grid table, or else from a geocoder that is
    asked once for each place of a micro-batch, or with ``Warehouse.keep_places`` once
    for good.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bad = decode.undecodable_messages(batch.select("value"))
        wh.write(bad, "quarantine_user_log_messages", batch_id)
        with _kept(user_log.split_user_log(decode.decode_events(batch.select("value")))) as split:
            wh.write(user_log.quarantined(split), "quarantine_user_log", batch_id)
            wh.write(user_log.other_branch(split), "dwd_other", batch_id)
            plays = user_log.play_branch(split)
            wh.write(plays, "dwd_play", batch_id)
            songs = wh.snapshot(changes.SONG_DIMENSION, schemas.DIM_SONG)
            wh.write(enrich.add_song(plays, songs), "dwm_song_play", batch_id)
            logins = user_log.login_branch(split)
            wh.write(logins, "dwd_login", batch_id)
            if regions is not None:
                wh.write(enrich.add_region(logins, regions(spark)), "dwm_login", batch_id)
            elif resolver is not None:
                found = wh.places.resolve(logins, resolver, batch_id) if wh.keep_places else geocode.resolve_regions(logins, resolver)
                with _kept(found) as resolved:
                    wh.write(resolved, "dwm_login", batch_id)
                    wh.write(geocode.unresolved(resolved), "quarantine_geocode", batch_id)

    return wh.start(wh.messages("ods_user_log", "user_log"), "user_log", each)


CONSUME_TOPIC = TOPICS["dwd_consume"]
DIMENSION_TOPIC = TOPICS["dwd_dimension"]


def change_log_job(wh: Warehouse) -> StreamingQuery:
    """Change log to its topics, to dimension snapshots and to wide consume rows.

    The configuration is read anew for each micro-batch.
    """
    if wh.config is None:
        raise ValueError("the change log needs a routing configuration")
    read_config = wh.config

    def each(batch: DataFrame, batch_id: int) -> None:
        config = changes.with_known_size(changes.latest_config(read_config(batch.sparkSession)))
        wh.write(changes.without_data(batch).drop("seq"), "quarantine_changes", batch_id)
        ordered = wh.topics.ordered(batch)
        routed = changes.route_changes(changes.parse_changes(ordered), config)
        with _kept(routed) as rows:
            wh.topics.write_batch(changes.with_topic(rows), batch_id)
            wh.write(
                changes.without_topic(rows).select("database", "table", "type", "reason"),
                "quarantine_routes", batch_id,
            )
            to_dimensions = changes.applicable(rows.filter(F.col("sink_topic") == DIMENSION_TOPIC))
            with _kept(changes.last_of_each_source(to_dimensions)) as latest:
                wh.dimensions.apply(latest, config, batch_id)
            consume = changes.with_topic(rows.filter(F.col("sink_topic") == CONSUME_TOPIC))
            machines = wh.snapshot("DIM_MACHINE_LOCAL_INFO", schemas.DIM_MACHINE_LOCAL_INFO)
            wide = enrich.consume_wide(enrich.parse_consume(consume), machines)
            wh.write(wide, "dwm_consume", batch_id)

    return wh.start(wh.messages("ods_changes", "change_log"), "change_log", each)


def assistant_log_job(wh: Warehouse) -> StreamingQuery:
    """Assistant log to queries, responses, feedback; responses widened."""

    def each(batch: DataFrame, batch_id: int) -> None:
        with _kept(assistant.split_assistant_log(batch.select("value"))) as split:
            wh.write(assistant.quarantined(split), "quarantine_assistant", batch_id)
            wh.write(assistant.query_branch(split), "dwd_ai_query", batch_id)
            responses = assistant.response_branch(split)
            wh.write(responses, "dwd_ai_response", batch_id)
            wh.write(assistant.widen_responses(responses), "dwm_ai_response", batch_id)
            wh.write(assistant.feedback_branch(split), "dwd_ai_feedback", batch_id)

    return wh.start(wh.messages("ods_assistant", "assistant_log"), "assistant_log", each)


# --- second halves: wide tables to serving tables ----------------------------

def song_hot_job(wh: Warehouse, length: str = WINDOW_LENGTH) -> StreamingQuery:
    stats = windows.song_hot(wh.read("dwm_song_play", stream=True), length, WATERMARK_DELAY)
    return wh.serve(stats, "dm_song_hot_10s")


def singer_hot_job(wh: Warehouse, length: str = WINDOW_LENGTH) -> StreamingQuery:
    stats = windows.singer_hot(wh.read("dwm_song_play", stream=True), length, WATERMARK_DELAY)
    return wh.serve(stats, "dm_singer_hot_10s")


def region_login_job(wh: Warehouse, length: str = WINDOW_LENGTH) -> StreamingQuery:
    stats = windows.region_login(wh.read("dwm_login", stream=True), length, WATERMARK_DELAY)
    return wh.serve(stats, "dm_region_user_login_10s")


def region_revenue_job(wh: Warehouse, length: str = WINDOW_LENGTH) -> StreamingQuery:
    stats = windows.region_revenue(wh.read("dwm_consume", stream=True), length, WATERMARK_DELAY)
    return wh.serve(stats, "dm_region_revenue_10s")


def ai_overview_job(wh: Warehouse, length: str = WINDOW_LENGTH) -> StreamingQuery:
    stats = windows.ai_overview(
        wh.read("dwm_ai_response", stream=True), wh.read("dwd_ai_feedback", stream=True),
        length, WATERMARK_DELAY,
    )
    return wh.serve(stats, "dm_ai_overview_10s")


def ai_intent_delta_job(wh: Warehouse, **options) -> StreamingQuery:
    """Responses and attributed feedback as metric deltas (stateful)."""
    deltas = intent_deltas(
        wh.read("dwm_ai_response", stream=True), wh.read("dwd_ai_feedback", stream=True), **options
    )
    return wh.start(deltas, "ai_intent_delta", table_sink(wh.path("ai_intent_delta")))


def ai_intent_job(wh: Warehouse, length: str = WINDOW_LENGTH) -> StreamingQuery:
    """Deltas to windows: the watermark is set after attribution."""
    stats = windows.ai_intent(wh.read("ai_intent_delta", stream=True), length, WATERMARK_DELAY)
    return wh.serve(stats, "dm_ai_intent_10s")


def compact_dimensions(wh: Warehouse, least: int = 8, keep: int = 3) -> list[str]:
    """A job beside the streams: merge the changes of each dimension, drop old versions."""
    store = wh.dimensions
    done = [t for t in files.folders(wh.spark, store.root) if store.compact(t, least)]
    for table in done:
        store.expire(table, keep)
    return done


def compact_serving(wh: Warehouse, least: int = 100, keep: int = 3) -> dict[str, list[str]]:
    """The same for serving tables: dates with many small segments get one."""
    done = {}
    for name in (*windows.SERVING_TABLES, LOGIN_PARTS):
        if dates := wh.serving(name).compact(least):
            wh.serving(name).expire(keep)
            done[name] = dates
    return done


def late_play_job(wh: Warehouse, length: str = WINDOW_LENGTH) -> StreamingQuery:
    """Beside :func:`song_hot_job`: plays whose window earlier micro-batches had closed."""
    plays = windows.play_times(wh.read("dwm_song_play", stream=True))
    seconds = pd.Timedelta(WATERMARK_DELAY).total_seconds()
    return wh.start(plays, "late_plays", LateRows(wh.spark, wh.path("late_plays"), length, seconds).each)


# --- answering -----------------------------------------------------------------

#: folder or topic of the requests that clients send
REQUESTS = "ai_requests"
REQUEST = schemas.record(
    requestId="S", sessionId="S", userId="L", queryText="S", feedbackType="S", sentAt="S"
)


def _board(wh: Warehouse, table: str, names: dict[str, str]) -> DataFrame:
    """The newest board of a serving table; an empty one if nothing was served yet."""
    served = wh.serving(table)
    if served.log.versions():
        return boards.best(served.newest_window(), names)
    schema = "windowStart string, windowEnd string, " + ", ".join(f"{n} string" for n in names.values()) + ", playCount bigint"
    return wh.spark.createDataFrame([], schema)


def answer_job(wh: Warehouse) -> StreamingQuery:
    """Requests to answers, and both to the raw assistant log.

    A request is JSON (:data:`REQUEST`): a question, or feedback on an earlier one if it
    has a ``feedbackType``.  The boards are those of the moment of the micro-batch.  Ids
    of log messages come from the request's content, and a micro-batch is written to the
    log once, so a replay adds nothing.  Refused requests are set aside with the reason.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        given = F.from_json("value", REQUEST)
        with _kept(batch.select("value", given.alias("r")).select("value", "r.*")) as rows:
            is_feedback = F.col("feedbackType").isNotNull()
            questions = rows.filter(~is_feedback).withColumn("reason", answers.query_request_reason())
            feedback = rows.filter(is_feedback).withColumn("reason", answers.feedback_request_reason())
            refused = questions.unionByName(feedback).filter("reason is not null")
            wh.write(refused.select("value", "reason"), "quarantine_requests", batch_id)
            good = questions.filter("reason is null")
            seed = F.concat_ws("-", "userId", "sentAt", "queryText")
            request = F.when(F.coalesce(F.trim("requestId"), F.lit("")) == "", F.md5(seed)).otherwise(F.col("requestId"))
            asked = answers.classify(answers.with_session(good.withColumn("requestId", request), seed))
            answered = answers.answer(
                asked, _board(wh, "dm_song_hot_10s", boards.SONG_BOARD), _board(wh, "dm_singer_hot_10s", boards.SINGER_BOARD)
            ).withColumn("latencyMs", F.lit(0).cast("bigint"))
            at = F.col("sentAt")

            def event(kind: str):
                return F.md5(F.concat_ws("-", F.lit(kind), "requestId", "userId", "sentAt"))

            log = answers.query_events(asked, event("query"), at).unionByName(
                answers.response_events(answered, event("response"), at)
            ).unionByName(answers.feedback_events(feedback.filter("reason is null"), event("feedback"), at))
            wh.topics.write_batch(log, batch_id, TOPICS["ods_assistant"])
            texts = ("requestId", "sessionId", "userId", "intentType", "answerText", "success")
            wh.write(answered.select(*texts), "answers", batch_id)

    return wh.start(wh.messages(REQUESTS, "answers"), "answers", each)


# --- distinct users without state ------------------------------------------------

LOGIN_PARTS = "dws_region_login_parts"


def region_login_parts_job(wh: Warehouse, length: str = WINDOW_LENGTH) -> StreamingQuery:
    """Logins to mergeable parts of distinct users, a stream without state or watermark.

    Parts of a window may come in any number of micro-batches, late ones too; they are
    merged when they are read (:func:`region_logins`).
    """
    end = F.col("window_start") + F.expr(f"interval {length}")

    def each(batch: DataFrame, batch_id: int) -> None:
        parts = distinct.login_parts(batch, length).withColumn("window_end", end)
        wh.serving(LOGIN_PARTS).write(parts, batch_id)

    return wh.start(wh.read("dwm_login", stream=True), LOGIN_PARTS, each)


def region_logins(wh: Warehouse, length: str) -> DataFrame:
    """Region logins per window of ``length``, from the stored parts of shorter windows."""
    return distinct.login_totals(wh.serving(LOGIN_PARTS).read(), length)
