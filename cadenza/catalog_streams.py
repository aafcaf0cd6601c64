"""Named queries that run streams over several micro-batches, with their SQL.

A table is dealt into slices by event time, with some rows one slice late.  Each slice
is written beside the earlier ones and the stream is started again on its checkpoint;
as it takes all new files at once, a slice is one micro-batch, however many files it
has.  The result is what the stream has written, or keeps, after the last slice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.catalog import (
    _EMPTY_BATCHES, _STATE_PROVIDER, _machines, _songs, STAND_IN_WAIT, query,
)
from cadenza.catalog_sql import (
    _FEEDBACK_KIND, _bucket, _text, plain_oracles as _plain,
)
from cadenza.fixed_values import WATERMARK_DELAY
from cadenza.operators import enrich, windows
from cadenza.plans import stand_ins as S
from cadenza.session import DEFAULT_CONF, run_dir
from cadenza.sources.tables import table_sink
from cadenza.streaming import state
from cadenza.streaming.attribution import attribute_stream, intent_deltas
from cadenza.streaming.late import LateRows
from cadenza.streaming.timed_attribution import TimedAttribution, arrivals

SQL: dict[str, str] = {}

SLICES = 4
DAY = 86400


def _run(
    spark: SparkSession, work: str, slices: list[list[tuple[str, DataFrame]]],
    build: Callable[[Callable[[str], DataFrame]], DataFrame], each: Callable[[DataFrame, int], None],
    timers: bool = False,
) -> None:
    """Write the slices of the named sources one after another, and run the stream after each.

    With timers a query always has one more empty batch to run; those are turned off.
    """
    conf = {_STATE_PROVIDER: DEFAULT_CONF[_STATE_PROVIDER], _EMPTY_BATCHES: str(not timers).lower()}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        schemas = {}
        for slice_ in slices:
            for name, rows in slice_:
                schemas[name] = rows.schema
                rows.write.mode("append").parquet(f"{work}/in/{name}")

            def source(name: str) -> DataFrame:
                return spark.readStream.schema(schemas[name]).parquet(f"{work}/in/{name}")

            running = (
                build(source).writeStream.outputMode("append").option("checkpointLocation", f"{work}/checkpoint")
                .trigger(availableNow=True).foreachBatch(each).start()
            )
            running.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _written(spark: SparkSession, work: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{work}/table")


def _far(rows: DataFrame, time: str) -> DataFrame:
    """One row of the far future, which closes all windows and is in no result."""
    return rows.limit(1).withColumn(time, F.lit("2200-01-01").cast(rows.schema[time].dataType))


# --- windows over slices in order ----------------------------------------------


def _event_slice(late: Column | None = None) -> Column:
    """Slice of an event by its day of January 2024; ``late`` rows come with the next slice."""
    own = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(SLICES - 1))
    return own if late is None else F.when(late, F.least(own + 1, F.lit(SLICES - 1))).otherwise(own)


@query
def stream_singer_hot_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singer heat over four micro-batches in the order of time."""
    work = run_dir(spark, "singer-hot")
    events = S.table(spark, sf_dir, "events")
    slices = [[("events", events.filter(_event_slice() == i))] for i in range(SLICES)]
    slices.append([("events", _far(events.filter("event_type = 'view'"), "ts"))])
    songs = _songs(spark, sf_dir)
    shape = {}

    def build(source):
        wide = enrich.add_song(S.plays(source("events")), songs, "singerInfo")
        out = windows.singer_hot(wide, "1 hour", WATERMARK_DELAY)
        shape["schema"] = out.schema
        return out

    _run(spark, work, slices, build, table_sink(f"{work}/table"))
    return _written(spark, work, shape["schema"])


SQL["stream_singer_hot_1h"] = _plain()["singer_hot_1h"]


def _order_slice() -> Column:
    return F.least(F.greatest(F.floor((F.year("o_orderdate") - 1995) / 2), F.lit(0)), F.lit(SLICES - 1))


@query
def stream_region_revenue_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue over four micro-batches in the order of time."""
    work = run_dir(spark, "region-revenue")
    orders = S.table(spark, sf_dir, "orders")
    slices = [[("orders", orders.filter(_order_slice() == i))] for i in range(SLICES)]
    placed = orders.join(S.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    slices.append([("orders", _far(placed.filter("o_custkey % 11 <> 3 AND o_orderstatus = 'O'"), "o_orderdate"))])
    machines = _machines(spark, sf_dir)
    shape = {}

    def build(source):
        wide = enrich.consume_wide(S.consume(source("orders")), machines)
        out = windows.region_revenue(wide, "1 day", WATERMARK_DELAY)
        shape["schema"] = out.schema
        return out

    _run(spark, work, slices, build, table_sink(f"{work}/table"))
    return _written(spark, work, shape["schema"])


SQL["stream_region_revenue_1d"] = _plain()["region_revenue_1d"]

# --- late rows ---------------------------------------------------------------------


@query
def stream_late_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays per micro-batch, and how many of them came after their window was closed.

    One event in seven arrives with the slice after its own.
    """
    work = run_dir(spark, "late-plays")
    events = S.table(spark, sf_dir, "events")
    arrives = _event_slice(F.col("event_id") % 7 == 0)
    slices = [[("events", events.filter(arrives == i))] for i in range(SLICES)]
    late = LateRows(spark, f"{work}/late", "10 seconds", 3)
    _run(spark, work, slices, lambda source: windows.play_times(S.plays(source("events"))), late.each)
    written = spark.read.schema("songId string").option("recursiveFileLookup", "true").parquet(f"{work}/late/rows")
    return late.counts().withColumn("written", F.lit(written.count()))


SQL["stream_late_plays"] = f"""
WITH plays AS (
  SELECT event_id, date_trunc('second', ts) AS ts, least((day(ts) - 1) // 8, {SLICES - 1}) AS own
  FROM events WHERE event_type = 'view'),
arrived AS (
  SELECT ts, CASE WHEN event_id % 7 = 0 THEN least(own + 1, {SLICES - 1}) ELSE own END AS batch FROM plays),
marks AS (
  SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
         - INTERVAL '3 seconds' AS watermark
  FROM arrived GROUP BY batch),
counted AS (
  SELECT batch, count(*) AS rows,
         count(*) FILTER ({_bucket("10 seconds", "ts")} + INTERVAL '10 seconds' <= watermark) AS late
  FROM arrived JOIN marks USING (batch) GROUP BY batch)
SELECT *, CAST(sum(late) OVER () AS BIGINT) AS written FROM counted"""

# --- attribution ---------------------------------------------------------------------


def _hot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose request is the customer, but one request has a third of all."""
    hot = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey"))
    return S.table(spark, sf_dir, "orders").withColumn("request", hot)


#: what ``stand_ins.feedback`` reads of an item
_FEEDBACK_OF = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus",
)


def _hot_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = _hot_orders(spark, sf_dir).select("o_orderkey", "request")
    return S.table(spark, sf_dir, "lineitem").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def _time_slice(time: str, shuffled_by: str) -> Column:
    """Slices of two years; rows arrive up to 24 days after their time, so out of order."""
    arrival = F.date_add(F.col(time).cast("date"), (F.col(shuffled_by) % 5 * 6).cast("int"))
    return F.least(F.greatest(F.floor((F.year(arrival) - 1995) / 2), F.lit(0)), F.lit(SLICES - 1))


@query
def stream_timed_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time attribution over out-of-order micro-batches, a third of all in one request."""
    work = run_dir(spark, "timed-attribution")
    orders = _hot_orders(spark, sf_dir)
    # joined once for all slices, with the columns that feedback has
    items = _hot_items(spark, sf_dir).select(*_FEEDBACK_OF, "request").persist(StorageLevel.DISK_ONLY)
    slices = [
        [
            ("orders", orders.filter(_time_slice("o_orderdate", "o_orderkey") == i)),
            ("items", items.filter(_time_slice("l_shipdate", "l_partkey") == i)),
        ]
        for i in range(SLICES)
    ]
    slices.append([("orders", _far(orders, "o_orderdate"))])
    job = TimedAttribution(spark, f"{work}/attribution", 30 * DAY, STAND_IN_WAIT, 90 * DAY)
    try:
        _run(
            spark, work, slices,
            lambda source: arrivals(S.responses(source("orders"), "request"), S.feedback(source("items"), "request")),
            job.each,
        )
    finally:
        items.unpersist()
    return job.read().groupBy("requestId", "feedbackTime", "feedbackType", "intentType", "intentGroup").agg(
        F.sum("times").alias("times")
    )


SQL["stream_timed_attribution"] = f"""
WITH owned AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS request FROM orders),
seconds AS (
  SELECT request, o_orderdate AS ts,
         min(struct_pack(k := CAST(o_orderkey AS VARCHAR), t := o_orderpriority, g := 'group ' || o_orderstatus)) AS first,
         max(struct_pack(k := CAST(o_orderkey AS VARCHAR), t := o_orderpriority, g := 'group ' || o_orderstatus)) AS last
  FROM owned GROUP BY ALL),
feedback AS (
  SELECT request, l_shipdate AS fed_at, {_FEEDBACK_KIND} AS raw_kind FROM lineitem JOIN owned ON l_orderkey = o_orderkey),
before AS (
  SELECT f.*, b.last FROM feedback f ASOF LEFT JOIN seconds b ON f.request = b.request AND f.fed_at >= b.ts),
both_sides AS (
  SELECT f.request, f.fed_at, f.raw_kind, f.last, a.first, a.ts AS next_at
  FROM before f ASOF LEFT JOIN seconds a ON f.request = a.request AND f.fed_at < a.ts),
chosen AS (
  SELECT *, CASE WHEN last IS NOT NULL THEN last
                 WHEN next_at <= fed_at + INTERVAL '60 days' THEN first END AS c FROM both_sides)
SELECT CAST(request AS VARCHAR) AS "requestId", {_text("fed_at")} AS "feedbackTime", raw_kind AS "feedbackType",
       c.t AS "intentType", c.g AS "intentGroup", count(*) AS times
FROM chosen WHERE c IS NOT NULL GROUP BY ALL"""


@query
def stream_ai_intent_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent metrics end to end: attribution over four micro-batches, then windows of its deltas."""
    work = run_dir(spark, "ai-intent")
    orders, items = S.table(spark, sf_dir, "orders"), S.table(spark, sf_dir, "lineitem")
    own = F.least(F.greatest(F.floor((F.year("l_shipdate") - 1995) / 2), F.lit(0)), F.lit(SLICES - 1))
    slices = [[("orders", orders.filter(_order_slice() == i)), ("items", items.filter(own == i))] for i in range(SLICES)]
    shape = {}

    def deltas(source):
        out = intent_deltas(S.responses(source("orders")), S.feedback(source("items")), event_wait_seconds=STAND_IN_WAIT)
        shape["deltas"] = out.schema
        return out

    _run(spark, work, slices, deltas, table_sink(f"{work}/table"), timers=True)
    counted = _written(spark, work, shape["deltas"])
    end = counted.limit(1).withColumn("eventTime", F.lit("2200-01-01 00:00:00"))
    again = run_dir(spark, "ai-intent-windows")

    def intents(source):
        out = windows.ai_intent(source("deltas"), "1 day", WATERMARK_DELAY)
        shape["windows"] = out.schema
        return out

    _run(spark, again, [[("deltas", counted)], [("deltas", end)]], intents, table_sink(f"{again}/table"))
    return _written(spark, again, shape["windows"])


SQL["stream_ai_intent_1d"] = _plain()["ai_intent_1d"]


@query
def stream_waiting_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the attribution stream keeps waiting, read from its checkpoint, with its timers.

    Responses are there for even orders only; feedback comes in two micro-batches.
    """
    work = run_dir(spark, "waiting-state")
    orders, items = S.table(spark, sf_dir, "orders"), S.table(spark, sf_dir, "lineitem")
    slices = [
        [("orders", orders.filter("o_orderkey % 2 = 0")), ("items", items.filter("l_linenumber % 2 = 0"))],
        [("orders", orders.limit(0)), ("items", items.filter("l_linenumber % 2 = 1"))],
    ]
    _run(
        spark, work, slices,
        lambda source: attribute_stream(S.responses(source("orders")), S.feedback(source("items"))),
        table_sink(f"{work}/table"), timers=True,
    )
    timers = state.registered_timers(spark, f"{work}/checkpoint").groupBy("requestId").agg(F.count("at").alias("timers"))
    return state.waiting_feedback(spark, f"{work}/checkpoint").join(timers, "requestId", "left")


SQL["stream_waiting_state"] = f"""
SELECT CAST(l_orderkey AS VARCHAR) AS "requestId", {_text("l_shipdate")} AS "feedbackTime",
       {_FEEDBACK_KIND} AS "feedbackType", count(*) AS times, CAST(1 AS BIGINT) AS timers
FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 2 = 0)
GROUP BY ALL"""
