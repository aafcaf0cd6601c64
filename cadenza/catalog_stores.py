"""Named queries over tables that a query writes, changes and reads back, with their SQL.

Each one takes whole star-schema tables through a store in several steps (batches,
versions, compactions) below a fresh folder, and returns what its readers see then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.catalog import _logins, _plays, _regions, _songs, query
from cadenza.catalog_sql import _CHANGES, _FEEDBACK_KIND, _MACHINES, _text, plain_oracles as _plain
from cadenza.operators import answers, assistant, boards, changes, decode, distinct, enrich, windows
from cadenza.plans import heat
from cadenza.plans import stand_ins as S
from cadenza.schemas import ROUTING_CONFIG, record
from cadenza.session import run_dir
from cadenza.sources.dimensions import DimensionStore
from cadenza.sources.serving import ServingTable
from cadenza.sources.tables import read_config

SQL: dict[str, str] = {}

# --- dimensions ----------------------------------------------------------------

_MACHINE = "DIM_MACHINE_LOCAL_INFO"


def _two_sources(spark: SparkSession, consume: str, machine: str) -> DataFrame:
    """Both source tables feed one dimension, each with its own columns."""
    return spark.createDataFrame(
        [
            ("consume_detail", "music", "dim", "mid", consume, _MACHINE, "dwd_dim_info_rt"),
            ("machine_info", "music", "dim", "mid", machine, _MACHINE, "dwd_dim_info_rt"),
        ],
        ROUTING_CONFIG,
    )


def _apply(store: DimensionStore, messages: DataFrame, config: DataFrame, batch_id: int) -> None:
    routed = changes.route_changes(changes.parse_changes(messages), changes.latest_config(config))
    store.apply(changes.last_of_each_source(changes.applicable(routed)), config, batch_id)


@query
def dim_store_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension fed by two tables in batches that come in the wrong order.

    Every batch has changes of all times; it is merged while half of them are in.
    """
    store = DimensionStore(spark, run_dir(spark, "dim-store"))
    messages = S.change_messages(S.table(spark, sf_dir, "orders"))
    config = _two_sources(spark, "amount", "action_time, note")
    for batch_id, part in enumerate((2, 0, 3, 1)):
        _apply(store, messages.filter(F.col("seq.o_orderkey") % 4 == part), config, batch_id)
        if batch_id == 1:
            store.compact(_MACHINE, least=2)
    return store.read(_MACHINE)


@query
def dim_store_column_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of both source tables grow; older rows have no value in the new columns."""
    store = DimensionStore(spark, run_dir(spark, "dim-columns"))
    messages = S.change_messages(S.table(spark, sf_dir, "orders"))
    early = F.col("seq.o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    _apply(store, messages.filter(early), _two_sources(spark, "amount", "action_time"), 0)
    store.compact(_MACHINE, least=1)
    _apply(store, messages.filter(~early), _two_sources(spark, "amount, id", "action_time,note"), 1)
    store.expire(_MACHINE, keep=1)
    return store.read(_MACHINE)


def _dimension_sql(columns: dict[str, tuple[str, str]]) -> str:
    """Last value of each column (name -> value, who carries it) after the last deletion."""
    newest = ", ".join(
        f"max_by({value}, seq) FILTER (kind <> 'delete' AND seq > gone AND ({carried})) AS {name}"
        for name, (value, carried) in columns.items()
    )
    return f"""WITH {_CHANGES},
log AS (
  SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM changes WHERE tbl <> 'audit'),
marked AS (
  SELECT *, coalesce(max(seq) FILTER (kind = 'delete') OVER (PARTITION BY o_custkey), 0) AS gone FROM log)
SELECT CAST(o_custkey AS VARCHAR) AS mid, {newest}
FROM marked GROUP BY o_custkey HAVING count(*) FILTER (kind <> 'delete' AND seq > gone) > 0"""


_LATER = "o_orderdate >= TIMESTAMP '1996-01-01'"
SQL["dim_store_out_of_order"] = _dimension_sql({
    "amount": ("CAST(cents AS VARCHAR)", "tbl = 'consume_detail'"),
    "action_time": (_text("o_orderdate"), "tbl = 'machine_info'"),
    "note": ("''", "tbl = 'machine_info'"),
})
SQL["dim_store_column_change"] = _dimension_sql({
    "amount": ("CAST(cents AS VARCHAR)", "tbl = 'consume_detail'"),
    "action_time": (_text("o_orderdate"), "tbl = 'machine_info'"),
    "id": ("CAST(o_orderkey AS VARCHAR)", f"tbl = 'consume_detail' AND {_LATER}"),
    "note": ("''", f"tbl = 'machine_info' AND {_LATER}"),
})

# --- distinct users ---------------------------------------------------------------


def _login_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-second parts as a table, appended in two steps that overlap."""
    wide = enrich.add_region(_logins(spark, sf_dir), _regions(spark, sf_dir))
    path = run_dir(spark, "login-parts")
    for part in (F.col("userId") % 3 != 0, F.col("userId") % 3 != 1):
        distinct.login_parts(wide.filter(part)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query
def region_login_rollup_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of an hour, merged from stored ten-second parts."""
    return distinct.login_totals(_login_parts(spark, sf_dir), "1 hour")


@query
def region_login_rollup_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a day, from the same stored table and without the log."""
    return distinct.login_totals(_login_parts(spark, sf_dir), "1 day")


SQL["region_login_rollup_1h"] = _plain()["region_login_1h"]
SQL["region_login_rollup_1d"] = _plain()["region_login_wide_1d"]

# --- serving ------------------------------------------------------------------------


def _served(spark: SparkSession, stats: DataFrame, table: str, batches: int = 6) -> ServingTable:
    """Windows written in micro-batches, of which half are then compacted."""
    served = ServingTable(spark, run_dir(spark, table))
    rows = windows.to_serving(stats, table).persist()
    try:
        part = F.pmod(F.xxhash64("window_start"), F.lit(batches))
        for batch_id in range(batches):
            served.write(rows.filter(part == batch_id), batch_id)
            if batch_id == batches // 2:
                served.compact(least=2)
    finally:
        rows.unpersist()
    return served


@query
def serving_store_top_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board of the newest window, read from a stored serving table."""
    stats = heat.song_heat(_plays(spark, sf_dir), _songs(spark, sf_dir), "1 day")
    return boards.best(_served(spark, stats, "dm_song_hot_10s").newest_window(), boards.SONG_BOARD)


@query
def serving_store_top_singers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = heat.singer_heat(_plays(spark, sf_dir), _songs(spark, sf_dir), "1 day")
    return boards.best(_served(spark, stats, "dm_singer_hot_10s").newest_window(), boards.SINGER_BOARD)


@query
def serving_store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a stored serving table after writes, a compaction and an expiry."""
    stats = heat.singer_heat(_plays(spark, sf_dir), _songs(spark, sf_dir))
    served = _served(spark, stats, "dm_singer_hot_10s")
    served.compact(least=3)
    served.expire(keep=1)
    return served.read()


SQL["serving_store_top_songs"] = _plain()["serving_top_songs"]
SQL["serving_store_top_singers"] = _plain()["serving_top_singers"]
SQL["serving_store_rows"] = _plain()["dm_singer_hot_10s"]

# --- configuration, rates and records from stored tables ---------------------------------


@query
def cdc_config_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing by a configuration table that changes between two reads.

    The first read knows one source table only; the second has both, with the wrong
    older row of the first one still there.
    """
    path = run_dir(spark, "config")
    whole = S.routing_config(spark)
    messages = S.change_messages(S.table(spark, sf_dir, "orders"))

    def counts(step: int) -> DataFrame:
        config = changes.with_known_size(changes.latest_config(read_config(spark, path)))
        routed = changes.route_changes(changes.parse_changes(messages), config)
        return routed.groupBy("table", "sink_topic").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(step))

    early = whole.filter("tbl_name = 'consume_detail'").withColumn("sink_topic", F.lit("a_topic"))
    early.select(*ROUTING_CONFIG.names).write.mode("append").parquet(path)
    first_path = run_dir(spark, "config-counts")
    counts(1).write.parquet(first_path)
    whole.select(*ROUTING_CONFIG.names).write.mode("append").parquet(path)
    return spark.read.parquet(first_path).unionByName(counts(2))


SQL["cdc_config_table"] = f"""WITH {_CHANGES}
SELECT tbl AS "table", 'a_topic' AS sink_topic, count(*) AS n, 1 AS step
FROM changes WHERE tbl = 'consume_detail' GROUP BY tbl
UNION ALL
SELECT tbl, CASE tbl WHEN 'consume_detail' THEN 'dwd_machine_consume_detail_rt' ELSE 'dwd_dim_info_rt' END, count(*), 2
FROM changes WHERE tbl <> 'audit' GROUP BY tbl"""


@query
def machine_admin_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consume rows with their machine's place, name, package and rates."""
    customer = S.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    balance = F.col("c_acctbal").cast("string")
    admin = customer.filter(key % 5 != 0).select(
        key.cast("string").alias("machine_num"), F.col("c_name").alias("machine_name"),
        F.col("c_mktsegment").alias("package_name"),
        F.when(key % 3 == 0, F.lit("n/a")).otherwise(balance).alias("inv_rate"),
        balance.alias("age_rate"), F.lit("0.25").alias("com_rate"), F.lit(None).cast("string").alias("par_rate"),
    )
    machines = S.machines(customer, S.table(spark, sf_dir, "nation"), S.table(spark, sf_dir, "region"))
    consume = enrich.valid_consume(S.consume(S.table(spark, sf_dir, "orders")))
    return enrich.add_machine(consume.select("id", "mid", "amount"), machines, admin)


SQL["machine_admin_rates"] = f"""WITH {_MACHINES}
SELECT o_orderkey AS id, o_custkey AS mid, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, province, city,
       c_name AS "machineName", c_mktsegment AS "packageName",
       CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_acctbal AS DOUBLE) END AS "invRate",
       CAST(c_acctbal AS DOUBLE) AS "ageRate",
       CASE WHEN c_custkey IS NOT NULL THEN CAST(0.25 AS DOUBLE) END AS "comRate", CAST(NULL AS DOUBLE) AS "parRate"
FROM orders LEFT JOIN machines ON o_custkey = mid
LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 5 <> 0
WHERE o_orderstatus = 'O'"""


@query
def wide_plays_reparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide plays as a topic's JSON messages, read back with the fields that heat needs."""
    wide = enrich.add_song(_plays(spark, sf_dir), _songs(spark, sf_dir))
    path = run_dir(spark, "wide-topic")
    decode.to_json_value(wide).write.text(path)
    narrow = record(songId="S", songName="S", action="S", timestamp="L")
    rows = decode.parse_records(spark.read.schema("value string").text(path), narrow)
    return windows.song_hot(rows, "1 hour")


SQL["wide_plays_reparsed"] = _plain()["song_hot_1h"]


@query
def ai_feedback_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback requests checked, sent as log messages, and flattened from the log."""
    requests = S.feedback(S.table(spark, sf_dir, "lineitem")).withColumn(
        "sessionId", F.when(F.col("userId") % 4 != 0, F.col("sessionId")).otherwise(" ")
    )
    good = requests.withColumn("reason", answers.feedback_request_reason()).filter("reason is null")
    path = run_dir(spark, "feedback-log")
    answers.feedback_events(good, F.col("eventId"), F.col("feedbackTime")).write.text(path)
    split = assistant.split_assistant_log(spark.read.schema("value string").text(path))
    return assistant.feedback_branch(split).select("eventId", "requestId", "userId", "feedbackType", "feedbackTime")


SQL["ai_feedback_branch"] = f"""
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS "eventId", CAST(l_orderkey AS VARCHAR) AS "requestId",
       CAST(l_suppkey AS BIGINT) AS "userId", {_FEEDBACK_KIND} AS "feedbackType", {_text("l_shipdate")} AS "feedbackTime"
FROM lineitem WHERE l_suppkey % 4 <> 0"""
