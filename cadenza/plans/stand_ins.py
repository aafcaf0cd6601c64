"""The warehouse's inputs derived from a star-schema data set.

Every frame is a row-by-row mapping of a whole table (``events``, ``orders``,
``lineitem``, ``part``, ``customer``, ``conversations``), so its size follows the
table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.fixed_values import AI_FEEDBACK, AI_QUERY, AI_RESPONSE, LOGIN_EVENT, SONG_EVENT
from cadenza.functions.once import evaluated_once
from cadenza.functions.time import date_of_millis, hour_of_millis, timestamp_to_text

#: events of one raw message
EVENTS_PER_MESSAGE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


# --- user log ----------------------------------------------------------------

def _operation() -> Column:
    return (
        F.when(F.col("event_type") == "view", 0)
        .when(F.col("event_type") == "click", 1)
        .when(F.col("event_type") == "error", 2)
    )


def _lng() -> Column:
    """Near the grid point of one of 25 places, always in the same cell."""
    place = F.col("user_id") % 25
    return (100 + place + (F.col("event_id") % 4) * F.lit(0.0001)).cast("decimal(9,4)")


def _lat() -> Column:
    place = F.col("user_id") % 25
    return (20 + place - (F.col("event_id") % 3) * F.lit(0.0001)).cast("decimal(9,4)")


def user_events(events: DataFrame) -> DataFrame:
    """Raw events as JSON text; some nested objects are sent as JSON strings."""
    content = F.struct(
        F.get_json_object("props", "$.k").alias("songid"),
        F.col("user_id").alias("uid"),
        _operation().alias("optrate_type"),
        F.when(F.col("event_id") % 5 == 0, F.col("user_id")).alias("mid"),
    )

    def song(nested: Column) -> Column:
        return F.to_json(
            F.struct(
                _text(F.floor(_millis("ts") / 1000)).alias("timestamp"),
                F.when(F.col("event_id") % 5 != 0, _text("user_id")).alias("mid"),
                F.lit(SONG_EVENT).alias("event_type"),
                nested.alias("event_content"),
            )
        )

    login = F.to_json(
        F.struct(
            _text("event_id").alias("event_id"),
            F.col("user_id").alias("uid"),
            F.lit(LOGIN_EVENT).alias("event_type"),
            _text(_lng()).alias("lng"),
            _text(_lat()).alias("lat"),
            _millis("ts").alias("login_dt"),
            F.col("user_id").alias("mid"),
        )
    )
    as_text = F.col("event_id") % 3 == 0
    return events.select(
        "event_id",
        F.when(F.col("event_type") == "signup", login)
        .when(as_text, song(F.to_json(content)))
        .otherwise(song(content))
        .alias("event"),
    )


def user_log_messages(events: DataFrame) -> DataFrame:
    """Raw events in Base64 messages of ``EVENTS_PER_MESSAGE``."""
    batches = user_events(events).groupBy(
        F.floor(F.col("event_id") / EVENTS_PER_MESSAGE).alias("message_id")
    ).agg(F.array_join(F.collect_list("event"), ",").alias("body"))
    text = F.concat(F.lit("["), F.col("body"), F.lit("]"))
    return batches.select("message_id", F.base64(F.encode(text, "UTF-8")).alias("value"))


def plays(events: DataFrame) -> DataFrame:
    """Clean rows of all song events (no raw text in between)."""
    operation = _operation()
    millis = F.floor(_millis("ts") / 1000) * 1000
    action = (
        F.when(operation == 0, "play").when(operation == 1, "pause")
        .when(operation == 2, "skip").otherwise("other")
    )
    return events.filter("event_type != 'signup'").select(
        F.col("user_id").alias("userId"),
        F.get_json_object("props", "$.k").alias("songId"),
        F.col("user_id").alias("machineId"),
        action.alias("action"),
        millis.alias("timestamp"),
        F.lit("").alias("ip"),
        F.lit("").alias("city"),
        date_of_millis(millis).alias("date"),
        hour_of_millis(millis).alias("hour"),
    )


def logins(events: DataFrame) -> DataFrame:
    millis = _millis("ts")
    return events.filter("event_type = 'signup'").select(
        _text("event_id").alias("eventId"),
        F.col("user_id").alias("userId"),
        F.lit(LOGIN_EVENT).alias("eventType"),
        _text(_lng()).alias("lng"),
        _text(_lat()).alias("lat"),
        millis.alias("loginDt"),
        F.col("user_id").alias("machineId"),
        date_of_millis(millis).alias("date"),
        hour_of_millis(millis).alias("hour"),
    )


#: Distance of the new keys of dimension rows that facts do not know.
MOVED = 1_000_000_000


# --- dimensions --------------------------------------------------------------

def songs(part: DataFrame) -> DataFrame:
    """Songs; every tenth one has moved to a new key, so that some look-ups find nothing."""
    key = F.col("p_partkey")
    return part.select(
        _text(F.when(key % 10 == 7, key + MOVED).otherwise(key)).alias("source_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("album"),
        F.col("p_brand").alias("singer_info"),
        _text("p_size").alias("post_time"),
        F.col("p_type").alias("authorized_company"),
    )


def machines(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Machines with province and city; every eleventh one has moved to a new key."""
    key = F.col("c_custkey")
    placed = customer.join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.select(
        _text(F.when(key % 11 == 3, key + MOVED).otherwise(key)).alias("mid"),
        F.col("r_name").alias("province"),
        F.col("n_name").alias("city"),
        F.lit("").alias("address"),
    )


def regions(nation: DataFrame, region: DataFrame, moved: bool = True) -> DataFrame:
    """Grid cells with their region; some have no adcode.

    With ``moved`` one place lies in a cell that no login has.
    """
    placed = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    cell = F.when((key == 7) & F.lit(moved), key + 400).otherwise(key)
    return placed.select(
        ((100 + cell) * 1000).cast("bigint").alias("lng_cell"),
        ((20 + cell) * 1000).cast("bigint").alias("lat_cell"),
        F.col("r_name").alias("province"),
        F.col("n_name").alias("city"),
        F.concat(F.lit("district "), _text(key % 5)).alias("district"),
        F.when(key % 6 != 0, F.concat(F.lit("ad"), _text(key))).alias("adcode"),
    )


# --- consume rows and change log ---------------------------------------------

def _change_type() -> Column:
    status = F.col("o_orderstatus")
    return F.when(status == "O", "insert").when(status == "F", "update").otherwise("delete")


def _cents() -> Column:
    return F.round(F.col("o_totalprice") * 100).cast("bigint")


def _order_time() -> Column:
    return F.col("_time")


def _timed(rows: DataFrame, ts: str) -> DataFrame:
    return evaluated_once(rows, {"_time": timestamp_to_text(F.col(ts))})


def consume(orders: DataFrame) -> DataFrame:
    """Consume rows, typed."""
    return _timed(orders, "o_orderdate").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("mid"),
        F.col("o_custkey").alias("uid"),
        _cents().alias("amount"),
        F.col("o_orderkey").cast("int").alias("pkgId"),
        F.col("o_orderpriority").alias("pkgName"),
        F.lit(None).cast("int").alias("activityId"),
        F.lit(None).cast("string").alias("activityName"),
        _order_time().alias("actionTime"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("billDate"),
        _change_type().alias("type"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"),
    )


def change_messages(orders: DataFrame) -> DataFrame:
    """Change log of two tables and some schema changes, as JSON with ``seq``.

    The data columns include one named ``type``, which routing overwrites.
    """
    kind = F.col("o_orderkey") % 10
    name = F.when(kind < 6, "consume_detail").when(kind < 9, "machine_info").otherwise("audit")
    data = F.struct(
        _text("o_orderkey").alias("id"),
        _text("o_custkey").alias("mid"),
        _text(_cents()).alias("amount"),
        _order_time().alias("action_time"),
        F.col("o_orderpriority").alias("type"),
    )
    message = F.struct(
        F.lit("music").alias("database"),
        name.alias("table"),
        _text(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("ts"),
        _change_type().alias("type"),
        F.when(F.col("o_orderkey") % 13 != 0, data).alias("data"),
    )
    return _timed(orders, "o_orderdate").select(
        F.struct("o_orderdate", "o_orderkey").alias("seq"), F.to_json(message).alias("value")
    )


def routing_config(spark: SparkSession) -> DataFrame:
    """Routing of the change log (a control table: a handful of rows)."""
    return spark.createDataFrame(
        [
            ("consume_detail", "music", "fact", "id", "mid,amount,action_time", "FACT_CONSUME",
             "dwd_machine_consume_detail_rt"),
            ("machine_info", "music", "dim", "mid", "amount, action_time, note",
             "DIM_MACHINE_LOCAL_INFO", "dwd_dim_info_rt"),
        ],
        "tbl_name string, tbl_db string, tbl_type string, pk_col string, cols string, "
        "phoenix_tbl_name string, sink_topic string",
    )


# --- assistant ---------------------------------------------------------------

def responses(orders: DataFrame, request: str = "o_orderkey") -> DataFrame:
    """Responses, flat; with ``request='o_custkey'`` requests have many of them."""
    key = F.col("o_orderkey")
    ids = F.transform(
        F.sequence(F.lit(1), (key % 4).cast("int")),
        lambda i: _text(F.col("o_custkey") + i),
    )
    names = F.when(key % 3 == 0, F.lit("[]")).when(key % 3 == 1, F.lit("")).otherwise(
        F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('"]'))
    )
    status = F.col("o_orderstatus")
    return _timed(orders, "o_orderdate").select(
        _text("o_orderkey").alias("eventId"),
        F.lit(AI_RESPONSE).alias("eventType"),
        _order_time().alias("eventTime"),
        _text(request).alias("requestId"),
        F.concat(F.lit("s"), _text("o_custkey")).alias("sessionId"),
        F.col("o_custkey").alias("userId"),
        F.col("o_orderpriority").alias("intentType"),
        F.concat(F.lit("group "), status).alias("intentGroup"),
        F.lit("answer").alias("answerText"),
        F.when(status == "O", True).when(status == "F", False).alias("success"),
        _order_time().alias("responseTime"),
        F.when(key % 7 != 0, F.floor("o_totalprice")).alias("latencyMs"),
        F.lit("model").alias("modelName"),
        F.lit("template").alias("promptTemplateId"),
        F.when(key % 4 != 0, F.to_json(ids)).alias("resultSongIds"),
        names.alias("resultSingerNames"),
        F.lit("RULE").alias("responseSource"),
    )


def _kind() -> Column:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return (
        F.when((flag == "A") & (status == "F"), "LIKE")
        .when((flag == "A") & (status == "O"), " dislike ")
        .when((flag == "N") & (status == "F"), "FollowUp")
        .when((flag == "N") & (status == "O"), "CLICK")
        .when((flag == "R") & (status == "F"), "SHARE")
        .otherwise("-")
    )


def feedback(lineitem: DataFrame, request: str = "l_orderkey") -> DataFrame:
    return _timed(lineitem, "l_shipdate").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("eventId"),
        F.lit(AI_FEEDBACK).alias("eventType"),
        F.col("_time").alias("eventTime"),
        _text(request).alias("requestId"),
        F.lit("s").alias("sessionId"),
        F.col("l_suppkey").alias("userId"),
        _kind().alias("feedbackType"),
        F.col("_time").alias("feedbackTime"),
    )


def feedback_of_customers(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Feedback whose request is the customer, so that requests repeat."""
    owned = lineitem.join(
        orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return feedback(owned, "o_custkey")


_QUESTIONS = (
    "现在最火的歌手是谁", "现在最火的歌有哪些", "推荐几首周杰伦的歌", "来点适合跑步的", "前5首热歌",
    "天气", "top100 歌手榜", "0首 热门歌曲",
)


def questions(conversations: DataFrame) -> DataFrame:
    """User turns as questions: a known phrase before or after the turn's text."""
    turn = F.col("conv_id") * 8 + F.col("turn")
    phrase = F.get(F.array(*[F.lit(q) for q in _QUESTIONS]), (turn % len(_QUESTIONS)).cast("int"))
    return conversations.filter("role = 'user'").select(
        "conv_id",
        "turn",
        F.col("conv_id").alias("userId"),
        F.when(turn % 3 != 0, F.concat(F.lit("s"), _text("conv_id"))).otherwise(" ")
        .alias("sessionId"),
        F.concat_ws("-", F.lit("r"), "conv_id", "turn").alias("requestId"),
        F.when(turn % 2 == 0, F.concat(phrase, F.lit(" \t"), F.col("text")))
        .otherwise(F.concat(F.lit(" "), F.col("text"), phrase))
        .alias("queryText"),
    )


def assistant_messages(conversations: DataFrame) -> DataFrame:
    """Envelopes of all turns, good and broken ones alike."""
    turn = F.col("conv_id") * 8 + F.col("turn")
    kind = (
        F.when(F.col("role") == "user", AI_QUERY)
        .when(F.col("role") == "assistant", AI_RESPONSE)
        .otherwise("AI_SYSTEM")
    )
    payload = F.struct(F.col("text").alias("queryText"), F.length("text").alias("latencyMs"))

    def envelope(body: Column) -> Column:
        return F.to_json(
            F.struct(
                F.when(turn % 11 == 0, " \t").otherwise(_text(turn)).alias("eventId"),
                kind.alias("eventType"),
                F.lit("2024-01-01 00:00:00").alias("eventTime"),
                _text("conv_id").alias("requestId"),
                F.concat(F.lit("s"), _text("conv_id")).alias("sessionId"),
                F.when(turn % 13 == 0, None).when(turn % 17 == 0, F.lit("x"))
                .otherwise(_text("conv_id")).alias("userId"),
                body.alias("payload"),
            )
        )

    value = (
        F.when(turn % 19 == 0, F.col("text"))
        .when(turn % 5 == 0, envelope(F.to_json(payload)))
        .when(turn % 7 == 0, envelope(F.col("text")))
        .otherwise(envelope(payload))
    )
    return conversations.select("conv_id", "turn", value.alias("value"))
