"""Event-time tumbling windows: the six aggregates and their serving gates.

Aggregates give the topic-side shape (camel-case names, window bounds as text);
:func:`to_serving` gives the serving-table shape (snake case, timestamps).  For a
stream, pass ``delay``: the watermark is set before the row filters, so rows that
are filtered out still advance time.

Counts and sums combine on the map side, so a hot key sends one row per task and
window.  Distinct users are counted in two steps, first one row per user, so no
task ever holds the users of a region.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.fixed_values import WINDOW_LENGTH
from cadenza.functions.measures import (
    DELTA_COLUMNS, FEEDBACK_COLUMNS, feedback_deltas, feedback_kind, guarded_mean,
    response_deltas,
)
from cadenza.functions.once import evaluated_once
from cadenza.functions.time import (
    kept_above_watermark, local_text_to_timestamp, millis_to_timestamp, timestamp_to_text,
)

EVENT_TIME = "eventTs"


def with_event_time(rows: DataFrame, event_time: Column, delay: str | None) -> DataFrame:
    """Add the event time, drop rows without one and set the watermark if asked."""
    timed = evaluated_once(rows, {EVENT_TIME: event_time}).filter(F.col(EVENT_TIME).isNotNull())
    return timed.withWatermark(EVENT_TIME, delay) if delay else timed


def with_millis(rows: DataFrame, millis: str, delay: str | None) -> DataFrame:
    """The same for epoch milliseconds, which are cheap enough to repeat."""
    timed = rows.filter(F.col(millis).isNotNull()).withColumn(
        EVENT_TIME, millis_to_timestamp(F.col(millis))
    )
    return timed.withWatermark(EVENT_TIME, delay) if delay else timed


def _late_enough(predicate: Column, delay: str | None) -> Column:
    """A filter that on streams stays above the watermark, and in batch reaches the scan."""
    return kept_above_watermark(predicate, EVENT_TIME) if delay else predicate


def window_bounds() -> list[Column]:
    return [
        timestamp_to_text(F.col("window.start")).alias("windowStart"),
        timestamp_to_text(F.col("window.end")).alias("windowEnd"),
    ]


def _tumbling(length: str) -> Column:
    return F.window(EVENT_TIME, length)


# --- songs and singers -------------------------------------------------------

def play_times(wide: DataFrame, delay: str | None = None) -> DataFrame:
    """Rows with a time and a song, in event time; plays only."""
    rows = wide.filter(F.col("timestamp").isNotNull() & F.col("songId").isNotNull())
    timed = with_millis(rows, "timestamp", delay)
    return timed.filter(_late_enough(F.col("action") == "play", delay))


def song_hot(
    wide: DataFrame, length: str = WINDOW_LENGTH, delay: str | None = None
) -> DataFrame:
    """Plays per song and window, with the first non-empty song name.

    Plays are first counted per (window, song, name), which stays in a hash aggregate;
    only those few rows meet the order-dependent choice of a name.  A stream chains the
    two aggregates in append mode.
    """
    plays = play_times(wide, delay)
    per_name = plays.groupBy(_tumbling(length).alias("window"), "songId", "songName").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"),
    )
    name = F.col("songName")
    named = name != ""
    counted = per_name.groupBy("window", "songId").agg(
        F.sum("n").alias("playCount"),
        F.min_by(F.when(named, name), F.when(named, F.struct("lo", "songName"))).alias("_first"),
        F.max_by(name, F.struct("hi", "songName")).alias("_last"),
    )
    return counted.select(
        "songId",
        F.coalesce("_first", "_last").alias("songName"),
        "playCount",
        *window_bounds(),
    )


def singer_hot(
    wide: DataFrame, length: str = WINDOW_LENGTH, delay: str | None = None
) -> DataFrame:
    """Plays per singer and window; plays without a singer are not counted."""
    timed = with_millis(wide, "timestamp", delay)
    known = (F.col("action") == "play") & (F.col("singerInfo") != "")
    plays = timed.filter(_late_enough(known, delay))
    counted = plays.groupBy(_tumbling(length).alias("window"), "singerInfo").agg(
        F.count(F.lit(1)).alias("playCount")
    )
    return counted.select("singerInfo", "playCount", *window_bounds())


# --- regions -----------------------------------------------------------------

REGION = ("province", "city", "district")


def region_login(
    wide: DataFrame, length: str = WINDOW_LENGTH, delay: str | None = None
) -> DataFrame:
    """Distinct users per region and window; adcode of the earliest login.

    A stream chains two plain aggregates in append mode: its state is one small row
    per (window, region, user), spread over all tasks.  Batch input is reduced to
    (window, region, user, adcode) in a hash aggregate first.
    """
    rows = wide.dropna(subset=["userId", "loginDt", *REGION])
    timed = with_millis(rows, "loginDt", delay)
    if not timed.isStreaming:
        first = timed.groupBy(_tumbling(length).alias("window"), *REGION, "userId", "adcode").agg(
            F.min("loginDt").alias("loginDt")
        )
        return login_totals(first)
    per_user = timed.groupBy(_tumbling(length).alias("window"), *REGION, "userId").agg(
        F.min(F.struct("loginDt", "adcode")).alias("first")
    )
    counted = per_user.groupBy("window", *REGION).agg(
        F.count(F.lit(1)).alias("loginUserCount"), F.min("first").alias("first")
    )
    return counted.select(
        *REGION, F.col("first.adcode").alias("adcode"), "loginUserCount", *window_bounds()
    )


def login_totals(first: DataFrame) -> DataFrame:
    """Users and adcode per region and window, from the first login of each
    (window, region, user, adcode).

    Users are counted and logins compared by number in hash aggregates; text is only
    compared among the few adcodes of a region.  Both branches read one shuffle.
    """
    keys = ["window", *REGION]
    users = first.select(*keys, "userId").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("loginUserCount")
    )
    codes = first.groupBy(*keys, "adcode").agg(F.min("loginDt").alias("loginDt"))
    earliest = codes.groupBy(*keys).agg(F.min(F.struct("loginDt", "adcode")).alias("first"))
    return users.join(earliest, keys).select(
        *REGION, F.col("first.adcode").alias("adcode"), "loginUserCount", *window_bounds()
    )


def region_revenue(
    wide: DataFrame, length: str = WINDOW_LENGTH, delay: str | None = None
) -> DataFrame:
    """Orders and amount per province, city and window."""
    rows = wide.dropna(subset=["amount", "actionTime", "province", "city"])
    timed = with_event_time(rows, local_text_to_timestamp(F.col("actionTime")), delay)
    counted = timed.groupBy(_tumbling(length).alias("window"), "province", "city").agg(
        F.count(F.lit(1)).alias("orderCount"), F.sum("amount").alias("totalAmount")
    )
    return counted.select("province", "city", "orderCount", "totalAmount", *window_bounds())


# --- assistant ---------------------------------------------------------------

def response_metrics(responses: DataFrame, *keys: str) -> DataFrame:
    """Metric deltas of valid responses, with ``eventTime`` text and ``keys``."""
    rows = responses.dropna(subset=["requestId", "responseTime", *keys])
    return rows.select(F.col("responseTime").alias("eventTime"), *keys, *response_deltas())


def valid_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.dropna(subset=["requestId", "feedbackTime", "feedbackType"])


def feedback_metrics(
    feedback: DataFrame, *keys: str, times: Column | None = None
) -> DataFrame:
    """Metric deltas of valid feedback; ``times`` counts rows collapsed into one."""
    rows = evaluated_once(valid_feedback(feedback), {"_kind": feedback_kind("feedbackType")})
    return rows.select(
        F.col("feedbackTime").alias("eventTime"), *keys, *feedback_deltas(F.col("_kind"), times)
    )


def metric_windows(
    deltas: DataFrame,
    keys: Sequence[str] = (),
    length: str = WINDOW_LENGTH,
    delay: str | None = None,
) -> DataFrame:
    """Sum metric deltas per window and ``keys``; average latency is guarded."""
    timed = with_event_time(deltas, local_text_to_timestamp(F.col("eventTime")), delay)
    sums = timed.groupBy(_tumbling(length).alias("window"), *keys).agg(
        *[F.sum(c).alias(c) for c in DELTA_COLUMNS]
    )
    return sums.select(
        *window_bounds(),
        *keys,
        "requestCount",
        "successCount",
        guarded_mean(F.col("latencySum"), F.col("latencyCount")).alias("avgLatencyMs"),
        *FEEDBACK_COLUMNS.values(),
    )


def ai_overview(
    responses: DataFrame,
    feedback: DataFrame,
    length: str = WINDOW_LENGTH,
    delay: str | None = None,
) -> DataFrame:
    """Totals per window over all responses and feedback (one watermark after the union)."""
    deltas = response_metrics(responses).unionByName(feedback_metrics(feedback))
    return metric_windows(deltas, (), length, delay)


def ai_intent(
    deltas: DataFrame, length: str = WINDOW_LENGTH, delay: str | None = None
) -> DataFrame:
    """Totals per window and intent; deltas carry ``intentType`` and ``intentGroup``."""
    return metric_windows(deltas, ("intentType", "intentGroup"), length, delay)


# --- serving gates -----------------------------------------------------------

_METRICS = {
    "requestCount": "request_count",
    "successCount": "success_count",
    "avgLatencyMs": "avg_latency_ms",
    "likeCount": "like_count",
    "dislikeCount": "dislike_count",
    "followupCount": "followup_count",
    "clickCount": "click_count",
}

#: serving table -> its columns, as source name -> column name
SERVING_TABLES: dict[str, dict[str, str]] = {
    "dm_song_hot_10s": {
        "songId": "song_id", "songName": "song_name", "playCount": "play_count",
    },
    "dm_singer_hot_10s": {"singerInfo": "singer_info", "playCount": "play_count"},
    "dm_region_user_login_10s": {
        "province": "province", "city": "city", "district": "district",
        "adcode": "adcode", "loginUserCount": "login_user_count",
    },
    "dm_region_revenue_10s": {
        "province": "province", "city": "city",
        "orderCount": "order_count", "totalAmount": "total_amount",
    },
    "dm_ai_overview_10s": dict(_METRICS),
    "dm_ai_intent_10s": {
        "intentType": "intent_type", "intentGroup": "intent_group", **_METRICS,
    },
}


def to_serving(stats: DataFrame, table: str) -> DataFrame:
    """Rows of a serving table: every column must be there, bounds as timestamps."""
    columns = SERVING_TABLES[table]
    complete = stats.dropna(how="any", subset=["windowStart", "windowEnd", *columns])
    return complete.select(
        local_text_to_timestamp(F.col("windowStart")).alias("window_start"),
        local_text_to_timestamp(F.col("windowEnd")).alias("window_end"),
        *[F.col(s).alias(t) for s, t in columns.items()],
    )

