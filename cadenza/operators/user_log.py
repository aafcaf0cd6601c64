"""User log: validate, split by event and operation, project to clean rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.fixed_values import LOGIN_EVENT, SONG_EVENT
from cadenza.functions.json import as_int, as_long, is_bad_number, parse_object
from cadenza.functions.once import evaluated_once
from cadenza.functions.time import (
    date_of_millis, hour_of_millis, seconds_to_millis, usable_millis,
)

_EVENT_FIELDS = (
    "timestamp", "mid", "event_type", "event_content",
    "event_id", "uid", "lng", "lat", "login_dt",
)
_CONTENT_FIELDS = ("songid", "uid", "optrate_type", "mid")

PLAY, PAUSE, SKIP, OTHER = "play", "pause", "skip", "other"
LOGIN, UNKNOWN = "login_location", "unknown"
#: the routes whose rows share one output
OTHER_ROUTES = (PAUSE, SKIP, OTHER)


def parse_user_log(events: DataFrame, event: str = "event") -> DataFrame:
    """Add ``ev`` and ``content``, the event and its nested object as text fields."""
    parsed = evaluated_once(events, {"ev": parse_object(F.col(event), _EVENT_FIELDS)})
    return evaluated_once(
        parsed, {"content": parse_object(F.col("ev.event_content"), _CONTENT_FIELDS)}
    )


def is_song_event() -> Column:
    return F.coalesce(
        (F.col("ev.event_type") == SONG_EVENT)
        & F.col("content.songid").isNotNull()
        & as_long(F.col("content.uid")).isNotNull(),
        F.lit(False),
    )


def is_login_event() -> Column:
    ev = F.col("ev")
    present = F.lit(True)
    for name in ("event_id", "lng", "lat", "mid"):
        present = present & ev[name].isNotNull()
    for name in ("uid", "login_dt"):
        present = present & as_long(ev[name]).isNotNull()
    return F.coalesce((ev["event_type"] == LOGIN_EVENT) & present, F.lit(False))


def route_of(event_type: Column, operation: Column) -> Column:
    """Route of an event; total and exclusive. ``operation`` is its text."""
    code = as_int(operation)
    by_operation = (
        F.when(is_bad_number(operation) | (as_long(operation).isNotNull() & code.isNull()), UNKNOWN)
        .when(code == 0, PLAY)
        .when(code == 1, PAUSE)
        .when(code == 2, SKIP)
        .otherwise(OTHER)
    )
    return (
        F.when(event_type == SONG_EVENT, by_operation)
        .when(event_type == LOGIN_EVENT, LOGIN)
        .otherwise(UNKNOWN)
    )


def _machine_id() -> Column:
    return F.when(F.col("ev.mid").isNotNull(), F.col("ev.mid").try_cast("bigint")).otherwise(
        as_int(F.col("content.mid")).cast("bigint")
    )


def split_user_log(events: DataFrame, event: str = "event") -> DataFrame:
    """Add ``route`` and ``reason`` to each event, in one pass over the log.

    ``reason`` is NULL for rows that go on to their branch and says otherwise
    why the row is set aside; a row never fails the job.
    """
    parsed = parse_user_log(events, event)
    route = route_of(F.col("ev.event_type"), F.col("content.optrate_type"))
    song = is_song_event()
    reason = (
        F.when(~(song | is_login_event()), "invalid event")
        .when(F.col("route") == UNKNOWN, "unknown operation")
        .when(song & seconds_to_millis(F.col("ev.timestamp")).isNull(), "bad timestamp")
        .when(~song & usable_millis(as_long(F.col("ev.login_dt"))).isNull(), "bad timestamp")
        .when(song & _machine_id().isNull(), "bad machine id")
        .when(~song & is_bad_number(F.col("ev.mid")), "bad machine id")
    )
    return parsed.withColumn("route", route).withColumn("reason", reason)


def quarantined(split: DataFrame, event: str = "event") -> DataFrame:
    return split.filter(F.col("reason").isNotNull()).select(event, "route", "reason")


def clean_plays(split: DataFrame, *routes: str) -> DataFrame:
    """Clean rows of the given song routes (all four by default)."""
    wanted = routes or (PLAY, *OTHER_ROUTES)
    millis = seconds_to_millis(F.col("ev.timestamp"))
    return (
        split.filter(F.col("route").isin(*wanted) & F.col("reason").isNull())
        .select(
            as_long(F.col("content.uid")).alias("userId"),
            F.col("content.songid").alias("songId"),
            _machine_id().alias("machineId"),
            F.col("route").alias("action"),
            millis.alias("timestamp"),
            F.lit("").alias("ip"),
            F.lit("").alias("city"),
            date_of_millis(millis).alias("date"),
            hour_of_millis(millis).alias("hour"),
        )
    )


def play_branch(split: DataFrame) -> DataFrame:
    return clean_plays(split, PLAY)


def other_branch(split: DataFrame) -> DataFrame:
    """Union of pauses, skips and other operations: one filter, no union needed."""
    return clean_plays(split, *OTHER_ROUTES)


def login_branch(split: DataFrame) -> DataFrame:
    millis = as_long(F.col("ev.login_dt"))
    return split.filter((F.col("route") == LOGIN) & F.col("reason").isNull()).select(
        F.col("ev.event_id").alias("eventId"),
        as_long(F.col("ev.uid")).alias("userId"),
        F.col("ev.event_type").alias("eventType"),
        F.col("ev.lng").alias("lng"),
        F.col("ev.lat").alias("lat"),
        millis.alias("loginDt"),
        as_long(F.col("ev.mid")).alias("machineId"),
        date_of_millis(millis).alias("date"),
        hour_of_millis(millis).alias("hour"),
    )
