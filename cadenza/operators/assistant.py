"""Assistant log: validate the envelope, split by type, flatten, widen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.fixed_values import AI_FEEDBACK, AI_QUERY, AI_RESPONSE
from cadenza.functions.json import (
    MALFORMED, as_boolean, as_long, is_bad_number, parse_checked_object, parse_object,
    string_list,
)
from cadenza.functions.once import evaluated_once
from cadenza.functions.text import has_text, trim_all

_TEXT_FIELDS = ("eventId", "eventType", "eventTime", "requestId", "sessionId")
_ENVELOPE_FIELDS = (*_TEXT_FIELDS, "userId", "payload")
_QUERY_FIELDS = ("queryText", "intentType", "intentGroup", "queryTime")
_RESPONSE_FIELDS = (
    "intentType", "intentGroup", "answerText", "success", "responseTime", "latencyMs",
    "modelName", "promptTemplateId", "resultSongIds", "resultSingerNames", "responseSource",
)
_FEEDBACK_FIELDS = ("feedbackType", "feedbackTime")
_PAYLOAD_FIELDS = tuple(dict.fromkeys((*_QUERY_FIELDS, *_RESPONSE_FIELDS, *_FEEDBACK_FIELDS)))

QUERY, RESPONSE, FEEDBACK, UNKNOWN = "query", "response", "feedback", "unknown"


def is_valid_envelope() -> Column:
    """Five texts, a user and an object as payload; never NULL.

    Needs ``ev`` and ``body``, the parsed payload.
    """
    is_object = F.ltrim("ev.payload").startswith("{") & F.col("body")[MALFORMED].isNull()
    valid = F.col("ev.userId").isNotNull() & is_object
    for name in _TEXT_FIELDS:
        valid = valid & has_text(F.col("ev")[name])
    return F.coalesce(valid, F.lit(False))


def route_of(event_type: Column) -> Column:
    return (
        F.when(event_type == AI_QUERY, QUERY)
        .when(event_type == AI_RESPONSE, RESPONSE)
        .when(event_type == AI_FEEDBACK, FEEDBACK)
        .otherwise(UNKNOWN)
    )


def split_assistant_log(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add ``ev``, ``body``, ``route`` and ``reason`` (NULL for rows that go on).

    Envelope and payload are parsed once each, whatever the branches read.
    """
    parsed = evaluated_once(messages, {"ev": parse_object(F.col(value), _ENVELOPE_FIELDS)})
    body = parse_checked_object(F.col("ev.payload"), _PAYLOAD_FIELDS)
    parsed = evaluated_once(parsed, {"body": body})
    route = route_of(F.col("ev.eventType"))
    reason = (
        F.when(~is_valid_envelope(), "invalid envelope")
        .when(route == UNKNOWN, "unknown event type")
        .when(is_bad_number(F.col("ev.userId")), "bad user id")
    )
    return evaluated_once(parsed, {"route": route, "reason": reason})


def quarantined(split: DataFrame, value: str = "value") -> DataFrame:
    return split.filter(F.col("reason").isNotNull()).select(value, "route", "reason")


def _branch(split: DataFrame, route: str, fields: tuple[str, ...]) -> DataFrame:
    rows = split.filter((F.col("route") == route) & F.col("reason").isNull())
    return rows.select(
        *[F.col("ev")[name].alias(name) for name in _TEXT_FIELDS],
        as_long(F.col("ev.userId")).alias("userId"),
        *[F.col("body")[name].alias(name) for name in fields],
    )


def query_branch(split: DataFrame) -> DataFrame:
    return _branch(split, QUERY, _QUERY_FIELDS)


def response_branch(split: DataFrame) -> DataFrame:
    """Responses; the two result lists stay JSON text."""
    flat = _branch(split, RESPONSE, _RESPONSE_FIELDS)
    return flat.withColumns(
        {"success": as_boolean(F.col("success")), "latencyMs": as_long(F.col("latencyMs"))}
    )


def feedback_branch(split: DataFrame) -> DataFrame:
    return _branch(split, FEEDBACK, _FEEDBACK_FIELDS)


_RESPONSE_REQUIRED = ("requestId", "sessionId", "eventTime", "intentType", "responseSource")


def valid_responses(responses: DataFrame) -> DataFrame:
    return responses.dropna(subset=list(_RESPONSE_REQUIRED))


def widen_responses(responses: DataFrame) -> DataFrame:
    """Add size, presence and first element of both result lists."""
    with_lists = evaluated_once(
        valid_responses(responses),
        {
            "_songs": string_list(trim_all("resultSongIds")),
            "_singers": string_list(trim_all("resultSingerNames")),
        },
    )
    return with_lists.withColumns(
        {
            "resultSongCount": F.size("_songs"),
            "resultSingerCount": F.size("_singers"),
            "hasSongResult": F.size("_songs") > 0,
            "hasSingerResult": F.size("_singers") > 0,
            "firstSongId": F.get("_songs", F.lit(0)),
            "firstSingerName": F.get("_singers", F.lit(0)),
        }
    ).drop("_songs", "_singers")
