"""Explicit schemas of the records that layers exchange as JSON or as tables."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"S": T.StringType, "L": T.LongType, "I": T.IntegerType, "B": T.BooleanType,
          "D": T.DoubleType, "TS": T.TimestampType}


def record(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]()) for n, k in fields.items()])


CLEAN_PLAY = record(
    userId="L", songId="S", machineId="L", action="S", timestamp="L", ip="S", city="S",
    date="S", hour="S",
)
LOGIN = record(
    eventId="S", userId="L", eventType="S", lng="S", lat="S", loginDt="L", machineId="L",
    date="S", hour="S",
)
AI_ENVELOPE = record(
    eventId="S", eventType="S", eventTime="S", requestId="S", sessionId="S", userId="L"
)


def extended(base: T.StructType, **fields: str) -> T.StructType:
    return T.StructType([*base.fields, *record(**fields).fields])


SONG_PLAY_WIDE = extended(
    CLEAN_PLAY, songName="S", album="S", singerInfo="S", postTime="S", authorizedCompany="S"
)
LOGIN_WIDE = extended(LOGIN, province="S", city="S", district="S", adcode="S")
CONSUME_DETAIL = record(
    id="L", mid="L", uid="L", amount="L", pkgId="I", pkgName="S", activityId="I",
    activityName="S", actionTime="S", billDate="S", type="S", ts="L",
)
CONSUME_WIDE = record(
    id="L", mid="L", uid="L", amount="L", pkgId="I", pkgName="S", activityId="I",
    activityName="S", actionTime="S", billDate="S", province="S", city="S",
)
AI_QUERY = extended(AI_ENVELOPE, queryText="S", intentType="S", intentGroup="S", queryTime="S")
AI_RESPONSE = extended(
    AI_ENVELOPE, intentType="S", intentGroup="S", answerText="S", success="B", responseTime="S",
    latencyMs="L", modelName="S", promptTemplateId="S", resultSongIds="S", resultSingerNames="S",
    responseSource="S",
)
AI_RESPONSE_WIDE = extended(
    AI_RESPONSE, resultSongCount="I", resultSingerCount="I", hasSongResult="B",
    hasSingerResult="B", firstSongId="S", firstSingerName="S",
)
AI_FEEDBACK = extended(AI_ENVELOPE, feedbackType="S", feedbackTime="S")
SONG_HOT = record(songId="S", songName="S", playCount="L", windowStart="S", windowEnd="S")
SINGER_HOT = record(singerInfo="S", playCount="L", windowStart="S", windowEnd="S")
REGION_LOGIN = record(
    province="S", city="S", district="S", adcode="S", loginUserCount="L", windowStart="S",
    windowEnd="S",
)
REGION_REVENUE = record(
    province="S", city="S", orderCount="L", totalAmount="L", windowStart="S", windowEnd="S"
)
_MEASURES = dict(
    requestCount="L", successCount="L", avgLatencyMs="L", likeCount="L", dislikeCount="L",
    followupCount="L", clickCount="L",
)
AI_OVERVIEW = record(windowStart="S", windowEnd="S", **_MEASURES)
AI_INTENT = record(windowStart="S", windowEnd="S", intentType="S", intentGroup="S", **_MEASURES)
INTENT_DELTA = record(
    eventTime="S", intentType="S", intentGroup="S", requestCount="L", successCount="L",
    latencySum="L", latencyCount="L", likeCount="L", dislikeCount="L", followupCount="L",
    clickCount="L",
)
ROUTING_CONFIG = record(
    tbl_name="S", tbl_db="S", tbl_type="S", pk_col="S", cols="S", phoenix_tbl_name="S",
    sink_topic="S",
)
DIM_SONG = record(
    source_id="S", name="S", album="S", singer_info="S", post_time="S", authorized_company="S"
)
DIM_MACHINE_LOCAL_INFO = record(mid="S", province="S", city="S", address="S")
DIM_MACHINE_ADMIN_MAP = record(
    machine_num="S", machine_name="S", package_name="S", inv_rate="S", age_rate="S",
    com_rate="S", par_rate="S",
)
DIM_GEO_REGION = record(
    lng_cell="L", lat_cell="L", province="S", city="S", district="S", adcode="S"
)
