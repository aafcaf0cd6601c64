from __future__ import annotations

import json

from pyspark.sql import functions as F

from cadenza.operators import assistant

GOOD = {"eventId": "e", "eventType": "AI_RESPONSE", "eventTime": "2024-01-01 00:00:00",
        "requestId": "r", "sessionId": "s", "userId": 1, "payload": {}}
PAYLOAD = {"intentType": "HOT", "intentGroup": "G", "success": True, "latencyMs": "12",
           "responseTime": "2024-01-01 00:00:01", "responseSource": "RULE"}


def _split(spark, messages):
    rows = [(i, m if isinstance(m, str) else json.dumps(m, ensure_ascii=False))
            for i, m in enumerate(messages)]
    return assistant.split_assistant_log(spark.createDataFrame(rows, "i int, value string"))


def test_broken_envelopes_are_set_aside(spark):
    bad = [
        {**GOOD, "eventId": " \t"}, {**GOOD, "userId": None}, {**GOOD, "payload": None},
        {**GOOD, "payload": [1]}, {**GOOD, "payload": "text"}, "no json",
        {**GOOD, "userId": "x"}, {**GOOD, "eventType": "OTHER"},
    ]
    split = _split(spark, [GOOD, {**GOOD, "payload": "{}"}, *bad])
    reasons = [r.reason for r in split.orderBy("i").collect()]
    assert reasons == [None, None, *["invalid envelope"] * 6, "bad user id", "unknown event type"]
    assert assistant.quarantined(split).count() == len(bad)


def test_branches(spark):
    split = _split(spark, [
        {**GOOD, "eventType": "AI_QUERY", "payload": {"queryText": "q", "intentType": "X"}},
        {**GOOD, "payload": {**PAYLOAD, "resultSongIds": ["a", "b"], "resultSingerNames": "[]"}},
        {**GOOD, "eventType": "AI_FEEDBACK", "payload": {"feedbackType": "LIKE"}},
    ])
    assert [(r.queryText, r.userId) for r in assistant.query_branch(split).collect()] == [("q", 1)]
    assert [r.feedbackType for r in assistant.feedback_branch(split).collect()] == ["LIKE"]
    (r,) = assistant.response_branch(split).collect()
    assert (r.success, r.latencyMs, r.resultSongIds, r.resultSingerNames) == (
        True, 12, '["a","b"]', "[]",
    )


def test_widening(spark):
    lists = [None, "", "[]", ["a", "b"], "broken"]
    split = _split(spark, [
        {**GOOD, "eventId": str(i), "payload": {**PAYLOAD, "resultSongIds": x}}
        for i, x in enumerate(lists)
    ] + [{**GOOD, "payload": {**PAYLOAD, "responseSource": None}}])
    wide = assistant.widen_responses(assistant.response_branch(split)).orderBy("eventId")
    rows = wide.select("resultSongCount", "hasSongResult", "firstSongId",
                       "resultSingerCount").collect()
    assert [tuple(r) for r in rows] == [
        (0, False, None, 0), (0, False, None, 0), (0, False, None, 0), (2, True, "a", 0),
        (0, False, None, 0),
    ]


def test_each_branch_parses_once(spark):
    split = _split(spark, [GOOD])
    plan = assistant.response_branch(split).filter(F.col("success"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("from_json") == 2
