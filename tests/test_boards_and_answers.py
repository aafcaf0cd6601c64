from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from cadenza import fixed_values as V
from cadenza.functions.questions import QuestionRules
from cadenza.operators import answers, assistant, boards

SONGS = "window_start timestamp, window_end timestamp, song_id string, song_name string, " \
        "play_count long"
SINGERS = "window_start timestamp, window_end timestamp, singer_info string, play_count long"


def _w(i):
    start = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=10 * i)
    return start, start + dt.timedelta(seconds=10)


def _song_board(spark, n=4):
    rows = [(*_w(0), "old", "Old", 99)] + [(*_w(1), str(i), f"N{i}", 5 if i < 2 else 9 - i)
                                           for i in range(n)]
    return boards.top_songs(spark.createDataFrame(rows, SONGS))


def _singer_board(spark):
    return boards.top_singers(spark.createDataFrame([(*_w(0), "A", 1), (*_w(0), "B", 2)], SINGERS))


def test_only_the_newest_window_with_ties_by_key(spark):
    rows = _song_board(spark).collect()
    assert [(r.songId, r.playCount) for r in rows] == [("2", 7), ("3", 6), ("0", 5), ("1", 5)]
    assert rows[0].windowStart == "2024-01-01 00:00:10"
    assert boards.top_songs(spark.createDataFrame([], SONGS)).count() == 0


def test_top_k_is_planned_per_task(spark):
    plan = _song_board(spark)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def _ask(spark, *questions):
    df = spark.createDataFrame(
        [(i, 1, "", f"r{i}", q) for i, q in enumerate(questions)],
        "i int, userId long, sessionId string, requestId string, queryText string",
    )
    return answers.classify(df)


def test_answers(spark):
    asked = _ask(spark, "前2首热歌", "热门歌手", "热门歌曲10首", "推荐几首周杰伦的歌", "来点歌", "天气")
    rows = answers.answer(asked, _song_board(spark), _singer_board(spark)).orderBy("i").collect()
    assert rows[0].answerText == "当前最热门的2首歌曲是：《N2》、《N3》。"
    assert (rows[0].success, rows[0].resultSongIds, rows[0].resultSingerNames) == (
        True, ["2", "3"], [],
    )
    assert rows[1].answerText == "当前最热门的2位歌手是：B、A。"
    assert rows[1].resultSingerNames == ["B", "A"]
    assert rows[2].resultSongIds == ["2", "3", "0", "1"]
    assert "周杰伦" in rows[3].answerText and not rows[3].success
    assert [r.answerText for r in rows[4:]] == [V.SCENARIO_UNSUPPORTED, V.OTHER_UNSUPPORTED]


def test_empty_boards(spark):
    empty = boards.top_songs(spark.createDataFrame([], SONGS))
    nobody = boards.top_singers(spark.createDataFrame([], SINGERS))
    rows = answers.answer(_ask(spark, "热歌", "歌手榜"), empty, nobody).orderBy("i").collect()
    assert [r.answerText for r in rows] == [V.NO_SONG_BOARD, V.NO_SINGER_BOARD]
    assert [(r.success, r.resultSongIds) for r in rows] == [(False, [])] * 2


def test_questions_are_not_shuffled(spark):
    asked = _ask(spark, "热歌")
    plan = answers.answer(asked, _song_board(spark), _singer_board(spark))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text.split("Subquery", 1)[0]
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_request_checks(spark):
    df = spark.createDataFrame(
        [(1, "q", "r", "s", "LIKE"), (None, "q", "r", "s", "L"), (1, " \t", " ", "s", "L"),
         (1, "q", "r", None, "L"), (1, "q", "r", "s", "")],
        "userId long, queryText string, requestId string, sessionId string, feedbackType string",
    )
    out = df.select(answers.query_request_reason(), answers.feedback_request_reason()).collect()
    first = [None if r[0] is None else r[0].split()[0] for r in out]
    second = [None if r[1] is None else r[1].split()[0] for r in out]
    assert first == [None, "userId", "queryText", None, None]
    assert second == [None, "userId", "requestId", "sessionId", "feedbackType"]


def test_envelopes_pass_the_assistant_line(spark):
    now = F.lit("2024-01-01 00:00:00")
    asked = answers.with_session(_ask(spark, "前2首热歌"))
    events = answers.query_events(asked, F.uuid(), now)
    envelope = json.loads(events.first().value)
    assert list(envelope) == ["eventId", "eventType", "eventTime", "requestId", "sessionId",
                              "userId", "payload"]
    assert envelope["payload"]["intentType"] == V.HOT_SONG_QUERY and envelope["sessionId"].strip()
    answered = answers.answer(asked, _song_board(spark), _singer_board(spark)).withColumn(
        "latencyMs", F.lit(3).cast("long")
    )
    responses = answers.response_events(answered, F.lit("e"), now)
    feedback = answers.feedback_events(
        asked.withColumn("feedbackType", F.lit("LIKE")), F.lit("e"), now
    )
    split = assistant.split_assistant_log(events.union(responses).union(feedback))
    assert [r.route for r in split.filter("reason is null").orderBy("route").collect()] == [
        "feedback", "query", "response",
    ]
    wide = assistant.widen_responses(assistant.response_branch(split)).first()
    assert (wide.resultSongCount, wide.firstSongId, wide.modelName) == (2, "2", V.MODEL_NAME)


def test_rules_bound_the_rows_of_an_answer(spark):
    rules = QuestionRules(max_rows=50)
    asked = answers.classify(
        spark.createDataFrame([("前50首热歌",), ("前99首热歌",), ("热歌",)], "queryText string"), rules=rules
    )
    board = spark.createDataFrame([(f"s{i:02d}", f"n{i}", i) for i in range(60)], "songId string, songName string, playCount long")
    nobody = spark.createDataFrame([], "singerInfo string, playCount long")
    rows = answers.answer(asked, board, nobody, rules).collect()
    assert [len(r.resultSongIds) for r in rows] == [50, 50, 3]
    assert rows[0].resultSongIds[0] == "s59"
