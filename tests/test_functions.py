from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadenza.fixed_values import NO_INFO
from cadenza.functions import json as J
from cadenza.functions import questions as Q
from cadenza.functions import text
from cadenza.functions.measures import guarded_mean
from cadenza.functions.once import evaluated_once
from cadenza.functions.time import (
    date_of_millis, hour_of_millis, local_text_to_timestamp, seconds_to_millis,
)


def _map(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_trim_and_blank(spark):
    values = [None, "", " \t\n", "\x00a \x1f", " b c "]
    assert _map(spark, values, text.trim_all) == [None, "", "", "a", "b c"]
    assert _map(spark, values, text.has_text) == [False, False, False, True, True]
    assert _map(spark, values, text.clean_value) == [NO_INFO, NO_INFO, NO_INFO, "a", "b c"]


def test_singer_name(spark):
    values = [None, "  ", "abc ", '[{"name":"A"},{"name":"B"}]', "[x]", '[{"id":1}]',
              '[{"id":1},{"name": "C"}]']
    assert _map(spark, values, text.singer_name) == [
        NO_INFO, NO_INFO, "abc", "A", "[x]", '[{"id":1}]', "C",
    ]


def test_region_text(spark):
    assert _map(spark, [" 上 海 "], text.region_province) == ["上海"]
    cities = [None, "", " ", "[]", "杭州"]
    assert _map(spark, cities, lambda c: text.region_city(c, F.lit(" 上 海 "))) == [
        " 上 海 ", " 上 海 ", " 上 海 ", " 上 海 ", "杭州",
    ]


def test_lenient_numbers_and_booleans(spark):
    values = ["12", "12.7", "-3.9", "", "null", None, "abc", "9" * 30, "1e3"]
    assert _map(spark, values, J.as_long) == [12, 12, -3, None, None, None, None, None, 1000]
    assert _map(spark, values, J.is_bad_number) == [
        False, False, False, False, False, False, True, True, False,
    ]
    words = ["true", "Y", "1", "false", "0", "", None, "maybe"]
    assert _map(spark, words, J.as_boolean) == [
        True, True, True, False, False, None, None, None,
    ]


def test_objects_and_lists(spark):
    values = ['{"a":1}', ' {"a":{"b":2}}', "[]", "x", '{"a":', None]
    parsed = _map(spark, values, lambda c: J.parse_checked_object(c, ["a"]))
    assert [p and p[J.MALFORMED] is None for p in parsed] == [
        True, True, False, False, False, None,
    ]
    assert [p and p["a"] for p in parsed[:2]] == ["1", '{"b":2}']
    lists = [None, "", "[]", '["a","b"]', "x"]
    assert _map(spark, lists, J.string_list) == [[], [], [], ["a", "b"], []]


def test_times(spark):
    assert _map(spark, ["1704067199", "x", None], seconds_to_millis) == [
        1704067199000, None, None,
    ]
    ms = [1704067199000]
    assert _map(spark, ms, date_of_millis, "long") == ["2023-12-31"]
    assert _map(spark, ms, hour_of_millis, "long") == ["23"]
    parsed = _map(spark, ["2024-01-01 00:00:01", "2024-01-01", None], local_text_to_timestamp)
    assert [p is None for p in parsed] == [False, True, True]


def test_guarded_mean_truncates(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (5, 0)], "s long, c long")
    assert [r[0] for r in df.select(guarded_mean(F.col("s"), F.col("c"))).collect()] == [3, -3, 0]


@pytest.mark.parametrize(
    ("question", "limit"),
    [("前5首", 5), ("top100", 10), ("0首", 1), ("热歌", 3), ("前 7 首", 7), (None, 3), ("12个", 10)],
)
def test_row_limit(spark, question, limit):
    assert _map(spark, [question], lambda c: Q.row_limit(Q.normalize_question(c))) == [limit]


def test_intents(spark):
    questions = {
        "现在最火的歌手是谁": ("HOT_SINGER_QUERY", "DATA_QA", None),
        "现在 最火的 歌有哪些": ("HOT_SONG_QUERY", "DATA_QA", None),
        "推荐几首周杰伦的歌": ("SINGER_RECOMMEND", "RECOMMEND", "周杰伦"),
        "来点适合跑步的": ("SCENARIO_RECOMMEND", "RECOMMEND", None),
        "天气": ("OTHER", "DATA_QA", None),
        "": ("OTHER", "DATA_QA", None),
    }

    def both(c):
        q = Q.normalize_question(c)
        intent = Q.intent_type(q)
        return F.struct(intent, Q.intent_group(intent), Q.asked_singer(q))

    assert [tuple(r) for r in _map(spark, list(questions), both)] == list(questions.values())


def test_other_rule_sets(spark):
    rules = Q.QuestionRules(hot_singer_words=("band",), hot_song_words=("hit",), default_rows=4)
    assert _map(spark, ["a HIT", "a hit", "band hit"], lambda c: Q.intent_type(c, rules)) == [
        "OTHER", "HOT_SONG_QUERY", "HOT_SINGER_QUERY",
    ]


def test_once_keeps_one_copy_of_an_expression(spark):
    df = spark.range(3).selectExpr("cast(id as string) v")
    parsed = evaluated_once(df, {"j": F.from_json(F.col("v"), "a string, b string")})
    out = parsed.filter("j.a is null and j.b is null").select("j.a", "j.b", "j")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1
    assert out.count() == 3
