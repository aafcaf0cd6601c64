from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import enrich, windows
from cadenza.plans import heat, regions
from cadenza.plans import stand_ins as S

WIDE = "songId string, songName string, singerInfo string, action string, timestamp long"
LOGIN = "userId long, loginDt long, province string, city string, district string, adcode string"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _same(a, b):
    b = b.select(*a.columns)
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0


def test_song_windows_and_first_name(spark):
    df = spark.createDataFrame(
        [
            ("s", None, "x", "play", 1000), ("s", "", "x", "play", 2000),
            ("s", "X", "x", "play", 3000), ("s", "Y", "x", "play", 4000),
            ("s", "Z", "x", "play", 9999), ("s", "Z", "x", "play", 10000),
            ("s", "X", "x", "pause", 3000), (None, "X", "x", "play", 3000),
            ("t", "T", "x", "play", None), ("u", "", "x", "play", 1000),
            ("u", None, "x", "play", 2000),
        ],
        WIDE,
    )
    out = windows.song_hot(df)
    assert _rows(out) == [
        ("s", "X", 5, "1970-01-01 00:00:00", "1970-01-01 00:00:10"),
        ("s", "Z", 1, "1970-01-01 00:00:10", "1970-01-01 00:00:20"),
        ("u", None, 2, "1970-01-01 00:00:00", "1970-01-01 00:00:10"),
    ]
    served = windows.to_serving(out, "dm_song_hot_10s")
    assert served.columns == ["window_start", "window_end", "song_id", "song_name", "play_count"]
    assert sorted(r.play_count for r in served.collect()) == [1, 5]


def test_singers(spark):
    df = spark.createDataFrame(
        [("a", "n", "S", "play", 1), ("b", "n", "S", "play", 2), (None, "n", "S", "play", 3),
         ("a", "n", "", "play", 1), ("a", "n", None, "play", 1), ("a", "n", "S", "skip", 1)],
        WIDE,
    )
    assert [(r.singerInfo, r.playCount) for r in windows.singer_hot(df).collect()] == [("S", 3)]


def test_distinct_logins(spark):
    df = spark.createDataFrame(
        [(1, 2, "p", "c", "d", "late"), (1, 1, "p", "c", "d", None), (2, 3, "p", "c", "d", "x"),
         (3, 1, "p", "c", None, "x"), (None, 1, "p", "c", "d", "x"),
         # keys that would be one if joined by an underscore
         (1, 1, "a_b", "c", "d", "x"), (1, 1, "a", "b_c", "d", "x")],
        LOGIN,
    )
    out = windows.region_login(df)
    assert [(r[0], r[1], r[3], r[4]) for r in _rows(out)] == [
        ("a", "b_c", "x", 1), ("a_b", "c", "x", 1), ("p", "c", None, 2),
    ]
    assert windows.to_serving(out, "dm_region_user_login_10s").count() == 2


def test_revenue(spark):
    df = spark.createDataFrame(
        [(5, "2024-01-01 00:00:01", "p", "c"), (7, "2024-01-01 00:00:09", "p", "c"),
         (1, "not a time", "p", "c"), (1, "2024-01-01 00:00:01", None, "c"),
         (None, "2024-01-01 00:00:01", "p", "c")],
        "amount long, actionTime string, province string, city string",
    )
    assert [(r.orderCount, r.totalAmount) for r in windows.region_revenue(df).collect()] == [(2, 12)]


def test_overview_with_unknown_kinds(spark):
    at = "2024-01-01 00:00:0"
    responses = spark.createDataFrame(
        [("r", at + "1", True, 1), ("r", at + "2", None, 2), ("r", at + "3", False, None),
         (None, at + "3", True, 9)],
        "requestId string, responseTime string, success boolean, latencyMs long",
    )
    feedback = spark.createDataFrame(
        [("r", at + "1", " like "), ("r", at + "1", "click"), ("r", at + "1", "SHARE"),
         ("r", "2024-01-01 00:00:30", "SHARE"), ("r", at + "1", None)],
        "requestId string, feedbackTime string, feedbackType string",
    )
    rows = _rows(windows.ai_overview(responses, feedback).drop("windowEnd"))
    assert rows == [
        ("2024-01-01 00:00:00", 3, 1, 1, 1, 0, 0, 1),
        ("2024-01-01 00:00:30", 0, 0, 0, 0, 0, 0, 0),
    ]
    assert windows.to_serving(
        windows.ai_overview(responses, feedback), "dm_ai_overview_10s"
    ).count() == 2


@pytest.mark.parametrize("length", ["10 seconds", "1 day"])
def test_reduced_plans_equal_row_level_operators(spark, sf_dir, length):
    events, part = S.table(spark, sf_dir, "events"), S.table(spark, sf_dir, "part")
    plays, songs = S.plays(events), S.songs(part)
    wide = enrich.add_song(plays, songs)
    _same(heat.song_heat(plays, songs, length), windows.song_hot(wide, length))
    _same(heat.singer_heat(plays, songs, length), windows.singer_hot(wide, length))
    names = ("customer", "nation", "region")
    machines = S.machines(*[S.table(spark, sf_dir, n) for n in names])
    consume = S.consume(S.table(spark, sf_dir, "orders"))
    _same(
        regions.region_revenue(consume, machines, length),
        windows.region_revenue(enrich.consume_wide(consume, machines), length),
    )
    logins = S.logins(events)
    cells = S.regions(*[S.table(spark, sf_dir, n) for n in ("nation", "region")])
    _same(
        regions.region_login(logins, cells, length),
        windows.region_login(enrich.add_region(logins, cells), length),
    )


def test_counts_add_up_under_a_hot_song(spark):
    plays = spark.range(20_000).selectExpr(
        "if(id % 3 = 0, 'hot', string(id % 97)) songId", "'n' songName", "'s' singerInfo",
        "if(id % 5 = 0, 'skip', 'play') action", "id * 7 timestamp",
    )
    total = windows.song_hot(plays).agg(F.sum("playCount")).first()[0]
    assert total == plays.filter("action = 'play'").count()


def test_distinct_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(30), rng.randrange(60_000), rng.choice("ab"), "c", rng.choice("de"), "x")
            for _ in range(500)]
    expected: dict = {}
    for user, at, p, c, d, _ in rows:
        expected.setdefault((p, d, at // 10_000), set()).add(user)
    out = windows.region_login(spark.createDataFrame(rows, LOGIN))
    got = {(r.province, r.district, int(r.windowStart[-2:]) // 10): r.loginUserCount
           for r in out.collect()}
    assert got == {k: len(v) for k, v in expected.items()}
