from __future__ import annotations

import base64
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.fixed_values import LOGIN_EVENT, SONG_EVENT
from cadenza.operators import decode, user_log
from cadenza.schemas import CLEAN_PLAY


def _wrap(text: str) -> str:
    return base64.b64encode(text.encode()).decode()


def _events(spark, events):
    return spark.createDataFrame(
        [(i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)],
        "i int, event string",
    )


def _song(content, **top):
    return {"timestamp": "1704067199", "mid": "5", "event_type": SONG_EVENT,
            "event_content": content, **top}


LOGIN = {"event_id": "e", "uid": 1, "event_type": LOGIN_EVENT, "lng": "121.4", "lat": "31.2",
         "login_dt": 1704067199000, "mid": 3}


def test_decode(spark):
    messages = ["@@@", _wrap("{}"), _wrap("[]"), _wrap('[{"a":1},{"b":"歌"}]'), _wrap("x"), None]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "i int, value string")
    rows = decode.decode_events(df).collect()
    assert [(r.i, r.event) for r in rows] == [(3, '{"a":1}'), (3, '{"b":"歌"}')]
    assert [r.i for r in decode.undecodable_messages(df).orderBy("i").collect()] == [0, 1, 4, 5]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=20), min_size=1, max_size=5))
def test_encode_then_decode(spark, texts):
    df = spark.createDataFrame([([{"t": t} for t in texts],)], "events array<struct<t:string>>")
    back = decode.decode_events(decode.encode_events(df))
    got = [r[0] for r in back.select(F.from_json("event", "t string")["t"]).collect()]
    assert got == texts


def test_nested_object_as_object_text_or_absent(spark):
    content = {"songid": "s", "uid": "12", "optrate_type": 0}
    split = user_log.split_user_log(
        _events(spark, [_song(content), _song(json.dumps(content)), _song(None),
                        _song({"songid": None, "uid": 1}), _song({"songid": "s", "uid": None})])
    )
    rows = split.orderBy("i").collect()
    assert [r.reason for r in rows] == [None, None] + ["invalid event"] * 3
    assert [r.userId for r in user_log.play_branch(split).collect()] == [12, 12]


def test_routes(spark):
    def content(code):
        return {"songid": "s", "uid": 1, "optrate_type": code}

    split = user_log.split_user_log(
        _events(spark, [*[_song(content(c)) for c in (0, 1, 2, 9, None, "0", "abc")], LOGIN,
                        {"event_type": "X"}, "junk"])
    )
    assert [r.route for r in split.orderBy("i").collect()] == [
        "play", "pause", "skip", "other", "other", "play", "unknown", "login_location",
        "unknown", "unknown",
    ]
    assert sorted(r.action for r in user_log.other_branch(split).collect()) == [
        "other", "other", "pause", "skip",
    ]
    assert {r.reason for r in user_log.quarantined(split).collect()} == {
        "invalid event", "unknown operation",
    }


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([SONG_EVENT, LOGIN_EVENT, "Y", None]), min_size=1, max_size=6),
       st.lists(st.sampled_from(["0", "1", "2", "7", "", "x", None]), min_size=6, max_size=6))
def test_routing_is_total_and_exclusive(spark, kinds, codes):
    df = spark.createDataFrame(list(zip(kinds, codes)), "k string, c string")
    routes = [r[0] for r in df.select(user_log.route_of(F.col("k"), F.col("c"))).collect()]
    allowed = {"play", "pause", "skip", "other", "login_location", "unknown"}
    assert len(routes) == len(kinds) and set(routes) <= allowed


def test_clean_row(spark):
    inner = {"songid": 7, "uid": 1, "optrate_type": 0, "mid": 7}
    split = user_log.split_user_log(
        _events(spark, [_song(inner, mid=None), _song(inner), _song(inner, timestamp="x"),
                        _song({"songid": 7, "uid": 1}, mid=None)])
    )
    rows = user_log.play_branch(split).orderBy("machineId").collect()
    assert [r.machineId for r in rows] == [5, 7]
    r = rows[1]
    assert (r.songId, r.timestamp, r.date, r.hour, r.ip, r.city) == (
        "7", 1704067199000, "2023-12-31", "23", "", "",
    )
    assert sorted(x.reason for x in user_log.quarantined(split).collect()) == [
        "bad machine id", "bad timestamp",
    ]


@pytest.mark.parametrize("missing", ["event_id", "uid", "lng", "lat", "login_dt", "mid"])
def test_login_needs_every_field(spark, missing):
    broken = {k: v for k, v in LOGIN.items() if k != missing}
    split = user_log.split_user_log(_events(spark, [LOGIN, broken]))
    rows = user_log.login_branch(split).collect()
    assert [(r.userId, r.loginDt, r.machineId, r.hour) for r in rows] == [
        (1, 1704067199000, 3, "23")
    ]


def test_typed_record_round_trip(spark):
    split = user_log.split_user_log(_events(spark, [_song({"songid": "s", "uid": 1,
                                                            "optrate_type": 0})]))
    plays = user_log.play_branch(split)
    back = decode.parse_records(decode.to_json_value(plays), CLEAN_PLAY)
    assert back.collect() == plays.collect()


def test_no_time_or_operation_stops_the_log(spark):
    """Times beyond the calendar and operations beyond an int are set aside."""
    song = {"mid": "1", "event_type": SONG_EVENT}
    content = {"songid": "s", "uid": 1, "optrate_type": 0}
    login = {"event_id": "e", "uid": 1, "event_type": LOGIN_EVENT, "lng": "1", "lat": "1", "mid": 1}
    events = [
        song | {"timestamp": "1704067199000000", "event_content": content},
        song | {"timestamp": "9223372036854775", "event_content": content},
        song | {"timestamp": "1", "event_content": content | {"optrate_type": 99999999999}},
        login | {"login_dt": 9223372036854775807},
        login | {"login_dt": 1},
    ]
    df = spark.createDataFrame([(json.dumps(e),) for e in events], "event string")
    split = user_log.split_user_log(df)
    reasons = [r.reason for r in split.select("reason").collect()]
    assert reasons == ["bad timestamp", "bad timestamp", "unknown operation", "bad timestamp", None]
    assert user_log.clean_plays(split).collect() == []
    assert len(user_log.login_branch(split).collect()) == 1
