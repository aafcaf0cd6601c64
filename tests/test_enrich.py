from __future__ import annotations

import json

import pytest

from cadenza.operators import enrich, geocode
from cadenza.schemas import CLEAN_PLAY, DIM_GEO_REGION, DIM_MACHINE_LOCAL_INFO, DIM_SONG, LOGIN


def _play(song):
    return (1, song, 2, "play", 1000, "", "", "d", "h")


def test_songs(spark):
    plays = spark.createDataFrame([_play("a"), _play("x"), _play(""), _play(None)], CLEAN_PLAY)
    songs = spark.createDataFrame(
        [("a", "A", "al", "S", "p", "c"), ("", "blank", "", "", "", "")], DIM_SONG
    )
    wide = enrich.add_song(plays, songs)
    assert {r.songId: r.songName for r in wide.collect()} == {
        "a": "A", "x": None, "": None, None: None,
    }
    assert wide.columns[-5:] == ["songName", "album", "singerInfo", "postTime",
                                 "authorizedCompany"]
    assert enrich.add_song(plays, songs, "songName").columns == [*CLEAN_PLAY.names, "songName"]


def test_machines_and_rates(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6)], "id long, mid long")
    machines = spark.createDataFrame([("5", "P", "C", "a")], DIM_MACHINE_LOCAL_INFO)
    wide = enrich.add_machine(rows, machines).orderBy("id").collect()
    assert [(r.province, r.city) for r in wide] == [("P", "C"), (None, None)]
    admin = spark.createDataFrame(
        [("5", "m", "p", "0.5", "x", None, "1")],
        "machine_num string, machine_name string, package_name string, inv_rate string, "
        "age_rate string, com_rate string, par_rate string",
    )
    r = enrich.add_machine(rows, machines, admin).orderBy("id").first()
    assert (r.machineName, r.invRate, r.ageRate, r.comRate, r.parRate) == ("m", 0.5, None, None, 1)


def _login(i, lng, lat):
    return (str(i), i, "E", lng, lat, 1000, 1, "d", "h")


def test_grid(spark):
    logins = spark.createDataFrame(
        [_login(1, "121.4737", "31.2304"), _login(2, "121.4735", "31.2304"),
         _login(3, "bad", "31.2304"), _login(4, None, "1")], LOGIN
    )
    regions = spark.createDataFrame([(121474, 31230, "P", "C", "D", "A")], DIM_GEO_REGION)
    rows = enrich.add_region(logins, regions).orderBy("userId").collect()
    # half a cell rounds up: 121.4735 is in cell 121474
    assert [(r.userId, r.province) for r in rows] == [(1, "P"), (2, "P"), (3, None)]


def _entry(i, city="C"):
    return {"addressComponent": {"province": f" P {i} ", "city": city, "district": "D",
                                 "adcode": str(i)}}


def test_archived_answers(spark):
    def answer(status, n, code="10000"):
        return json.dumps({"status": status, "infocode": code,
                           "regeocodes": [_entry(i, [] if i else "C") for i in range(n)]})

    df = spark.createDataFrame(
        [(1, ["a", "b", "c"], answer("1", 2)), (2, ["d"], answer("1", 3)),
         (3, ["e"], answer("0", 1)), (4, ["f"], answer("1", 1, "1")), (5, ["g"], "junk")],
        "call int, points array<string>, answer string",
    )
    rows = geocode.zip_answers(df).orderBy("point").collect()
    assert [(r.point, r.province, r.city, r.adcode) for r in rows] == [
        ("a", "P0", "C", "0"), ("b", "P1", " P 1 ", "1"), ("d", "P0", "C", "0"),
    ]


@pytest.mark.parametrize("n", [1, 10, 23])
def test_resolver_keeps_the_short_last_run(spark, n):
    def resolver(keys):
        import json

        assert len(keys) <= 10
        entries = [
            {"addressComponent": {"province": f" P {k.split(',')[0]} ", "city": "C",
                                  "district": "D", "adcode": k.split(",")[0]}}
            for k in keys
        ]
        return json.dumps({"status": "1", "infocode": "10000", "regeocodes": entries})

    logins = spark.createDataFrame([_login(i, str(i), "1") for i in range(n)], LOGIN).coalesce(1)
    rows = geocode.resolve_regions(logins, resolver).collect()
    assert sorted((r.userId, r.province, r.adcode) for r in rows) == [
        (i, f"P{i}", str(i)) for i in range(n)
    ]


@pytest.mark.parametrize("answer", ['{"status":"0"}', "no json", None, "[]", '{"status":"1","infocode":"10000","regeocodes":7}'])
def test_refused_runs_are_set_aside(spark, answer):
    logins = spark.createDataFrame([_login(1, "1", "1"), _login(2, "1", "1")], LOGIN)
    resolved = geocode.resolve_regions(logins, lambda keys: answer)
    rows = geocode.unresolved(resolved).collect()
    assert sorted((r.userId, r.province, r.reason) for r in rows) == [(1, None, "no region"), (2, None, "no region")]


def test_each_place_is_asked_for_once(spark):
    logins = spark.createDataFrame([_login(i, "1", "1") for i in range(30)], LOGIN)

    def resolver(keys):
        assert len(keys) == 1
        entry = {"addressComponent": {"province": "P", "city": "C", "district": "D", "adcode": "1"}}
        return json.dumps({"status": "1", "infocode": "10000", "regeocodes": [entry]})

    rows = geocode.resolve_regions(logins, resolver).collect()
    assert len(rows) == 30 and {r.province for r in rows} == {"P"}
