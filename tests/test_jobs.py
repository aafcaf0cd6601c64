from __future__ import annotations

import base64
import json
import time

from pyspark.sql import functions as F

from cadenza.fixed_values import LOGIN_EVENT, SONG_EVENT, TOPICS
from cadenza.operators import boards
from cadenza.schemas import DIM_GEO_REGION, ROUTING_CONFIG
from cadenza.sources.files import write_batch
from cadenza.sources.topics import FolderTopics, starting_offsets
from cadenza.streaming import jobs

NOW = {"availableNow": True}


def _warehouse(spark, tmp_path, **more):
    config = spark.createDataFrame(
        [
            ("song", "d", "dim", "source_id",
             "name,album,singer_info,post_time,authorized_company", "DIM_SONG",
             TOPICS["dwd_dimension"]),
            ("machine", "d", "dim", "mid", "province,city,address", "DIM_MACHINE_LOCAL_INFO",
             TOPICS["dwd_dimension"]),
            ("consume", "d", "fact", "id", "mid,amount,action_time", "FACT", TOPICS["dwd_consume"]),
        ],
        ROUTING_CONFIG,
    )
    return jobs.Warehouse(
        spark, str(tmp_path), FolderTopics(str(tmp_path / "topics")), config=lambda s: config,
        trigger=NOW, **more,
    )


def _send(spark, wh, topic, lines):
    df = spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1)
    df.write.mode("append").text(wh.topics.path(TOPICS[topic]))
    time.sleep(1.05)


def _done(query):
    assert query.awaitTermination(180)


def _plays(*rows):
    events = [
        {"timestamp": str(t), "mid": "1", "event_type": SONG_EVENT,
         "event_content": {"songid": s, "uid": 1, "optrate_type": op}}
        for s, t, op in rows
    ]
    return base64.b64encode(json.dumps(events).encode()).decode()


def _change(table, kind, **data):
    return json.dumps({"database": "d", "table": table, "ts": 1, "type": kind, "data": data})


def test_song_line_sees_new_dimension_rows(spark, tmp_path):
    wh = _warehouse(spark, tmp_path, publish=frozenset({"dwd_play"}))
    _send(spark, wh, "ods_changes", [_change("song", "insert", source_id="a", name="A",
                                             singer_info='[{"name":"S"}]')])
    _done(jobs.change_log_job(wh))
    _send(spark, wh, "ods_user_log", [_plays(("a", 1, 0), ("b", 2, 0), ("a", 3, 1)), "@@@"])
    _done(jobs.user_log_job(wh))
    # b becomes known between the two batches, a gets a new name
    _send(spark, wh, "ods_changes", [
        _change("song", "insert", source_id="b", name="B", singer_info="T"),
        _change("song", "update", source_id="a", name="A2", singer_info="S"),
    ])
    _done(jobs.change_log_job(wh))
    _send(spark, wh, "ods_user_log", [_plays(("b", 4, 0), ("a", 5, 0), ("b", 60, 0))])
    _done(jobs.user_log_job(wh))

    wide = wh.read("dwm_song_play").orderBy("timestamp").collect()
    assert [(r.songId, r.songName, r.singerInfo) for r in wide] == [
        ("a", "A", "S"), ("b", None, None), ("b", "B", "T"), ("a", "A2", "S"), ("b", "B", "T"),
    ]
    assert spark.read.parquet(wh.path("dwd_other")).count() == 1
    assert spark.read.parquet(wh.path("quarantine_user_log_messages")).count() == 1
    published = wh.topics.read(spark, TOPICS["dwd_play"], stream=False)
    assert published.count() == 5

    _done(jobs.song_hot_job(wh))
    served = spark.read.parquet(wh.path("dm_song_hot_10s"))
    assert sorted((r.song_id, r.song_name, r.play_count) for r in served.collect()) == [
        ("a", "A", 2), ("b", "B", 2),
    ]
    assert [r.songName for r in boards.top_songs(served).collect()] == ["A", "B"]
    _done(jobs.singer_hot_job(wh))
    singers = spark.read.parquet(wh.path("dm_singer_hot_10s"))
    assert sorted((r.singer_info, r.play_count) for r in singers.collect()) == [("S", 2), ("T", 1)]


def test_revenue_and_login_lines(spark, tmp_path):
    wh = _warehouse(spark, tmp_path)
    rows = [_change("machine", "insert", mid="1", province="P", city="C"),
            _change("unknown", "insert", id="1")]
    rows += [
        _change("consume", kind, id=str(i), mid="1", amount="5", action_time=f"2024-01-01 00:00:0{i}")
        for i, kind in enumerate(["insert", "update", "insert"])
    ]
    rows.append(_change("consume", "insert", id="9", mid="1", amount="5",
                        action_time="2024-01-01 00:01:00"))
    _send(spark, wh, "ods_changes", rows)
    _done(jobs.change_log_job(wh))
    _done(jobs.region_revenue_job(wh))
    revenue = spark.read.parquet(wh.path("dm_region_revenue_10s")).collect()
    assert [(r.province, r.order_count, r.total_amount) for r in revenue] == [("P", 2, 10)]
    assert wh.topics.read_routed(spark, TOPICS["dwd_consume"]).count() == 4

    cells = spark.createDataFrame([(1000, 2000, "P", "C", "D", "A")], DIM_GEO_REGION)
    events = [
        {"event_id": str(i), "uid": u, "event_type": LOGIN_EVENT, "lng": "1.0001", "lat": "2.0",
         "login_dt": t, "mid": 1}
        for i, (u, t) in enumerate([(1, 1000), (1, 2000), (2, 3000), (2, 60_000)])
    ]
    _send(spark, wh, "ods_user_log", [base64.b64encode(json.dumps(events).encode()).decode()])
    _done(jobs.user_log_job(wh, regions=lambda s: cells))
    _done(jobs.region_login_job(wh))
    logins = spark.read.parquet(wh.path("dm_region_user_login_10s")).collect()
    assert [(r.adcode, r.login_user_count) for r in logins] == [("A", 2)]


def _assistant(kind, event, request, payload):
    return json.dumps({
        "eventId": event, "eventType": kind, "eventTime": "2024-01-01 00:00:00",
        "requestId": request, "sessionId": "s", "userId": 1, "payload": payload,
    })


def test_assistant_lines(spark, tmp_path):
    wh = _warehouse(spark, tmp_path)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")

    def response(event, request, at, intent):
        return _assistant("AI_RESPONSE", event, request, {
            "intentType": intent, "intentGroup": "G", "success": True, "latencyMs": 7,
            "responseTime": at, "responseSource": "RULE", "resultSongIds": ["x"],
        })

    _send(spark, wh, "ods_assistant", [
        response("1", "a", "2024-01-01 00:00:01", "I"),
        _assistant("AI_FEEDBACK", "2", "a",
                   {"feedbackType": "LIKE", "feedbackTime": "2024-01-01 00:00:02"}),
        _assistant("AI_QUERY", "3", "a", {"queryText": "q"}),
        response("4", "b", "2024-01-01 00:05:00", "J"),
        "broken",
    ])
    _done(jobs.assistant_log_job(wh))
    assert spark.read.parquet(wh.path("dwd_ai_query")).count() == 1
    assert [r.reason for r in spark.read.parquet(wh.path("quarantine_assistant")).collect()] == [
        "invalid envelope"
    ]
    _done(jobs.ai_overview_job(wh))
    overview = spark.read.parquet(wh.path("dm_ai_overview_10s")).collect()
    assert [(r.request_count, r.avg_latency_ms, r.like_count) for r in overview] == [(1, 7, 1)]

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    _done(jobs.ai_intent_delta_job(wh))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    _done(jobs.ai_intent_job(wh))
    intents = spark.read.parquet(wh.path("dm_ai_intent_10s")).collect()
    assert [(r.intent_type, r.request_count, r.like_count) for r in intents] == [("I", 1, 1)]


def test_replayed_batches_are_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    write_batch(spark.range(3), path, 4)
    write_batch(spark.range(5), path, 4)
    assert spark.read.parquet(path).count() == 3
    # what an aborted attempt leaves is seen by no reader, and is overwritten
    spark.range(7).write.parquet(f"{path}/.staged-batch_id=5")
    assert spark.read.parquet(path).count() == 3
    write_batch(spark.range(5), path, 5)
    assert spark.read.option("recursiveFileLookup", "true").parquet(path).count() == 8


def test_a_crash_between_write_and_commit_counts_no_window_twice(spark, tmp_path):
    wh = _warehouse(spark, tmp_path)
    play = {"userId": 1, "songId": "a", "machineId": 1, "action": "play", "ip": "", "city": ""}
    rows = [play | {"timestamp": t, "date": "d", "hour": "h", "songName": "A", "singerInfo": "S"} for t in (1_000, 2_000, 60_000)]
    schema = jobs.WIDE_TABLES["dwm_song_play"]
    plays = spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)
    # the attempt that died left its files; its replay writes them once more
    plays.write.parquet(f"{wh.path('dwm_song_play')}/.staged-batch_id=0")
    wh.write(plays, "dwm_song_play", 0)
    _done(jobs.song_hot_job(wh))
    # the replay of a batch that was written, but whose stream had not noted it
    wh.write(plays, "dwm_song_play", 0)
    _done(jobs.song_hot_job(wh))
    served = spark.read.parquet(wh.path("dm_song_hot_10s")).collect()
    assert [(r.song_id, r.play_count) for r in served] == [("a", 2)]


def test_routed_topics_are_read_as_streams(spark, tmp_path):
    topics = FolderTopics(str(tmp_path / "topics"))
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "topic string, value string")
    topics.write_batch(rows, 0)
    spark.createDataFrame([("a", "9")], "topic string, value string").write.partitionBy("topic").text(
        str(tmp_path / "topics" / "_by_topic" / ".staged-batch_id=1")
    )
    out = str(tmp_path / "out")
    _done(
        topics.read_routed(spark, "a", stream=True).select("value").writeStream.trigger(**NOW)
        .option("checkpointLocation", str(tmp_path / "checkpoint")).format("parquet").start(out)
    )
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == ["1", "3"]


def test_geocoder_in_the_user_log_job(spark, tmp_path):
    wh = _warehouse(spark, tmp_path)
    logins = [
        {"event_id": str(i), "uid": i, "event_type": LOGIN_EVENT, "lng": lng, "lat": "2", "login_dt": 1_000, "mid": 1}
        for i, lng in enumerate(("1", "1", "5"))
    ]
    _send(spark, wh, "ods_user_log", [base64.b64encode(json.dumps(logins).encode()).decode()])

    def resolver(keys):
        place = {"province": "P", "city": "C", "district": "D", "adcode": "1"}
        entries = [{"addressComponent": place} if k.startswith("1") else None for k in keys]
        return json.dumps({"status": "1", "infocode": "10000", "regeocodes": entries})

    _done(jobs.user_log_job(wh, resolver=resolver))
    rows = wh.read("dwm_login").collect()
    assert sorted((r.userId, r.province) for r in rows if r.province) == [(0, "P"), (1, "P")]
    assert spark.read.parquet(wh.path("quarantine_geocode")).count() == 1


def test_start_modes(spark, tmp_path):
    seen = {}

    class Topics(FolderTopics):
        def read(self, spark, topic, starting="latest", stream=True):
            seen[topic] = starting
            return super().read(spark, topic, starting, stream)

    wh = jobs.Warehouse(spark, str(tmp_path), Topics(str(tmp_path)), starting={"user_log": "earliest"})
    for topic, job in (("ods_user_log", "user_log"), ("ods_changes", "change_log"), ("ods_assistant", "assistant_log")):
        (tmp_path / TOPICS[topic]).mkdir()
        wh.messages(topic, job)
    assert list(seen.values()) == ["earliest", "latest", "earliest"]


def test_topics_by_row(spark, tmp_path):
    topics = FolderTopics(str(tmp_path))
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "topic string, value string")
    topics.write_batch(rows, 0)
    topics.write_batch(rows, 0)
    assert sorted(r.value for r in topics.read_routed(spark, "a").collect()) == ["1", "3"]


def test_positions_order_the_lines_of_a_folder(spark, tmp_path):
    topics = FolderTopics(str(tmp_path))
    for part in (["a", "b"], ["c"]):
        spark.createDataFrame([(v,) for v in part], "value string").coalesce(1).write.mode(
            "append"
        ).text(topics.path("t"))
        time.sleep(1.05)
    rows = topics.ordered(topics.read(spark, "t", stream=False)).orderBy("seq")
    assert [r.value for r in rows.collect()] == ["a", "b", "c"]


def test_starting_offsets():
    assert [starting_offsets(m) for m in ("latest", "LATEST", "earliest", "x", None)] == [
        "latest", "latest", "earliest", "earliest", "earliest",
    ]
