"""Late rows, metrics, state, kept places, start marks and the answering job."""

from __future__ import annotations

import base64
import json
import time

import streams
from pyspark.sql import functions as F

from cadenza.fixed_values import LOGIN_EVENT, TOPICS
from cadenza.operators import windows
from cadenza.schemas import SONG_PLAY_WIDE
from cadenza.sources.dimensions import DimensionStore
from cadenza.sources.places import PlaceStore
from cadenza.sources.serving import ServingTable
from cadenza.sources.topics import FolderTopics
from cadenza.streaming import jobs, state
from cadenza.streaming.attribution import attribute_stream
from cadenza.streaming.late import BatchMetrics, LateRows, observe_refusals, read_metrics

NOW = {"availableNow": True}


def _plays(spark, *rows):
    names = SONG_PLAY_WIDE.names
    full = [{"userId": 1, "songId": s, "machineId": 1, "action": a, "timestamp": t} for t, s, a in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], SONG_PLAY_WIDE)


def test_late_plays_are_counted_and_kept(spark, tmp_path):
    wh = jobs.Warehouse(spark, str(tmp_path), FolderTopics(str(tmp_path)), trigger=NOW)
    batches = [
        [(1_000, "a", "play"), (30_000, "b", "play")],
        [(2_000, "a", "play"), (19_999, "c", "play"), (20_000, "d", "play"), (5_000, "x", "pause")],
        [],
        [(29_000, "e", "play"), (60_000, "f", "play"), (None, "g", "play")],
    ]
    for i, rows in enumerate(batches):
        wh.write(_plays(spark, *rows), "dwm_song_play", i)
        assert jobs.late_play_job(wh).awaitTermination(120)
    late = LateRows(spark, wh.path("late_plays"), "10 seconds", 3)
    assert sorted(tuple(r) for r in late.counts().collect()) == [(0, 2, 0), (1, 3, 2), (2, 0, 0), (3, 2, 0)]
    rows = late.rows(SONG_PLAY_WIDE).collect()
    assert sorted((r.songId, r.timestamp, r.reason) for r in rows) == [("a", 2_000, "window was closed"), ("c", 19_999, "window was closed")]


def test_replayed_late_batches(spark, tmp_path):
    late = LateRows(spark, str(tmp_path / "l"), "10 seconds", 0)
    first, second = (windows.play_times(_plays(spark, *r)) for r in ([(50_000, "a", "play")], [(1_000, "b", "play")]))
    late.each(first, 0)
    late.each(second, 1)
    late.each(second, 1)
    # an attempt that wrote its rows but not its state is made again
    late.log.commit(lambda old: {**old, "applied": {"batch-0": 0}})
    late.each(second, 1)
    assert sorted(tuple(r) for r in late.counts().collect()) == [(0, 1, 0), (1, 1, 1)]
    assert late.rows(SONG_PLAY_WIDE).count() == 1


def test_metrics_of_each_batch(spark, tmp_path):
    listener = BatchMetrics(spark, str(tmp_path / "metrics"))
    spark.streams.addListener(listener)
    try:
        streams.write_in_order(spark, [_plays(spark, (1_000, "a", "play"), (40_000, "b", "play")), _plays(spark, (2_000, "a", "play"), (50_000, None, "play"))], str(tmp_path / "in"))
        source = spark.readStream.schema(SONG_PLAY_WIDE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        seen = observe_refusals(source, "refused", {"no_song": F.col("songId").isNull()})
        running = (
            windows.song_hot(seen, delay="3 seconds").writeStream.queryName("hot").outputMode("append")
            .option("checkpointLocation", str(tmp_path / "c")).trigger(**NOW).foreachBatch(lambda b, i: b.count()).start()
        )
        assert running.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    rows = {r["batch"]: r for r in read_metrics(spark, str(tmp_path / "metrics")).filter("query = 'hot'").collect()}
    assert [rows[i]["rows_in"] for i in (0, 1)] == [2, 2]
    assert [rows[i]["observed"]["refused.no_song"] for i in (0, 1)] == [0, 1]
    assert [rows[i]["observed"]["refused.rows"] for i in (0, 1)] == [2, 2]
    assert sum(r["dropped_state_rows"] for r in rows.values()) <= 1
    assert read_metrics(spark, str(tmp_path / "nothing")).count() == 0


def test_state_before_and_after_expiry(spark, tmp_path):
    row = "kind string, eventId string, requestId string, at string, intentType string, intentGroup string, feedbackType string"

    def run(rows, wait_ms):
        spark.createDataFrame(rows, row).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        s = spark.readStream.schema(row).parquet(str(tmp_path / "in"))
        out = attribute_stream(
            s.filter("kind = 'R'").select("eventId", "requestId", F.col("at").alias("responseTime"), "intentType", "intentGroup"),
            s.filter("kind = 'F'").select("eventId", "requestId", F.lit(1).alias("userId"), F.col("at").alias("feedbackTime"), "feedbackType"),
            wait_ms=wait_ms,
        )
        query = out.writeStream.option("checkpointLocation", checkpoint).trigger(**NOW).foreachBatch(lambda b, i: b.count()).start()
        assert query.awaitTermination(120)
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")

    checkpoint = str(tmp_path / "c")
    f = ("F", "f", "a", "2024-01-01 10:00:00", None, None, "LIKE")
    run([f, f, ("R", "r", "b", "2024-01-01 10:00:00", "I", "G", None)], 1000)
    assert [tuple(r) for r in state.waiting_feedback(spark, checkpoint).collect()] == [("a", "2024-01-01 10:00:00", "LIKE", 2)]
    assert [tuple(r) for r in state.known_intents(spark, checkpoint).collect()] == [("b", "I", "G")]
    (timer,) = state.registered_timers(spark, checkpoint).collect()
    assert timer["requestId"] == "a" and timer["at"] > 1_700_000_000_000
    # the timer has passed when the next micro-batch comes
    time.sleep(1.1)
    run([("F", "g", "c", "2024-01-01 11:00:00", None, None, "CLICK")], 3_600_000)
    assert [r["requestId"] for r in state.waiting_feedback(spark, checkpoint).collect()] == ["c"]
    assert [r["requestId"] for r in state.registered_timers(spark, checkpoint).collect()] == ["c"]
    before = state.waiting_feedback(spark, checkpoint, batch_id=0).collect()
    assert [r["requestId"] for r in before] == ["a"]
    assert {r["operatorName"] for r in state.operators(spark, checkpoint).collect()} == {"transformWithStateInPandasExec"}


LOGIN_ROW = "eventId string, userId long, eventType string, lng string, lat string, loginDt long, machineId long, date string, hour string"


def test_a_place_is_asked_once_and_refused_ones_a_few_times(spark, tmp_path):
    asked = str(tmp_path / "asked")
    places = PlaceStore(DimensionStore(spark, str(tmp_path / "places")), most_tries=2, compact_after=3)

    def resolver(keys):
        import uuid

        with open(f"{asked}-{uuid.uuid4().hex}", "w") as out:
            out.write("\n".join(keys))
        if any(k.startswith("9") for k in keys):
            return json.dumps({"status": "0"})
        entries = [{"addressComponent": {"province": f"P{k[0]}", "city": "C", "district": "D", "adcode": "1"}} for k in keys]
        return json.dumps({"status": "1", "infocode": "10000", "regeocodes": entries})

    def batch(n, *lngs):
        rows = [(str(i), 1, LOGIN_EVENT, lng, "2", 1000, 1, "d", "h") for i, lng in enumerate(lngs)]
        found = places.resolve(spark.createDataFrame(rows, LOGIN_ROW), resolver, n, batch_size=1)
        return sorted((r.lng, r.province) for r in found.collect())

    assert batch(0, "1", "1", "2") == [("1", "P1"), ("1", "P1"), ("2", "P2")]
    assert batch(1, "2", "3", "9") == [("2", "P2"), ("3", "P3"), ("9", None)]
    assert batch(2, "1", "9", "3") == [("1", "P1"), ("3", "P3"), ("9", None)]
    assert batch(3, "9", "2", "1") == [("1", "P1"), ("2", "P2"), ("9", None)]
    calls = sorted(open(f).read()[0] for f in map(str, tmp_path.glob("asked-*")))
    assert calls == ["1", "2", "3", "9", "9"]


def test_latest_and_earliest_of_folder_topics(spark, tmp_path):
    def send(wh, value):
        events = [{"event_id": value, "uid": 1, "event_type": LOGIN_EVENT, "lng": "1", "lat": "2", "login_dt": 1000, "mid": 1}]
        line = base64.b64encode(json.dumps(events).encode()).decode()
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(wh.topics.path(TOPICS["ods_user_log"]))

    topics = FolderTopics(str(tmp_path / "topics"))
    latest = jobs.Warehouse(spark, str(tmp_path / "l"), topics, trigger=NOW, mark_folders=True)
    earliest = jobs.Warehouse(spark, str(tmp_path / "e"), topics, trigger=NOW, mark_folders=True, starting={"user_log": "earliest"})
    send(latest, "1")
    for step in ("2", "3"):
        for wh in (latest, earliest):
            assert jobs.user_log_job(wh).awaitTermination(120)
        send(latest, step)
    for wh in (latest, earliest):
        assert jobs.user_log_job(wh).awaitTermination(120)
    found = [sorted(r.eventId for r in spark.read.parquet(wh.path("dwd_login")).collect()) for wh in (latest, earliest)]
    assert found == [["2", "3"], ["1", "2", "3"]]


def test_questions_to_intents_end_to_end(spark, tmp_path):
    wh = jobs.Warehouse(
        spark, str(tmp_path), FolderTopics(str(tmp_path / "topics")), trigger=NOW,
        starting={"answers": "earliest"},
    )
    served = ServingTable(spark, wh.path("dm_song_hot_10s"))
    board = "window_start timestamp, window_end timestamp, song_id string, song_name string, play_count long"
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' s, timestamp'2024-01-01 00:00:10' e, 'x' i, 'X' n, 5L c union all "
                     "select timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:00:10', 'y', 'Y', 7L").toDF(*[c.split()[0] for c in board.split(", ")])
    served.write(rows, 0)

    def ask(*requests):
        lines = spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in requests], "value string")
        lines.coalesce(1).write.mode("append").text(wh.topics.path(jobs.REQUESTS))
        assert jobs.answer_job(wh).awaitTermination(120)

    ask(
        {"requestId": "q1", "sessionId": "s", "userId": 1, "queryText": "现在最火的歌有哪些", "sentAt": "2024-01-01 00:01:00"},
        {"userId": 2, "queryText": "天气", "sentAt": "2024-01-01 00:01:01"},
        {"userId": 2, "queryText": " ", "sentAt": "2024-01-01 00:01:02"},
    )
    ask(
        {"requestId": "q1", "sessionId": "s", "userId": 1, "feedbackType": "LIKE", "sentAt": "2024-01-01 00:01:05"},
        {"requestId": "q1", "userId": 1, "feedbackType": "LIKE", "sentAt": "2024-01-01 00:01:06"},
        {"requestId": "z", "sessionId": "s", "userId": 1, "queryText": "热门歌手", "sentAt": "2024-01-01 01:00:00"},
    )
    assert sorted(r.reason.split()[0] for r in spark.read.parquet(wh.path("quarantine_requests")).collect()) == ["queryText", "sessionId"]
    texts = {r.requestId: r.answerText for r in spark.read.parquet(wh.path("answers")).collect()}
    assert "《Y》" in texts["q1"] and len(texts) == 3
    assert jobs.assistant_log_job(wh).awaitTermination(120)
    assert spark.read.parquet(wh.path("dwd_ai_query")).count() == 3
    assert [(r.requestId, r.feedbackType) for r in wh.read("dwd_ai_feedback").collect()] == [("q1", "LIKE")]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    assert jobs.ai_intent_delta_job(wh).awaitTermination(180)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    assert jobs.ai_intent_job(wh).awaitTermination(120)
    intents = wh.serving("dm_ai_intent_10s").read().collect()
    assert sorted((r.intent_type, r.request_count, r.like_count) for r in intents) == [("HOT_SONG_QUERY", 1, 1), ("OTHER", 1, 0)]


def test_login_parts_over_micro_batches(spark, tmp_path):
    """Users of three micro-batches, one of them late, merged into hours and days."""
    wh = jobs.Warehouse(spark, str(tmp_path), FolderTopics(str(tmp_path)), trigger=NOW)
    wide = LOGIN_ROW + ", province string, city string, district string, adcode string"
    hour = 3_600_000
    batches = [
        [(1, 1_000, "A"), (2, 2_000, "B"), (1, hour + 1, "A")],
        [(3, 2 * hour, "C"), (1, 2 * hour + 5, "A")],
        [(2, 500, "Z"), (4, 2_500, "A"), (None, 1, "A")],
    ]
    for i, rows in enumerate(batches):
        full = [(str(u), u, LOGIN_EVENT, "1", "2", t, 1, "d", "h", "P", "C", "D", code) for u, t, code in rows]
        wh.write(spark.createDataFrame(full, wide), "dwm_login", i)
        assert jobs.region_login_parts_job(wh).awaitTermination(120)
    per_hour = sorted((r.windowStart[11:13], r.loginUserCount, r.adcode) for r in jobs.region_logins(wh, "1 hour").collect())
    assert per_hour == [("00", 3, "Z"), ("01", 1, "A"), ("02", 2, "C")]
    assert [(r.loginUserCount, r.adcode) for r in jobs.region_logins(wh, "1 day").collect()] == [(4, "Z")]
    assert jobs.compact_serving(wh, least=2, keep=1) == {jobs.LOGIN_PARTS: ["1970-01-01"]}
    assert [(r.loginUserCount, r.adcode) for r in jobs.region_logins(wh, "1 day").collect()] == [(4, "Z")]
