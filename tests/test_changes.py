from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from cadenza.schemas import ROUTING_CONFIG
from cadenza.operators import changes, enrich
from cadenza.sources.dimensions import DimensionStore

CONFIG = "tbl_name string, tbl_db string, tbl_type string, pk_col string, cols string, " \
         "phoenix_tbl_name string, sink_topic string"


def _messages(spark, rows, first=0):
    return spark.createDataFrame(
        [(i, m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(rows, first)],
        "seq long, value string",
    )


def _change(kind, table="song", **data):
    return {"database": "d", "table": table, "ts": 1, "type": kind, "data": data or None}


def _config(spark, *rows):
    return spark.createDataFrame(list(rows), CONFIG)


SONG = ("song", "d", "dim", "source_id", "name, singer_info,album,authorized_company", "DIM_SONG",
        "dims")


def test_routing(spark):
    listed = spark.createDataFrame(
        [
            ("song", "d", "dim", "source_id", "old", "DIM_SONG", "a", 1), (*SONG, 2),
            ("silent", "d", "dim", "id", "x", "T", "", 3),
            ("null", "d", "dim", "id", "x", "T", None, 4),
        ],
        CONFIG + ", ord int",
    )
    config = changes.latest_config(listed, "ord")
    assert config.count() == 3
    rows = [
        _change("insert", source_id="1", type="source", name="n"),
        _change("insert", table="nowhere", id="1"),
        _change("insert"),
        "junk",
        _change("insert", table="silent", id="1"),
        _change("insert", table="null", id="1"),
    ]
    messages = _messages(spark, rows)
    assert changes.without_data(messages).count() == 2
    routed = changes.route_changes(changes.parse_changes(messages), config)
    out = changes.with_topic(routed).collect()
    assert [r.topic for r in out] == ["dims"]
    assert json.loads(out[0].value) == {
        "source_id": "1", "name": "n", "ts": "1", "pk_col": "source_id", "cols": SONG[4],
        "phoenix_table_name": "DIM_SONG", "sink_topic": "dims", "type": "insert",
    }
    assert changes.without_topic(routed).count() == 2


def _latest(spark, rows, first=0):
    config = _config(spark, SONG)
    routed = changes.route_changes(changes.parse_changes(_messages(spark, rows, first)), config)
    return changes.latest_changes(changes.applicable(routed))


def test_last_change_wins_and_columns_are_cleaned(spark):
    latest = _latest(spark, [
        _change("insert", source_id="1", name="a"),
        _change("update", source_id="1", name="b"),
        _change("delete", source_id="1"),
        _change("insert", source_id="1", name="c", singer_info='[{"name":"S"}]', album=" "),
        _change("bootstrap-insert", source_id="2", name="x"),
        _change("delete", source_id="2"),
        _change("truncate", source_id="3", name="x"),
        _change("insert", name="no key"),
    ])
    rows = changes.dimension_rows(changes.live_rows(latest), "DIM_SONG", "source_id", SONG[4])
    assert [tuple(r) for r in rows.collect()] == [("1", "c", "S", "无信息", "无信息")]
    plain = changes.dimension_rows(changes.live_rows(latest), "DIM_SONG", "source_id", " a, b ")
    assert plain.columns == ["source_id", "a", "b"]


def test_only_real_inserts_are_revenue(spark):
    rows = [{"id": 1, "mid": 2, "amount": 3, "action_time": "t", "type": t}
            for t in ("insert", "update", "bootstrap-insert")]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    assert [r.amount for r in enrich.valid_consume(enrich.parse_consume(df)).collect()] == [3]


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    latest = changes.latest_changes(
        spark.range(1000).selectExpr("'t' phoenix_table_name", "string(id % 2) pk", "id seq", "'insert' type")
    )
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert sorted(r.seq for r in latest.collect()) == [998, 999]


def test_snapshots_equal_one_pass_and_survive_replays(spark, tmp_path):
    rng = random.Random(5)
    rows = [
        _change(rng.choice(["insert", "update", "delete"]), source_id=str(rng.randrange(12)),
                name=str(i))
        for i in range(90)
    ]
    config = _config(spark, SONG)
    store = DimensionStore(spark, str(tmp_path))
    for batch_id, start in enumerate(range(0, 90, 30)):
        latest = _latest(spark, rows[start:start + 30], start)
        assert store.apply(latest, config, batch_id) == ["DIM_SONG"]
        once = sorted(map(tuple, store.read("DIM_SONG").collect()))
        store.apply(latest, config, batch_id)
        assert sorted(map(tuple, store.read("DIM_SONG").collect())) == once
    whole = changes.apply_changes(None, _latest(spark, rows), "DIM_SONG", "source_id", SONG[4])
    assert once == sorted(map(tuple, whole.collect()))
    store.expire("DIM_SONG", keep=1)
    assert sorted(map(tuple, store.read("DIM_SONG").collect())) == once


def test_unknown_dimension_is_empty(spark, tmp_path):
    from cadenza.schemas import DIM_SONG

    assert DimensionStore(spark, str(tmp_path)).read("DIM_SONG", DIM_SONG).count() == 0


def test_latest_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice(["insert", "delete"]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "pk string, type string, seq long").orderBy(F.rand(3))
    got = {r.pk: r.seq for r in changes.latest_changes(df, ["pk"]).collect()}
    assert got == {k: max(s for p, _, s in rows if p == k) for k in "abc"}


def test_a_doubled_key_keeps_its_last_value(spark):
    text = '{"database":"d","table":"t","ts":"1","type":"insert","data":{"amount":"1","id":"7","amount":"2","type":"x"}}'
    rows = changes.parse_changes(spark.createDataFrame([(text, 1)], "value string, seq int"))
    config = spark.createDataFrame([("t", "d", "dim", "id", "amount", "T", "topic")], ROUTING_CONFIG)
    (row,) = changes.route_changes(rows, config).collect()
    assert (row.data["amount"], row.data["id"], row.data["type"]) == ("2", "7", "insert")


def test_older_changes_that_come_later_change_nothing(spark, tmp_path):
    store = DimensionStore(spark, str(tmp_path))
    config = spark.createDataFrame([("t", "d", "dim", "id", "name", "T", "topic")], ROUTING_CONFIG)

    def apply(batch_id, *rows):
        texts = [
            (json.dumps({"database": "d", "table": "t", "ts": "1", "type": kind, "data": {"id": key, "name": name}}), seq)
            for seq, kind, key, name in rows
        ]
        parsed = changes.parse_changes(spark.createDataFrame(texts, "value string, seq int"))
        routed = changes.applicable(changes.route_changes(parsed, config))
        store.apply(changes.latest_changes(routed), config, batch_id)
        return sorted((r.id, r.name) for r in store.read("T").collect())

    assert apply(0, (5, "insert", "a", "new"), (6, "insert", "b", "x"), (9, "delete", "b", "x")) == [("a", "new")]
    assert apply(1, (4, "update", "a", "old"), (7, "update", "b", "old")) == [("a", "new")]
    assert apply(2, (10, "insert", "b", "again"), (11, "update", "a", "newer")) == [("a", "newer"), ("b", "again")]
    assert store.read("T").columns == ["id", "name"]
