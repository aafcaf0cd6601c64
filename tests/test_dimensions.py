"""The dimension store: segments, out-of-order changes, columns, compaction, replays."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import changes
from cadenza.schemas import ROUTING_CONFIG
from cadenza.sources import files
from cadenza.sources.dimensions import DimensionStore, Snapshots
from cadenza.streaming import jobs
from cadenza.sources.topics import FolderTopics

TOPIC = "t"


def config_of(spark, *rows):
    """Rows of (source table, key column, columns), all feeding T."""
    return spark.createDataFrame([(t, "d", "dim", pk, cols, "T", TOPIC) for t, pk, cols in rows], ROUTING_CONFIG)


def latest_of(spark, config, rows):
    """The last changes of (seq, source table, type, data)."""
    texts = [(json.dumps({"database": "d", "table": t, "ts": "1", "type": k, "data": d}), s) for s, t, k, d in rows]
    parsed = changes.parse_changes(spark.createDataFrame(texts, "value string, seq int"))
    return changes.last_of_each_source(changes.applicable(changes.route_changes(parsed, config)))


def rows_of(store, **options):
    return sorted((tuple(r) for r in store.read("T", **options).collect()), key=repr)


def files_of(root):
    """Data files below a folder, with their sizes."""
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_a_batch_writes_only_its_buckets(spark, tmp_path):
    store = DimensionStore(spark, str(tmp_path), buckets=64)
    config = config_of(spark, ("s", "id", "name"))
    rows = [(i, "s", "insert", {"id": str(i), "name": f"a name of some length, number {i}"}) for i in range(20_000)]
    store.apply(latest_of(spark, config, rows), config, 0)
    assert store.compact("T", least=1)
    before = files_of(tmp_path)
    # a thousand keys of four of the buckets
    hashed = spark.range(20_000).select("id", F.pmod(F.hash(F.col("id").cast("string")), F.lit(64)).alias("b"))
    keys = [r.id for r in hashed.filter("b < 4").limit(1000).collect()]
    assert len(keys) == 1000
    store.apply(latest_of(spark, config, [(20_000 + k, "s", "update", {"id": str(k), "name": "new"}) for k in keys]), config, 1)
    new = {f: n for f, n in files_of(tmp_path).items() if f not in before}
    assert len(new) == 4 and sum(new.values()) < sum(before.values()) / 5
    assert files_of(tmp_path).items() >= before.items()
    known = store.manifest("T")
    assert known.changed_buckets == [0, 1, 2, 3] and len(known.base) == 64
    assert {r.id: r.name for r in store.read("T").filter("name = 'new'").collect()} == {str(k): "new" for k in keys}
    # compaction rewrites those four
    assert store.compact("T", least=1)
    newer = files_of(tmp_path).keys() - before.keys() - new.keys()
    assert len(newer) == 4 and store.manifest("T").changed_buckets == []
    assert store.read("T").count() == 20_000
    store.expire("T", keep=1)
    left = files_of(tmp_path)
    assert not left.keys() & new.keys() and len(left) >= 64
    assert store.read("T").filter("name = 'new'").count() == 1000


def model(batches):
    """The dimension by hand: every column's last value after the last deletion."""
    state: dict = {}
    for rows in batches:
        for seq, _, kind, key, values in rows:
            state.setdefault(key, []).append((seq, kind, values))
    out = []
    for key, log in state.items():
        gone = max((s for s, k, _ in log if k == "delete"), default=-1)
        live = sorted((s, v) for s, k, v in log if k != "delete" and s > gone)
        if live:
            merged: dict = {}
            for _, v in live:
                merged.update(v)
            out.append((key, merged.get("a"), merged.get("b"), merged.get("c")))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [2])
def test_out_of_order_batches_of_two_sources(spark, tmp_path, seed):
    """Columns of two source tables, deletions, batches in any order, compactions in between."""
    rng = random.Random(seed)
    config = config_of(spark, ("s", "id", "a, b"), ("t", "id", "b,c"))
    log = []
    for seq in range(160):
        source = rng.choice("st")
        kind = rng.choice(["insert", "update", "update", "delete"])
        names = ("a", "b") if source == "s" else ("b", "c")
        values = {n: f"{n}{seq}" for n in names if rng.random() < 0.8}
        log.append((seq, source, kind, str(rng.randrange(14)), values))
    rng.shuffle(log)
    store = DimensionStore(spark, str(tmp_path), buckets=4)
    seen = []
    for batch_id, start in enumerate(range(0, 160, 40)):
        part = log[start:start + 40]
        rows = [(s, t, k, {"id": key, **v}) for s, t, k, key, v in part]
        store.apply(latest_of(spark, config, rows), config, batch_id)
        # what a source lists and a row lacks is empty text
        full = [(s, t, k, key, {n: v.get(n, "") for n in (("a", "b") if t == "s" else ("b", "c"))}) for s, t, k, key, v in part]
        seen.append(full)
        assert rows_of(store) == model(seen)
        if batch_id % 2:
            assert store.compact("T", least=2)
            assert rows_of(store) == model(seen)
    assert store.manifest("T").columns == ["a", "b", "c"]


def test_a_column_that_is_added_later(spark, tmp_path):
    """The list grows from ``a`` to ``a,b``; older rows have no value there."""
    store = DimensionStore(spark, str(tmp_path))
    first, second = config_of(spark, ("s", "id", "a")), config_of(spark, ("s", "id", "a,b"))
    store.apply(latest_of(spark, first, [(1, "s", "insert", {"id": "1", "a": "x", "b": "hidden"}), (2, "s", "insert", {"id": "2", "a": "y"})]), first, 0)
    store.apply(latest_of(spark, second, [(3, "s", "update", {"id": "1", "a": "x2", "b": "z"})]), second, 1)
    assert rows_of(store) == [("1", "x2", "z"), ("2", "y", None)]
    assert store.read("T").columns == ["id", "a", "b"]
    assert rows_of(store, version=1) == [("1", "x"), ("2", "y")]
    assert store.compact("T", least=1)
    # a column that is dropped from the list keeps what it had
    store.apply(latest_of(spark, first, [(4, "s", "update", {"id": "1", "a": "x3"})]), first, 2)
    assert rows_of(store) == [("1", "x3", "z"), ("2", "y", None)]
    wanted = store.read("T", store.read("T").schema.add("d", "string"))
    assert wanted.columns == ["id", "a", "b", "d"] and wanted.filter("d is not null").count() == 0


def test_two_configuration_rows_for_one_dimension(spark, tmp_path):
    config = config_of(spark, ("s", "id", "a"), ("t", "id", "b"))
    for order in (config, config.orderBy(F.desc("cols"))):
        store = DimensionStore(spark, str(tmp_path / str(id(order))))
        store.apply(latest_of(spark, config, [(1, "s", "insert", {"id": "1", "a": "x"}), (2, "t", "insert", {"id": "1", "b": "y"})]), order, 0)
        assert rows_of(store) == [("1", "x", "y")]


def test_replays_and_new_checkpoints(spark, tmp_path, monkeypatch):
    store = DimensionStore(spark, str(tmp_path))
    config = config_of(spark, ("s", "id", "a"))

    def apply(run, batch_id, seq, value):
        monkeypatch.setattr(files, "current_run", lambda spark: run)
        store.apply(latest_of(spark, config, [(seq, "s", "insert", {"id": str(seq), "a": value})]), config, batch_id)
        return [r[1] for r in rows_of(store)]

    assert apply("one", 0, 1, "x") == ["x"]
    assert apply("one", 1, 2, "y") == ["x", "y"]
    assert apply("one", 1, 2, "y") == ["x", "y"] and store.manifest("T").version == 2
    assert store.compact("T", least=1)
    # a replay after compaction is still a replay; a stream with a new checkpoint is not
    assert apply("one", 1, 2, "other") == ["x", "y"]
    assert apply("two", 0, 3, "z") == ["x", "y", "z"]


def test_whoever_commits_second_starts_from_the_first(spark, tmp_path):
    """A batch that lands while compaction is writing stays a change on top of it."""
    store = DimensionStore(spark, str(tmp_path), buckets=2)
    config = config_of(spark, ("s", "id", "a"))

    def add(batch_id, value):
        store.apply(latest_of(spark, config, [(batch_id, "s", "insert", {"id": "1", "a": value})]), config, batch_id)

    add(0, "x")
    add(1, "y")
    write, inside = DimensionStore._write, []

    def slow(self, rows, table, key, buckets, segment):
        if segment.startswith("b-") and not inside:
            inside.append(segment)
            add(2, "z")
        return write(self, rows, table, key, buckets, segment)

    DimensionStore._write = slow
    try:
        assert store.compact("T", least=1)
    finally:
        DimensionStore._write = write
    assert list(store.manifest("T").changes) == ["c-batch-2-000000000002"]
    assert rows_of(store) == [("1", "z")]
    # an attempt that left its folder but no manifest is seen by nobody and overwritten
    store.read("T").write.parquet(str(tmp_path / "T" / "_segment=c-batch-3-000000000003" / "_bucket=0"))
    assert rows_of(store) == [("1", "z")]
    add(3, "w")
    assert rows_of(store) == [("1", "w")]


def test_snapshots_are_read_once_per_version(spark, tmp_path, monkeypatch):
    store = DimensionStore(spark, str(tmp_path))
    config = config_of(spark, ("s", "id", "a"))
    reads = []
    load = DimensionStore._load
    monkeypatch.setattr(DimensionStore, "_load", lambda self, *a: reads.append(1) or load(self, *a))
    held = Snapshots()
    empty = spark.createDataFrame([], "id string, a string").schema
    assert held.get(store, "T", empty).count() == 0 and not reads
    store.apply(latest_of(spark, config, [(1, "s", "insert", {"id": "1", "a": "x"})]), config, 0)
    first = held.get(store, "T", empty)
    assert [tuple(r) for r in first.collect()] == [("1", "x")] and first.storageLevel.useMemory
    assert held.get(store, "T", empty) is first and len(reads) == 1
    store.apply(latest_of(spark, config, [(2, "s", "update", {"id": "1", "a": "y"})]), config, 1)
    second = held.get(store, "T", empty)
    assert [tuple(r) for r in second.collect()] == [("1", "y")] and len(reads) == 2
    assert not first.storageLevel.useMemory
    held.clear()
    assert not second.storageLevel.useMemory


def test_job_sees_a_changed_list_and_compacts(spark, tmp_path):
    lists = {"cols": "a"}

    def config(session):
        return session.createDataFrame([("s", "d", "dim", "id", lists["cols"], "T", "dwd_dim_info_rt")], ROUTING_CONFIG)

    wh = jobs.Warehouse(spark, str(tmp_path), FolderTopics(str(tmp_path / "topics")), config=config, trigger={"availableNow": True}, starting={"change_log": "earliest"})

    def send(**data):
        text = json.dumps({"database": "d", "table": "s", "ts": 1, "type": "insert", "data": data})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(wh.topics.path(jobs.TOPICS["ods_changes"]))
        assert jobs.change_log_job(wh).awaitTermination(120)

    send(id="1", a="x", b="p")
    lists["cols"] = "a,b"
    send(id="2", a="y", b="q")
    assert rows_of(wh.dimensions) == [("1", "x", None), ("2", "y", "q")]
    known = wh.dimensions.manifest("T")
    (run,) = known.applied
    assert known.applied[run] == 1 and all(s.startswith(f"c-{run}-") for s in known.changes)
    assert jobs.compact_dimensions(wh, least=5) == []
    assert jobs.compact_dimensions(wh, least=2, keep=1) == ["T"]
    assert wh.dimensions.versions("T") == [3]
    assert rows_of(wh.dimensions) == [("1", "x", None), ("2", "y", "q")]


def test_batches_of_another_stream_are_no_replay(spark, tmp_path, monkeypatch):
    """A query that lost its checkpoint counts from 0 again; its batches are written."""
    path = str(tmp_path / "t")
    for run, rows in (("one", 3), ("two", 5), ("two", 7)):
        monkeypatch.setattr(files, "current_run", lambda spark, run=run: run)
        files.write_batch(spark.range(rows), path, 0)
    assert spark.read.option("recursiveFileLookup", "true").parquet(path).count() == 8
    topics = FolderTopics(str(tmp_path / "topics"))
    for run in ("one", "two", "two"):
        monkeypatch.setattr(files, "current_run", lambda spark, run=run: run)
        topics.write_batch(spark.createDataFrame([("a", run)], "topic string, value string"), 0)
    assert sorted(r.value for r in topics.read_routed(spark, "a").collect()) == ["one", "two"]
