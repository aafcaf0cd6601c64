"""Serving tables with a manifest, and distinct users from mergeable parts."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from cadenza.operators import distinct, enrich, windows
from cadenza.plans import stand_ins as S
from cadenza.sources import files
from cadenza.sources.serving import ServingTable

START = dt.datetime(2024, 1, 1, 23, 59, 0)
SCHEMA = "window_start timestamp_ntz, window_end timestamp_ntz, song_id string, song_name string, play_count long"


def stats(spark, *rows):
    """Rows of (window number, song, plays)."""
    ten = dt.timedelta(seconds=10)
    return spark.createDataFrame([(START + n * ten, START + (n + 1) * ten, s, s, c) for n, s, c in rows], SCHEMA)


def numbers(df):
    return sorted((int((r.window_start - START).total_seconds() // 10), r.song_id, r.play_count) for r in df.collect())


def data_files(root):
    return {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_newest_window_reads_one_date_and_its_files(spark, tmp_path):
    table = ServingTable(spark, str(tmp_path / "t"))
    batches = [[(0, "a", 1), (1, "a", 2)], [(5, "b", 3), (6, "b", 9)], [], [(6, "c", 4), (2, "z", 1)], [(3, "y", 1)]]
    for i, rows in enumerate(batches):
        table.write(stats(spark, *rows), i)
        table.write(stats(spark, *rows), i)
    assert numbers(table.read()) == sorted(r for b in batches for r in b)
    newest = table.newest_window()
    assert numbers(newest) == [(6, "b", 9), (6, "c", 4)]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(_date" in scan and "_date#" in scan and "= 2024-01-02)" in scan
    assert "window_end" in scan.split("PushedFilters")[1]
    read = {f.split("/t/")[1].split("/")[0] for f in newest.inputFiles()}
    assert read == {"_segment=c-batch-1-000000000001", "_segment=c-batch-3-000000000003"}


def test_compaction_keeps_rows_and_leaves_few_files(spark, tmp_path):
    path = str(tmp_path / "t")
    table = ServingTable(spark, path)
    rows = [(n, f"s{n % 3}", n) for n in range(12)]
    for n, row in enumerate(rows):
        table.write(stats(spark, row), n)
    before = data_files(path)
    assert len(before) == 12 and table.compact(least=100) == []
    # five windows end on the first date, seven on the second
    assert table.compact(least=6) == ["2024-01-02"]
    assert len(data_files(path) - before) == 1
    assert numbers(table.read()) == rows
    assert numbers(table.newest_window()) == [rows[-1]]
    table.write(stats(spark, (20, "new", 1)), 12)
    assert numbers(table.newest_window()) == [(20, "new", 1)]
    assert numbers(table.read(version=12)) == rows
    assert table.compact(least=2) == ["2024-01-01", "2024-01-02"]
    table.expire(keep=1)
    assert len(data_files(path)) == 2 and numbers(table.read()) == [*rows, (20, "new", 1)]
    # a replay of a batch that was compacted away adds nothing
    table.write(stats(spark, rows[3]), 3)
    assert numbers(table.read()) == [*rows, (20, "new", 1)]


def test_a_batch_written_beside_a_compaction_stays(spark, tmp_path, monkeypatch):
    table = ServingTable(spark, str(tmp_path / "t"))
    for n in range(3):
        table.write(stats(spark, (n, "a", n)), n)
    write, inside = ServingTable._write, []

    def slow(self, rows, segment):
        if segment.startswith("m-") and not inside:
            inside.append(segment)
            table.write(stats(spark, (3, "late", 1)), 3)
        return write(self, rows, segment)

    monkeypatch.setattr(ServingTable, "_write", slow)
    assert table.compact(least=3) == ["2024-01-01"]
    assert numbers(table.read()) == [(0, "a", 0), (1, "a", 1), (2, "a", 2), (3, "late", 1)]
    # an attempt without a manifest entry is read by nobody
    stats(spark, (9, "ghost", 1)).write.parquet(str(tmp_path / "t" / "_segment=c-x-1" / "_date=2024-01-02"))
    assert len(numbers(table.read())) == 4


def test_streams_of_two_checkpoints(spark, tmp_path, monkeypatch):
    table = ServingTable(spark, str(tmp_path / "t"))
    for run, rows in (("one", (0, "a", 1)), ("two", (1, "b", 1)), ("two", (2, "c", 1))):
        monkeypatch.setattr(files, "current_run", lambda spark, run=run: run)
        table.write(stats(spark, rows), 0)
    assert numbers(table.read()) == [(0, "a", 1), (1, "b", 1)]


def _wide(spark, sf_dir):
    logins = S.logins(S.table(spark, sf_dir, "events"))
    return enrich.add_region(logins, S.regions(S.table(spark, sf_dir, "nation"), S.table(spark, sf_dir, "region")))


def test_parts_merge_in_any_order_and_more_than_once(spark, sf_dir, tmp_path):
    wide = _wide(spark, sf_dir)
    path = str(tmp_path / "parts")
    # overlapping appends, the last one a replay of the first
    for part in ("userId % 2 = 0", "userId % 3 <> 0", "true", "userId % 2 = 0"):
        distinct.login_parts(wide.filter(part)).write.mode("append").parquet(path)
    parts = spark.read.parquet(path)
    for length in ("10 seconds", "1 hour", "1 day"):
        expected = windows.region_login(wide, length)
        found = distinct.login_totals(parts, length).select(expected.columns)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_words_hold_every_number(spark):
    users = [0, 1, 63, 64, 65, -1, -64, -65, 2**62, -(2**63), 2**63 - 1, 7, 7]
    rows = [(u, 1000, "P", "C", "D", "A") for u in users]
    wide = spark.createDataFrame(rows, "userId long, loginDt long, province string, city string, district string, adcode string")
    parts = distinct.login_parts(wide).persist()
    assert parts.filter("part = 'users'").count() == 7
    assert [r.loginUserCount for r in distinct.login_totals(parts, "1 hour").collect()] == [12]
    parts.unpersist()


def test_parts_use_hash_aggregates_and_state_is_small(spark, sf_dir, tmp_path):
    wide = _wide(spark, sf_dir)
    plan = distinct.login_parts(wide)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHash" not in plan
    path = str(tmp_path / "parts")
    distinct.login_parts(wide, "1 day").coalesce(1).write.parquet(path)
    parts = spark.read.parquet(path)
    words = parts.filter("part = 'users'")
    size = sum(os.path.getsize(f) for f in data_files(path))
    # 8 bytes of bits a word, besides keys that repeat
    assert size < 40 * words.count() + 40_000
    totals = distinct.login_totals(parts, "7 days")._jdf.queryExecution().executedPlan().toString()
    assert all("struct" in line for line in totals.splitlines() if "SortAggregate" in line)
    assert words.agg(F.sum(F.bit_count("bits"))).first()[0] >= words.count()
