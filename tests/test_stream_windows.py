from __future__ import annotations

import datetime as dt

import streams
from pyspark.sql import functions as F

from cadenza.fixed_values import WATERMARK_DELAY
from cadenza.operators import enrich, windows
from cadenza.plans import stand_ins as S

WIDE = "songId string, songName string, singerInfo string, action string, timestamp long"


def _run(spark, tmp_path, batches, no_data_batches=True):
    frames = [
        spark.createDataFrame([("s", "N", "S", a, int(t * 1000)) for a, t in b], WIDE)
        for b in batches
    ]
    source = str(tmp_path / "in")
    streams.write_in_order(spark, frames, source)
    out = streams.run(
        spark, source, frames[0].schema,
        lambda s: windows.song_hot(s, delay=WATERMARK_DELAY), str(tmp_path),
        no_data_batches=no_data_batches,
    )
    return [(r.windowStart[-2:], r.playCount) for r in out.orderBy("windowStart").collect()]


def test_a_window_waits_for_the_delay(spark, tmp_path):
    assert _run(spark, tmp_path, [[("play", 5)], [("play", 12.9)]]) == []


def test_a_window_fires_and_late_rows_are_dropped(spark, tmp_path):
    # the micro-batch that follows the one with 13 emits the window; later ones drop 7
    batches = [[("play", 5)], [("play", 13)], [("pause", 13)], [("play", 7)]]
    assert _run(spark, tmp_path, batches) == [("00", 1)]


def test_rows_within_the_delay_count(spark, tmp_path):
    batches = [[("play", 5)], [("play", 11)], [("play", 7)], [("play", 13)]]
    assert _run(spark, tmp_path, batches) == [("00", 2)]


def test_filtered_rows_advance_time(spark, tmp_path):
    assert _run(spark, tmp_path, [[("play", 5)], [("pause", 13)]]) == [("00", 1)]


def _parity(spark, tmp_path, source_rows, build, batch, time_column):
    """Stream in three files by time; compare all windows that had to close."""
    cuts = source_rows.approxQuantile("_cut", [0.33, 0.66], 0.0)
    parts = [
        source_rows.filter(F.col("_cut") <= cuts[0]),
        source_rows.filter((F.col("_cut") > cuts[0]) & (F.col("_cut") <= cuts[1])),
        source_rows.filter(F.col("_cut") > cuts[1]),
    ]
    source = str(tmp_path / "in")
    streams.write_in_order(spark, parts, source)
    out = streams.run(spark, source, source_rows.schema, build, str(tmp_path))
    newest = source_rows.agg(F.max(time_column)).first()[0] - dt.timedelta(seconds=3)
    closed = batch(source_rows).filter(F.col("windowEnd") <= F.lit(str(newest)[:19]))
    assert closed.count() > 0
    assert out.exceptAll(closed.select(*out.columns)).count() == 0
    assert closed.select(*out.columns).exceptAll(out).count() == 0


def test_distinct_logins_agree_with_batch(spark, tmp_path, sf_dir):
    cells = S.regions(*[S.table(spark, sf_dir, n) for n in ("nation", "region")])
    events = S.table(spark, sf_dir, "events").filter("event_type = 'signup'").withColumn(
        "_cut", F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    )

    def build(delay):
        return lambda e: windows.region_login(
            enrich.add_region(S.logins(e), cells), "1 day", delay
        )

    _parity(spark, tmp_path, events, build(WATERMARK_DELAY), build(None), "ts")


def test_revenue_agrees_with_batch(spark, tmp_path, sf_dir):
    machines = S.machines(*[S.table(spark, sf_dir, n) for n in ("customer", "nation", "region")])
    orders = S.table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").withColumn(
        "_cut", F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double")
    ).filter("o_custkey % 11 != 3")

    def build(delay):
        return lambda o: windows.region_revenue(
            enrich.consume_wide(S.consume(o), machines), "1 day", delay
        )

    _parity(spark, tmp_path, orders, build(WATERMARK_DELAY), build(None), "o_orderdate")


def test_overview_agrees_with_batch(spark, tmp_path, sf_dir):
    orders, lineitem = (S.table(spark, sf_dir, n) for n in ("orders", "lineitem"))
    both = S.responses(orders).unionByName(S.feedback(lineitem), allowMissingColumns=True)
    rows = both.withColumn("at", F.col("eventTime").cast("timestamp")).withColumn(
        "_cut", F.unix_micros("at").cast("double")
    )

    def build(delay):
        return lambda r: windows.ai_overview(
            r.filter("eventType = 'AI_RESPONSE'"), r.filter("eventType = 'AI_FEEDBACK'"),
            "1 day", delay,
        )

    _parity(spark, tmp_path, rows, build(WATERMARK_DELAY), build(None), "at")
