"""WARC round trip, token counts, mixing, quality, contamination and search."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pytest

from cadenza.llm import bm25, contamination, mixing, quality, tokens, warc
from cadenza.session import run_dir

BIG = "x\r\n\r\né" * 20000


def pages(spark, rows):
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark):
    rows = [(3, "u", BIG), (1, "u v", BIG), (None, None, BIG), (5, None, None), (6, "", ""), (7, "a", "y" * 100), (7, "b", "y" * 100), (8, "c", "y" * 100), (9, "d", "y" * 99), (2, "d", "y" * 99), (None, None, "z" * 200), (None, "q", "z" * 200)]
    path = run_dir(spark, "warc-test")
    warc.write_archives(pages(spark, rows), path, segment_bytes=1000, chunk_bytes=77, records_per_file=50)
    assert warc.read_records(spark, path).where("type = 'continuation'").count() > 100
    found = sorted(
        (
            (str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
            for r in warc.page_report(spark, path).collect()
        ),
        key=lambda r: tuple(map(str, r)),
    )
    big, y, z, small, none = (brute.sha(t) for t in (BIG, "y" * 100, "z" * 200, "y" * 99, ""))
    size = len(BIG.encode())
    assert found == sorted([
        ("1", size, big, "response", None), ("3", size, big, "revisit", 1), ("None", size, big, "revisit", 1),
        ("5", 0, none, "response", None), ("6", 0, none, "response", None),
        ("7", 100, y, "response", None), ("7", 100, y, "revisit", 7), ("8", 100, y, "revisit", 7),
        ("9", 99, small, "response", None), ("2", 99, small, "response", None),
        ("None", 200, z, "response", None), ("None", 200, z, "revisit", None),
    ], key=lambda r: tuple(map(str, r)))
    payloads = warc.payloads(warc.whole_records(warc.read_records(spark, path)), keep_payload=True)
    assert bytes(payloads.where("page_id = 1").first()["payload"]).decode() == BIG


def test_warc_of_nothing_and_lost_segment(spark):
    path = run_dir(spark, "warc-test")
    warc.write_archives(pages(spark, []), path)
    assert warc.page_report(spark, path).collect() == []
    path = run_dir(spark, "warc-test")
    warc.write_archives(pages(spark, [(1, "u", BIG)]), path, segment_bytes=5000)
    records = warc.read_records(spark, path).where("segment is null or segment <> 3")
    with pytest.raises(Exception, match="segments do not add up"):
        warc.whole_records(records).collect()


def test_dechunk():
    assert warc.dechunk(b"3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n") == b"abcde"
    with pytest.raises(ValueError):
        warc.dechunk(b"3\r\nabcd\r\n0\r\n\r\n")


def test_token_counts(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokens.default_path())
    r = random.Random(3)
    alphabet = "ab  the in▁\n\té執ゼ<s>0123</s>ＡẞB!,.　👍🏽"
    texts = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 5, 30, 900]))) for _ in range(300)]
    texts += [" " * 50, "a" * 3000, "deadbeef" * 300, "\x00", ""]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(7, None, 1), (None, "the end", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = sorted((str(x["doc_id"]), x["n_bytes"], x["n_tokens"], x["over_limit"]) for x in tokens.token_counts(df, limit=400).collect())
    expected = [(str(i), len((t or "").encode()), n := len(library.encode(t or "")), n > 400) for i, t, _ in rows]
    assert found == sorted(expected)
    assert tokens.token_counts(df.where("false")).collect() == []


@pytest.mark.parametrize("votes, seats", [([10, 20, 30], 7), ([1, 1, 1], 2), ([0, 5], 3), ([100, 1, 1, 7], 200), ([5], 0), ([], 4)])
def test_highest_quotients(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    assert mixing.sainte_lague(votes, seats) == won


def test_targets_reshare_what_capped_sources_leave():
    assert [float(t) for t in mixing.targets([10, 1000, 90], [1, 2, 3], 3)] == [30.0, 800.0, 270.0]
    assert [float(t) for t in mixing.targets([100, 100, 100], [1, 2, 3], 3)] == [50.0, 100.0, 150.0]
    assert mixing.targets([], [], 3) == [] and mixing.targets([0, 0], [1, 2], 3) == [0, 0]


def test_mix(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.randrange(0, 400), r.choice(["b", "a", None, "c"]), 1) for i in range(400)]
    rows += [(1, "w " * 5000, "a", 1), (None, "w w", "b", 1), (2, None, "c", 1), (2, "", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    first, again = (sorted(map(repr, mixing.mix(d, shard_words=4000).collect())) for d in (df, df.repartition(7)))
    assert first == again
    found = mixing.mix(df, shard_words=4000).collect()
    assert len(found) == len(rows) and all(x["taken"] <= 3 * x["size"] for x in found)
    sizes = {s: sum(x["size"] for x in found if x["source"] == s) for s in ("a", "b", "c", None)}
    aims = mixing.targets(list(sizes.values()), [1, 2, 3, 1], 3)
    for (source, size), aim in zip(sizes.items(), aims):
        some = [x for x in found if x["source"] == source]
        assert {x["source_size"] for x in some} == {size} and {x["target"] for x in some} == {float(aim)}
        assert abs(sum(x["taken"] for x in some) - aim) <= 0.02 * float(aim) + 64
    assert mixing.mix(df.where("false")).collect() == []


def test_quality_held_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id").toPandas()
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id] == found.held_out.tolist()
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert held[held.quality == 1].predicted.mean() > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (None, "text " * 9, 2), (4, "word " * 50000, 2)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, None), (4, 7)], "doc_id long, quality int")
    for labels in (none, one):
        rows = quality.scored(docs, quality.fit(docs, labels)).collect()
        assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    model = quality.fit(docs, none)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.scored(docs.where("false"), model).collect() == []


def edited(r: random.Random, text: str, k: int) -> str:
    x = list(text)
    for _ in range(k):
        p, kind = r.randrange(len(x)), r.randrange(3)
        x[p : p + (kind != 2)] = [] if kind == 0 else ["#"]
    return "".join(x)


def test_contamination(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, prose(r.randrange(8, 50))) for i in range(30)] + [(30, "short one"), (31, None), (32, ""), (None, prose(20))]
    rows, planted = [], {}
    for i in range(120):
        text = prose(r.randrange(0, 200))
        if i % 3 == 0:
            item_id, item = items[r.randrange(30)]
            text += " " + edited(r, item, int(contamination.RATE * len(item))).upper() + "\t" + prose(30)
            planted[i] = item_id
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, "a short ONE here"), (None, items[-1][1]), (503, items[0][1]), (503, items[0][1])]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, edits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 2000):
        found = contamination.find(docs, bench, block_chars=block).collect()
        assert all((i, j) in {(x["doc_id"], x["item_id"]) for x in found} for i, j in planted.items())
    texts, wanted = dict(rows[:120]), dict(items)
    for x in found:
        if x["doc_id"] is not None and x["doc_id"] < 120:
            item = contamination.fold(wanted[x["item_id"]])
            part = contamination.fold(texts[x["doc_id"]])[x["start"] : x["end"]]
            assert brute.edits_within(item, part) == x["edits"] <= contamination.RATE * len(item)
    clean = contamination.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    left = {x["doc_id"] for x in clean.collect()}
    assert not left & {*planted, 502, 503, None} and {500, 501} <= left
    assert left >= {i for i in range(120) if i % 3 and not any(x["doc_id"] == i for x in found)}
    assert contamination.find(docs, bench.where("false")).collect() == []
    assert contamination.find(docs.where("false"), bench).collect() == []


@pytest.mark.parametrize("shard, block", [(1 << 21, 1 << 20), (600, 300)])
def test_search(spark, shard, block):
    r = random.Random(4)
    vocabulary = [f"w{int(r.paretovariate(0.6)) % 500}" for _ in range(2000)]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randrange(0, 80)))) for i in range(300)] + [(400, None), (420, ""), (440, rows_text := "W1 w2 w3")]
    rows.append((441, rows_text))
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, score int").repartition(3)
    found = bm25.search(docs, docs.where("doc_id % 20 = 0"), k=5, shard_words=shard, query_terms=block).collect()
    got: dict = {}
    for x in sorted(found, key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append((x["doc_id"], round(x["score"], 6)))
    expected = {q: top for q, top in brute.bm25(rows, [i for i, _ in rows if i % 20 == 0], 5).items() if top}
    assert got.keys() == expected.keys()
    for q, top in expected.items():
        assert [i for i, _ in got[q]] == [i for i, _ in top]
        assert np.allclose([s for _, s in got[q]], [s for _, s in top], atol=1e-5)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert bm25.search(docs.where("false"), docs.where("false")).collect() == []
    assert bm25.search(docs, docs.where("false")).collect() == []


def test_sql_of_the_text_queries(spark, sf_dir):
    import oracle

    from cadenza.llm import catalog

    con = oracle.connect(sf_dir)
    for name, sql in catalog.oracles().items():
        assert oracle.compare(catalog.queries()[name](spark, sf_dir), con, sql) is None
