"""Suffix-sort removal and the Jaccard join against brute force."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import components, jaccard, suffixes

FOX = "The quick brown fox jumps over the lazy dog and then runs away from it, quickly. "


def small_corpus(seed: int, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [" ".join(r.choices(vocabulary, k=25)) for _ in range(4)]
    rows = []
    for i in range(n):
        own = " ".join(r.choices(vocabulary, k=r.randrange(3, 60)))
        if rows and r.random() < 0.4:  # a near copy
            text = list(r.choice(rows)[1])
            for _ in range(r.randrange(3)):
                text[r.randrange(len(text))] = r.choice("xyz ")
            own = "".join(text)
        if r.random() < 0.4:
            own = own + " é" + r.choice(passages) + " " + str(i)
        rows.append((i, own))
    return rows


EDGE = [(1, FOX * 3), (1, FOX * 3), (2, FOX * 3), (None, FOX * 3), (3, None), (4, ""), (5, "é" * 200), (6, "é" * 100 + "z"), (7, "a" * 49), (8, "a" * 49), (9, "a" * 3000), (10, "a" * 4000)]


@pytest.mark.parametrize("rows, hot", [(EDGE, 5000), (EDGE, 1), (small_corpus(1), 5000), (small_corpus(2), 1)])
def test_remove_repeats(spark, rows, hot):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(4)
    found = suffixes.remove_repeats(df, hot=hot).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute.remove_repeats(rows)))


def test_remove_repeats_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(df).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=12), st.integers(1, 12))
def test_suffix_order(texts, depth):
    data = np.frombuffer("".join(t + "c" * depth for t in texts).encode(), np.uint8)
    start = np.arange(len(data) - depth + 1)
    segment = start % 3
    order = suffixes.SuffixOrder(data, depth).sort(segment, start)
    raw = data.tobytes()
    keys = [(int(segment[i]), raw[start[i] : start[i] + depth]) for i in order]
    assert keys == sorted(keys)


def test_anchors_of_long_and_short_texts_agree(monkeypatch):
    data = np.frombuffer(FOX.encode() * 30, np.uint8)
    short = suffixes.anchors(data, 50, 16)
    monkeypatch.setattr(suffixes, "POSITION_BITS", 10)
    long = suffixes.anchors(data[:900], 50, 16), suffixes.anchors(data, 50, 16)
    assert np.array_equal(*[x[1][x[1] < 800] for x in long])
    assert len(short[0]) == len(short[1]) and short[3].sum() == len(data) - 49


def test_collisions_are_settled_by_bytes():
    from types import SimpleNamespace as Row

    kept = [Row(anchor=1, key=i, id=i, start=0, strings=2, offset=1, bytes=b) for i, b in ((1, b"abcd"), (2, b"abcx"), (3, b"zbcd"))]
    assert sorted(suffixes._by_bytes(kept, 3)) == [(2, 0, 3), (3, 1, 4)]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_join(spark, n, percent):
    rows = small_corpus(3, 120) + [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "One TWO"), (205, "two one"), (206, FOX * 40), (207, FOX * 40 + "x")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(5)
    found = jaccard.near_duplicates(df, n=n, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.jaccard_components(rows, n, percent)


def test_jaccard_rows_of_one_id_and_null_ids(spark):
    rows = [(5, "a b c d e f"), (5, "g h i j k l"), (7, "g h i j k l"), (3, "a b c d e f"), (None, "q r s t"), (9, "q r s t"), (None, "alone u v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard.near_duplicates(df, n=3, percent=90).collect())
    assert found == [("3", "3"), ("5", "3"), ("5", "3"), ("7", "3"), ("9", "9"), ("None", "9"), ("None", "None")]
    kept = jaccard.one_of_each(df, n=3, percent=90).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "9", "None", "None"]


def test_one_row_of_each_group(spark):
    rows = [(3, "a b c d e f")] * 3 + [(3, "u v w x y z"), (3, ""), (4, "u v w x y z"), (4, None), (6, ""), (6, " "), (7, "")]
    rows += [(None, "q r s t")] * 3 + [(None, "Q r  s t"), (None, "other words here"), (None, ""), (None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, kept_id int").repartition(4)
    kept = jaccard.one_of_each(df, n=3, percent=90)
    assert kept.columns == df.columns
    kept = kept.collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [3, 6, 7]
    assert next(r["text"] for r in kept if r["doc_id"] == 3) in ("a b c d e f", "u v w x y z")
    loose = sorted(" ".join((r["text"] or "").lower().split()) for r in kept if r["doc_id"] is None)
    assert loose == ["", "", "other words here", "q r s t"]


@pytest.mark.parametrize("stars", [True, False])
@pytest.mark.parametrize("more", [0, 1])
def test_jaccard_bounds_of_large_sets(spark, stars, more):
    """Sets of 5 M shingles that share all but 1000, and sizes whose products pass 32 bits, meet."""
    common = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 5_000_000, np.uint64))
    parts = [jaccard.coarse_profile(common[:-1000]), jaccard.coarse_profile(common[1000:])]
    size = len(common) - 1000
    rows = [(1, g, size, 0, 0, p) for g, p in enumerate(parts)]
    rows += [(2, 10 + g, n, 0, 0, b"\xff" * jaccard.COARSE) for g, n in enumerate((22_000_000, 23_800_000))]
    # a third set of the bucket, too small to meet the others
    rows += [(t, 20 + t, 100, 0, 0, parts[0]) for t in (1, 2) if more]
    entries = spark.createDataFrame(rows, "token long, gid long, size int, place int, label long, parts binary")
    found = jaccard._meetings(entries, 90, 100, stars).collect()
    assert sorted(map(tuple, found)) == [(0, 1), (10, 11)]


def test_jaccard_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(df).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    expected = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {x["node"]: x["component"] for x in found} == expected and len(found) == len(expected)


def test_contexts_go_to_python_by_buckets(spark, monkeypatch):
    """A chunk sends a row for each bucket of anchors, not for each context, and a text's runs come in one row."""
    seen = {}
    once = suffixes._removed
    monkeypatch.setattr(suffixes, "_removed", lambda contexts, *a: seen.setdefault("runs", once(seen.setdefault("contexts", contexts), *a)))
    r = random.Random(5)
    passages = [" ".join(f"w{r.randrange(5000)}" for _ in range(300)) for _ in range(4)]
    rows = [(i, f"{i} own words of {i * i} " + r.choice(passages) + f" {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = suffixes.remove_repeats(df).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute.remove_repeats(rows)))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert seen["contexts"].count() <= 4 * 2 * buckets
    assert seen["runs"].count() == len({x["key"] for x in seen["runs"].collect()}) <= 200


@pytest.mark.parametrize("bound", [1, 7, 1 << 14])
def test_slices_of_whole_anchors(monkeypatch, bound):
    """Anchors of many contexts, and many anchors, give the same runs in slices of any size."""
    from types import SimpleNamespace as Row

    monkeypatch.setattr(suffixes, "SLICE", bound)
    r = random.Random(6)
    length, gram = 12, 4
    contexts = []
    for n in range(300):
        strings = r.randrange(1, length - gram + 2)
        text = "".join(r.choices("ab", k=strings + length - 1)).encode()
        contexts.append((r.randrange(-9, 9) if n % 3 else 5, n, r.randrange(40), r.randrange(50), strings, strings - 1, text))
    least: dict = {}
    for anchor, _, id_, _, strings, offset, text in contexts:
        for i in range(strings):
            name = anchor, offset - i, text[i : i + length]
            least[name] = min(least.get(name, id_), id_)
    expected = {
        (n, start + i + j)
        for anchor, n, id_, start, strings, offset, text in contexts
        for i in range(strings) if least[anchor, offset - i, text[i : i + length]] < id_
        for j in range(length)
    }
    names = list(suffixes.KINDS.items())
    parts = [contexts[:100], contexts[100:]]
    rows = [Row(**{c: np.array([x[k] for x in p], t).tobytes() for k, (c, t) in enumerate(names)}, bytes=b"".join(x[-1] for x in p)) for p in parts]
    found = set()
    for keys, starts, ends in suffixes._settled(rows, length, gram):
        for key, a, b in zip(keys.tolist(), starts.tolist(), ends.tolist()):
            found.update((key, x) for x in range(a, b))
    assert found == expected and expected
