"""Fill-in-the-middle: against regular expressions, and the compressed boundary set."""

from __future__ import annotations

import hashlib
import random
import re

import brute
import numpy as np
import oracle
import pytest

from cadenza.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(i, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = [m[0] for m in UNIT.finditer(text)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (i, n, "plain", None, None, text, text)
    if h[3] % 100 < 80:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def test_transform(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "\n\t ", "a", " a", "a ", "<P", "x<P>y", "<<S", "a <M b", "   x", "é😀 ß", "a\x0bb\x1cc"]
    texts += ["".join(rng.choice(["a", "bc", " ", "\n", "é", "😀", "<", "P>", "<S"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["w " * 90_000, "x" * 200_000, " " * 70_000]
    rows = [(i % 250 if i % 50 else None, t, "c", "d") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output string")
    found = sorted(map(tuple, fim.transform(docs).collect()), key=repr)
    assert found == sorted((by_hand(r[0], r[1]) for r in rows), key=repr)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).collect() == []


def test_query_agrees_with_sql(spark, sf_dir):
    con = oracle.connect(sf_dir)
    assert oracle.compare(fim.op12_fill_in_middle(spark, sf_dir), con, fim.OP12_SQL) is None
    con.close()


def test_restored_texts_are_the_texts(spark, sf_dir):
    made = fim.op12_fill_in_middle(spark, sf_dir).collect()
    texts = {r["doc_id"]: brute.sha(r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["restored_sha256"] for r in made} == texts


@pytest.mark.parametrize("make, kind", [
    (lambda rng: np.sort(rng.choice(1 << 16, 3000, replace=False)), fim.ArrayContainer),
    (lambda rng: np.sort(rng.choice(1 << 16, 30000, replace=False)), fim.BitmapContainer),
    (lambda rng: np.concatenate([np.arange(i * 1000, i * 1000 + 700) for i in range(60)]), fim.RunContainer),
])
def test_containers_select_and_rank(make, kind):
    rng = np.random.default_rng(1)
    low = make(rng)
    held = fim.container(low)
    assert isinstance(held, kind)
    some = rng.choice(len(low), 500)
    assert [held.select(int(i)) for i in some] == low[some].tolist()
    places = rng.choice(1 << 16, 500)
    assert [held.rank(int(p)) for p in places] == np.searchsorted(low, places, "right").tolist()


def test_boundary_set_over_many_containers():
    rng = np.random.default_rng(2)
    parts = [np.sort(rng.choice(1 << 16, 20_000, replace=False)), 5 * (1 << 16) + np.arange(9000), 9 * (1 << 16) + np.array([0, 65535])]
    positions = np.concatenate(parts)
    held = fim.BoundarySet(positions)
    assert {type(c) for c in held.containers} == {fim.BitmapContainer, fim.RunContainer, fim.ArrayContainer}
    some = rng.choice(len(positions), 500)
    assert [held.select(int(i)) for i in some] == positions[some].tolist()
    places = rng.choice(11 << 16, 800)
    assert [held.rank(int(p)) for p in places] == np.searchsorted(positions, places, "right").tolist()
    assert held.cut(0) == 0 and held.cut(held.size) == positions[-1]
    empty = fim.BoundarySet(np.zeros(0, np.int64))
    assert empty.size == 0 and empty.rank(7) == 0
    with pytest.raises(IndexError):
        held.select(held.size)
