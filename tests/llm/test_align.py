"""Cross-tokenizer alignment against whole texts encoded by the libraries."""

from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest

from cadenza.llm import align


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def by_hand(libraries, rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups text) per row."""
    a_lib, b_lib = libraries
    alphabet = align.byte_alphabet()
    whole, holders = [], Counter()
    for i, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        raw_a = [bytes(alphabet[c] for c in a_lib.id_to_token(x)) for x in a]
        raw_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [b_lib.id_to_piece(x)]]
        if b"".join(raw_a) != (" " + (text or "")).encode() or b"".join(raw_b) != (" " + (text or "")).encode():
            a, b, raw_a, raw_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
        cuts = np.intersect1d(ends_a, ends_b)
        parts_a = np.split(a, np.searchsorted(ends_a, cuts[:-1]) + 1) if len(cuts) else []
        parts_b = np.split(b, np.searchsorted(ends_b, cuts[:-1]) + 1) if len(cuts) else []
        links = Counter()
        for x, y in zip(parts_a, parts_b):
            links.update((int(p), int(q)) for p in x for q in y)
        holders.update(links.keys())
        text_form = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(parts_a, parts_b))
        whole.append((i, len(a), len(b), len(parts_a), links, text_form))
    most = {}
    for (x, _), n in holders.items():
        most[x] = max(most.get(x, 0), n)
    return [
        (i, na, nb, ng, sum(links.values()), sum(n for p, n in links.items() if holders[p] == most[p[0]]),
         sum(n * holders[p] for p, n in links.items()), form)
        for i, na, nb, ng, links, form in whole
    ]


def found(docs, **options):
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256")
    rows = [tuple(r[c] for c in columns) for r in align.align(docs, **options).collect()]
    assert all(r[8] == (brute.sha(r[7]) if r[7] else "") for r in rows)
    return sorted((r[:8] for r in rows), key=repr)


EDGES = [
    None, "", " ", "  ", "\n", "\n\n", "a", " a", "a ", "a\nb", "a\n b", "a \nb", "\na", "a\tb c", "a▁b", "▁", "x <s> y", "<|endoftext|>",
    "it's we'll 'tis don't", "日本語 テキスト", "é è 😀 👩‍👩‍👧", "a b c　d", "x​ y", "x ᠎y", "q\x1c r\x85 s", "\x00 \x01", "1234567 89.10,11", "---- ====   z",
    "foo  bar   baz\r\nqux", "<0x0A> <unk>", "don’t “quote”", "﻿start ﻿inner",
]


def test_align_edges_and_random_texts(spark, libraries):
    rng = random.Random(3)
    parts = ["the", "ing", " ", "  ", "\n", "é", "😀", "'s", ".", "12", "\t", "日本", "Qx", " ", "zz", "<s>"]
    texts = EDGES + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += ["é😀x" * 4000, "word " * 20_000, "ab" * 30_000, "word", "word"]
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)] + [(7, "repeated id"), (7, "repeated id")]
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, chunk int, pairs string").repartition(3)
    assert found(docs) == sorted(by_hand(libraries, rows), key=repr)
    assert found(docs.limit(0)) == []


def test_small_chunks_and_forgotten_segments(spark, libraries, monkeypatch):
    """Many chunks in a task, each of which meets its own totals again."""
    rows = [(i, f"alpha beta{i % 7} gamma é{i % 5}\nline {i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    known = align.Tokenizers(*align.default_paths())
    seen, out = align.Segments(known), []
    for at in range(0, 120, 30):
        chunk = align._Chunk()
        align._fill(chunk, seen, *map(list, zip(*rows[at : at + 30])), False)
        out.append(align._packed(chunk, seen))
    expected = by_hand(libraries, rows)
    totals = Counter()
    for _, pairs in out:
        totals.update(dict(zip(zip(pairs["a"].tolist(), pairs["b"].tolist()), pairs["texts"].tolist())))
    sums = []
    for texts, pairs in out:
        total = np.array([totals[p] for p in zip(pairs["a"].tolist(), pairs["b"].tolist())])
        sums += [int((np.frombuffer(t, np.int64) * total[np.frombuffer(p, np.uint32)]).sum()) for p, t in zip(texts["pairs"], texts["times"])]
    assert sums == [r[6] for r in expected]
    assert found(docs) == sorted(expected, key=repr)


def test_query_on_whole_table(spark, sf_dir, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = align.op11_align_tokenizers(spark, sf_dir).collect()
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    expected = [(*r[:7], brute.sha(r[7]) if r[7] else "") for r in by_hand(libraries, docs)]
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(expected)


def test_groups_by_divide_and_conquer(monkeypatch):
    rng, cases = random.Random(9), []
    for _ in range(300):
        end = rng.randrange(1, 60)
        a, b = (sorted({*rng.sample(range(1, end + 1), rng.randrange(end)), end}) for _ in range(2))
        cuts = sorted(set(a) & set(b))
        expected, x, y = [], 0, 0
        for c in cuts:
            expected.append((x, a.index(c) + 1, y, b.index(c) + 1))
            x, y = a.index(c) + 1, b.index(c) + 1
        assert align.groups(a, b) == expected
        cases.append((a, b, expected))
    # the same cases side by side, and a round limit that leaves some to be done one by one
    for rounds in (64, 2):
        monkeypatch.setattr(align, "ROUNDS", rounds)
        ends_a, ends_b, whole, parts, base = [], [], [], [], 0
        for a, b, expected in cases:
            x, y = len(ends_a), len(ends_b)
            whole.append((x, x + len(a), y, y + len(b)))
            parts += [(p + x, q + x, r + y, s + y) for p, q, r, s in expected]
            ends_a += [base + e for e in a]
            ends_b += [base + e for e in b]
            base += a[-1]
        found = align.groups_of_all(np.array(ends_a), np.array(ends_b), np.array(whole))
        assert found.tolist() == [list(p) for p in parts]


def test_no_chunk_outlives_its_totals(spark):
    plan = align.align(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
