"""Alignment of two tokenizers' tokens over the same bytes.

Every text is encoded by two public vocabularies, A (byte-level pair merging) and
B (pieces with byte fallback).  Both token sequences cover the bytes of "space +
text"; where a token of each ends at the same byte, both are cut.  The parts
between cuts are the groups, and a token of A is linked with every token of B in
its group.  Groups are found by divide and conquer: the common end nearest to the
middle of an interval is located by bisection and both halves are treated alike,
until an interval has no common end inside.

A text is encoded in segments, cut before a space or line end that stands between
two characters that are no white space.  There A's word pattern always begins a new
word, and B has no piece with a mark after another character and none with a line
end (checked when the vocabulary is read), so the tokens of the segments are those
of the text.  Segments repeat, and are encoded and aligned once per process.

How many texts hold an id pair is counted in two steps.  A task keeps its texts in
chunks and counts each pair once a chunk; the sums over all chunks go back to the
chunks, which then meet their own texts again.  What is shuffled is one row per
(chunk, pair) and one packed row per text, never a row per (text, pair), and no
task holds more than one chunk.

Defined results: texts that are null or empty, or whose tokens of A or B do not
give back their bytes (a literal U+2581 in a text is read as a space), have no
tokens, no groups and zeros everywhere; rows keep their ids, null or repeated, and
each row counts as a text of its own; an empty table gives an empty result; a very
long text is a chunk of its own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import common

#: characters of text of one chunk, and segments that a process remembers
CHUNK_CHARS = 8 << 20
SEGMENTS_MOST = 250_000
#: white space, and three characters that some versions of the word pattern read as such
_BLANK = "\\s\u180e\u200b\ufeff"
SPACE_OR_LINE = re.compile(f"(?<=[^{_BLANK}])(?=[ \\n][^{_BLANK}])")
SPACE_ONLY = re.compile(f"(?<=[^{_BLANK}])(?= [^{_BLANK}])")
MARK = "▁"

#: new segments encoded together, and rounds of the division made for all at once
ENCODED, ROUNDS = 8_000, 64

Group = tuple[int, int, int, int]


def groups(ends_a: list[int], ends_b: list[int]) -> list[Group]:
    """Groups of two ascending lists of end offsets, whose last ends are equal.

    Each is (first, end) of its tokens of A and (first, end) of those of B.
    """
    out, todo = [], [(0, len(ends_a), 0, len(ends_b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        inner, middle = a1 - a0 - 1, (a0 + a1 - 2) // 2
        cut = None
        if inner and b1 - b0 > 1:
            for step in range(inner + 1):
                for i in (middle - step, middle + step) if step else (middle,):
                    if a0 <= i < a1 - 1:
                        j = bisect_left(ends_b, ends_a[i], b0, b1 - 1)
                        if j < b1 - 1 and ends_b[j] == ends_a[i]:
                            cut = i + 1, j + 1
                            break
                if cut:
                    break
        if cut:
            todo += [(cut[0], a1, cut[1], b1), (a0, cut[0], b0, cut[1])]
        else:
            out.append((a0, a1, b0, b1))
    return out


def groups_of_all(ends_a: np.ndarray, ends_b: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """:func:`groups` of many intervals (rows of ``whole``) of two long arrays of ends.

    All intervals take their next step together: the end beside the middle that is
    looked up next, then a division, or the interval is a leaf.  Those that are
    still undecided after many rounds are divided one by one.
    """
    leaves, todo = [], whole
    step = np.zeros(len(todo), np.int64)
    for _ in range(ROUNDS):
        a0, a1, b0, b1 = todo.T
        # 0, -1, +1, -2, +2, ... from the middle, until both sides are used up
        at = (a0 + a1 - 2) // 2 + np.where(step % 2 == 1, -(step + 1) // 2, step // 2)
        done = (a1 - a0 < 2) | (b1 - b0 < 2) | (step > 2 * (a1 - a0))
        leaves.append(todo[done])
        left = ~done
        if not left.any():
            break
        todo, step, at = todo[left], step[left], at[left]
        a0, a1, b0, b1 = todo.T
        inside = (at >= a0) & (at < a1 - 1)
        j = np.searchsorted(ends_b, ends_a[np.where(inside, at, a0)])
        cut = inside & (ends_b[np.minimum(j, len(ends_b) - 1)] == ends_a[np.where(inside, at, a0)])
        i1, j1 = at[cut] + 1, j[cut] + 1
        halves = [
            np.column_stack([a0[cut], i1, b0[cut], j1]), np.column_stack([i1, a1[cut], j1, b1[cut]]), todo[~cut]
        ]
        todo = np.concatenate(halves)
        step = np.append(np.zeros(2 * len(i1), np.int64), step[~cut] + 1)
    else:
        for a0, a1, b0, b1 in todo.tolist():
            found = groups(ends_a[a0:a1].tolist(), ends_b[b0:b1].tolist())
            leaves.append(np.array(found, np.int64) + np.array([a0, a0, b0, b0]))
    out = np.concatenate(leaves)
    return out[np.argsort(out[:, 0], kind="stable")]


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, all other bytes for the
    characters from U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in set(own)]
    return {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(others)}


class Tokenizers:
    """Both vocabularies, with the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size(with_added_tokens=False))]
        self.bytes_a = [bytes(alphabet[c] for c in n) if set(n) <= alphabet.keys() else n.encode() for n in names]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a mark after another character")
        lines = any("\n" in p for p in pieces)
        self.cuts = SPACE_ONLY if lines else SPACE_OR_LINE
        self.wide_a, self.wide_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        #: a pair is id of A times the square root of this, plus id of B
        self.pairs = max(len(names), len(pieces)) ** 2
        self.forms = [f"{i}{end}" for end in (",", "|", ";", "\n") for i in range(max(len(names), len(pieces)))]
        self.mark = self.b.piece_to_id(MARK)

    def segments(self, text: str) -> list[str]:
        return self.cuts.split(" " + text)

    def written(self, a: np.ndarray, b: np.ndarray, parts: np.ndarray, own: np.ndarray, count: int) -> list[str]:
        """The groups of each segment as text, ``a1,a2|b1;a3|b2,b3``."""
        out = [""] * count
        if not len(parts):
            return out
        na, nb = parts[:, 1] - parts[:, 0], parts[:, 3] - parts[:, 2]
        end = np.cumsum(na + nb)
        begin = end - na - nb
        ids, mark = np.zeros(end[-1], np.int64), np.zeros(end[-1], np.int64)
        ids[_ragged(begin, na)] = a[_ragged(parts[:, 0], na)]
        ids[_ragged(begin + na, nb)] = b[_ragged(parts[:, 2], nb)]
        mark[begin + na - 1] = 1
        mark[end - 1] = np.where(np.append(own[1:] != own[:-1], True), 3, 2)
        lines = "".join(map(self.forms.__getitem__, (mark * (len(self.forms) // 4) + ids).tolist())).split("\n")
        for i, line in zip(own[_runs(own)].tolist(), lines):
            out[i] = line
        return out

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B of each segment; B adds a space before what it is given."""
        in_a = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        in_b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        # a segment that begins with a line end has the mark, a token of its own, before it
        return in_a, [y if s[0] == " " else y[1:] if y[:1] == [self.mark] else [] for s, y in zip(segments, in_b)]


class Segments:
    """What is known of the segments met so far, by number."""

    def __init__(self, vocabularies: Tokenizers):
        self.known = vocabularies
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        #: tokens of A, of B, groups, links, and whether all bytes came back
        self.facts = np.zeros((0, 5), np.int64)
        #: linked pairs of each segment by number, one after another, and where they begin
        self.begin = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int32)
        self.times = np.zeros(0, np.int64)
        #: number of each pair of ids, in ascending order of the pairs, and the pairs by number
        self.sorted_pairs = np.zeros(0, np.int64)
        self.sorted_numbers = np.zeros(0, np.int32)
        self.pair_of = np.zeros(0, np.int64)

    def numbers(self, segments: list[str]) -> np.ndarray:
        new = list(set(segments).difference(self.number))
        for at in range(0, len(new), ENCODED):
            self._add(new[at : at + ENCODED])
        return np.fromiter(map(self.number.__getitem__, segments), np.int64, len(segments))

    def _add(self, new: list[str]) -> None:
        in_a, in_b = self.known.encode(new)
        raw = [x.encode("utf-8", "surrogatepass") for x in new]
        fine = _gives_back(in_a, self.known.bytes_a, raw) & _gives_back(in_b, self.known.bytes_b, raw)
        for i in np.flatnonzero(~fine):
            in_a[i], in_b[i] = [], []
        sizes = [np.fromiter(map(len, x), np.int64, len(new)) for x in (in_a, in_b)]
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in zip((in_a, in_b), sizes))
        ends_a, ends_b = np.cumsum(self.known.wide_a[a]), np.cumsum(self.known.wide_b[b])
        to_a, to_b = map(np.cumsum, sizes)
        whole = np.column_stack([to_a - sizes[0], to_a, to_b - sizes[1], to_b])[fine]
        parts = groups_of_all(ends_a, ends_b, whole)
        own = np.searchsorted(to_a, parts[:, 0], "right")
        self.text.extend(self.known.written(a, b, parts, own, len(new)))
        links = (parts[:, 1] - parts[:, 0]) * (parts[:, 3] - parts[:, 2])
        facts = np.column_stack([
            *sizes, np.bincount(own, minlength=len(new)), np.zeros(len(new), np.int64), fine.astype(np.int64)
        ])
        np.add.at(facts[:, 3], own, links)
        key, times = _linked(a, b, parts, own, self.known.pairs)
        of = key // self.known.pairs
        first = len(self.number)
        self.number.update(zip(new, range(first, first + len(new))))
        self.facts = np.concatenate([self.facts, facts])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.bincount(of, minlength=len(new)))])
        self.pairs = np.concatenate([self.pairs, self._pair_numbers(key % self.known.pairs)])
        self.times = np.concatenate([self.times, times])

    def _pair_numbers(self, pairs: np.ndarray) -> np.ndarray:
        new = np.setdiff1d(pairs, self.sorted_pairs)
        numbers = np.append(self.sorted_numbers, len(self.pair_of) + np.arange(len(new), dtype=np.int32))
        both = np.append(self.sorted_pairs, new)
        by = np.argsort(both, kind="stable")
        self.pair_of = np.append(self.pair_of, new)
        self.sorted_pairs, self.sorted_numbers = both[by], numbers[by].astype(np.int32)
        return self.sorted_numbers[np.searchsorted(self.sorted_pairs, pairs)]


def _gives_back(ids: list[list[int]], token_bytes: list[bytes], raw: list[bytes]) -> np.ndarray:
    """Whether the bytes of its tokens are those of each segment."""
    get = token_bytes.__getitem__
    return np.array([b"".join(map(get, x)) == r for x, r in zip(ids, raw)], bool)


def _linked(a: np.ndarray, b: np.ndarray, parts: np.ndarray, own: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and pair as one number (``pairs`` of them a segment), and how often each is linked."""
    na, nb = parts[:, 1] - parts[:, 0], parts[:, 3] - parts[:, 2]
    small = na * nb <= 4096
    some = parts[small]
    links = (na * nb)[small]
    place = _ragged(np.zeros(len(some), np.int64), links)
    wide = np.repeat(nb[small], links)
    x, y = np.repeat(some[:, 0], links) + place // wide, np.repeat(some[:, 2], links) + place % wide
    width = int(math.isqrt(pairs - 1)) + 1
    keys = [np.repeat(own[small], links) * pairs + a[x] * width + b[y]]
    times = [np.ones(len(x), np.int64)]
    # the ids of a large group are counted before they are combined
    for (a0, a1, b0, b1), of in zip(parts[~small].tolist(), own[~small].tolist()):
        x, n = np.unique(a[a0:a1], return_counts=True)
        y, m = np.unique(b[b0:b1], return_counts=True)
        keys.append((of * pairs + x[:, None] * width + y[None]).ravel())
        times.append((n[:, None] * m[None]).ravel())
    return _summed(np.concatenate(keys), np.concatenate(times))


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in ascending order, with the sum of its times."""
    if len(key) and key.max() < 1 << 46 and times.max() < 1 << 16:
        both = np.sort(key << 16 | times)  # much faster than a sort of places
        key, times = both >> 16, both & 0xFFFF
    else:
        by = np.argsort(key, kind="stable")
        key, times = key[by], times[by]
    first = _runs(key)
    return key[first], np.add.reduceat(times, first) if len(first) else times


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    """The vocabularies of two files, read once per process."""
    key = (a_path, b_path)
    if key not in _LOADED:
        _LOADED[key] = Tokenizers(a_path, b_path)
    return _LOADED[key]


_REMEMBERED: dict[tuple[str, str], Segments] = {}


def segments_of(a_path: str, b_path: str) -> Segments:
    """The segments that this process remembers, of all tasks it ran; forgotten if too many."""
    key = (a_path, b_path)
    if key not in _REMEMBERED or len(_REMEMBERED[key].number) > SEGMENTS_MOST:
        _REMEMBERED[key] = Segments(tokenizers_of(*key))
    return _REMEMBERED[key]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class _Chunk:
    """Texts of one chunk: their segment numbers, and their groups as text or digest."""

    def __init__(self):
        self.ids, self.numbers, self.digests, self.written, self.chars = [], [], [], [], 0


def _fill(chunk: _Chunk, seen: Segments, ids: list, texts: list, keep_groups: bool) -> None:
    cut = [seen.known.segments(t) if t else [] for t in texts]
    numbers = seen.numbers(list(chain.from_iterable(cut)))
    fine, at = seen.facts[numbers, 4] == 1, 0
    for i, t, segments in zip(ids, texts, cut):
        own = numbers[at : at + len(segments)]
        if not fine[at : at + len(segments)].all():
            own = own[:0]
        at += len(segments)
        groups_text = ";".join([seen.text[n] for n in own.tolist()])
        chunk.ids.append(i)
        chunk.numbers.append(own)
        chunk.digests.append(hashlib.sha256(groups_text.encode()).hexdigest() if len(own) else "")
        chunk.written.append(groups_text if keep_groups else None)
        chunk.chars += len(t or "")


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``begin[0], begin[0] + 1, ...`` for each of the ranges, one after another."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def _packed(chunk: _Chunk, seen: Segments) -> tuple[dict, dict]:
    """Columns of the chunk's texts, and of its pairs."""
    texts = len(chunk.ids)
    sizes = np.array([len(n) for n in chunk.numbers])
    numbers = np.concatenate(chunk.numbers) if texts else np.zeros(0, np.int64)
    # each segment once a text, with how often
    key, often = _summed(np.repeat(np.arange(texts), sizes) * len(seen.number) + numbers, np.ones(len(numbers), np.int64))
    own, numbers = np.divmod(key, max(1, len(seen.number)))
    facts = np.zeros((texts, 4), np.int64)
    for i in range(4):
        np.add.at(facts[:, i], own, seen.facts[numbers, i] * often)
    # their pairs, each once a text, with how often
    size = seen.begin[numbers + 1] - seen.begin[numbers]
    at = _ragged(seen.begin[numbers], size)
    known = max(1, len(seen.pair_of))
    key, times = _summed(np.repeat(own, size) * known + seen.pairs[at], seen.times[at] * np.repeat(often, size))
    own, number = np.divmod(key, known)
    holders = np.bincount(number, minlength=known)
    # numbered within the chunk
    held = np.flatnonzero(holders)
    local = np.zeros(known, np.uint32)
    local[held] = np.arange(len(held))
    number = local[number]
    bounds = np.searchsorted(own, np.arange(texts + 1))
    width = math.isqrt(seen.known.pairs)
    return (
        {
            "doc_id": chunk.ids, "n_a": facts[:, 0], "n_b": facts[:, 1], "n_groups": facts[:, 2],
            "n_links": facts[:, 3], "groups_sha256": chunk.digests, "groups": chunk.written,
            "pairs": [number[x:y].tobytes() for x, y in zip(bounds, bounds[1:])],
            "times": [times[x:y].tobytes() for x, y in zip(bounds, bounds[1:])],
        },
        {
            "a": (seen.pair_of[held] // width).astype(np.int32), "b": (seen.pair_of[held] % width).astype(np.int32),
            "local": np.arange(len(held), dtype=np.int32), "texts": holders[held],
        },
    )


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _chunk_schema(id_type: T.DataType) -> T.StructType:
    schema = T.StructType().add("chunk", "long").add("doc_id", id_type)
    for name in _COUNTS:
        schema.add(name, "long")
    for name in ("groups_sha256", "groups"):
        schema.add(name, "string")
    schema.add("pairs", "binary").add("times", "binary")
    return schema.add("a", "integer").add("b", "integer").add("local", "integer").add("texts", "long")


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema
    )


def _chunks(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool) -> DataFrame:
    """One row per text, and one per (chunk, pair) with a pair in place of a text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = _chunk_schema(docs.schema["doc_id"].dataType)
    schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        seen, chunk = segments_of(a_path, b_path), _Chunk()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal seen, chunk, made
            name = task << 32 | made
            for columns in _packed(chunk, seen):
                size = len(next(iter(columns.values())))
                for at in range(0, size, 20_000):
                    some = {k: v[at : at + 20_000] for k, v in columns.items()}
                    yield _batch(some | {"chunk": np.full(len(next(iter(some.values()))), name)}, schema)
            made, chunk, seen = made + 1, _Chunk(), segments_of(a_path, b_path)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                some, end = [], at
                size = 0
                while end < len(ids) and size < 1 << 21:
                    some.append(texts[end].as_py())
                    size += len(some[-1] or "")
                    end += 1
                _fill(chunk, seen, ids[at:end], some, keep_groups)
                at = end
                if chunk.chars >= CHUNK_CHARS:
                    yield from close()
        if chunk.ids:
            yield from close()

    return docs.mapInArrow(run, spark_schema)


def _totals(pairs: DataFrame) -> DataFrame:
    """Texts of each pair of ids, and whether that is the most of its id of A."""
    counts = pairs.groupBy("a", "b").agg(F.sum("texts").alias("total"))
    # an id of A has at most as many pairs as B has ids
    return counts.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("a")))


def _settle(texts: DataFrame, totals: DataFrame) -> DataFrame:
    """Each chunk's totals, then its texts; a task holds the totals of one chunk."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = ["doc_id", *_COUNTS, "groups_sha256", "groups"]
    both = texts.select("chunk", F.lit(1).alias("turn"), *keep, "pairs", "times").unionByName(
        totals.select("chunk", F.lit(0).alias("turn"), "local", "total", "best"), allowMissingColumns=True
    )
    spark_schema = T.StructType([texts.schema[c] for c in keep]).add("n_best", "long").add("count_sum", "long")
    schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, total, best = None, [], None, None
        for batch in batches:
            name = batch.column("chunk").to_numpy()
            turn = batch.column("turn").to_numpy()
            begin = _runs(name * 2 + turn)
            for x, y in zip(begin, np.append(begin[1:], len(name))):
                if name[x] != chunk:
                    chunk, parts, total = name[x], [], None
                rows = batch.slice(x, y - x)
                if not turn[x]:
                    parts.append([rows.column(c).to_numpy(zero_copy_only=False) for c in ("local", "total", "best")])
                    continue
                if total is None:
                    local, counts, flags = (
                        (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
                    )
                    total, best = np.zeros(len(local), np.int64), np.zeros(len(local), bool)
                    total[local.astype(np.int64)], best[local.astype(np.int64)], parts = counts, flags.astype(bool), []
                pairs, times = rows.column("pairs").to_pylist(), rows.column("times").to_pylist()
                own = np.repeat(np.arange(len(pairs)), [len(p) // 4 for p in pairs])
                at = np.frombuffer(b"".join(pairs), np.uint32)
                often = np.frombuffer(b"".join(times), np.int64)
                sums = np.zeros((len(pairs), 2), np.int64)
                np.add.at(sums, own, np.column_stack([often * best[at], often * total[at]]))
                columns = [rows.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sums[:, 0]), pa.array(sums[:, 1])], schema=schema)

    return both.repartition("chunk").sortWithinPartitions("chunk", "turn").mapInArrow(run, spark_schema)


def align(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None,
    b_path: str | None = None, keep_groups: bool = True,
) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, n_best, count_sum``.

    ``groups`` is the alignment as text (null unless kept), ``n_best`` the links whose
    pair is in the most texts of all pairs of its id of A, ``count_sum`` the sum of
    the texts of each link's pair.  The paths must exist on every executor.
    """
    a_own, b_own = default_paths() if a_path is None or b_path is None else (a_path, b_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = common.materialize(_chunks(rows, a_path or a_own, b_path or b_own, keep_groups), "alignment")
    pairs = made.where("a is not null").select("chunk", "a", "b", "local", "texts")
    totals = pairs.join(_totals(pairs), ["a", "b"])
    return _settle(made.where("a is null"), totals)


def op11_align_tokenizers(spark, sf_dir: str) -> DataFrame:
    found = align(common.table(spark, sf_dir, "documents"), keep_groups=False)
    return found.select("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")
