"""Benchmark decontamination by the q-gram lemma and banded alignment.

A region within ``k`` edits of an item of length m shares at least
T = m - q + 1 - k q of its q-grams, all within k of one diagonal.  Per document:
count hits of any item's q-gram in sliding windows (regions far too sparse for
every item end here); expand the other hits to (item, diagonal); count them in
diagonal bands that overlap by the budget; keep bands with T hits; verify them by
alignment within the band.  Nothing is lost at any step.

The items are the stated query set.  They are read in blocks of ``block_chars``
characters; each block is a pass over the documents, without a shuffle, so what
a task holds has a fixed size whatever the size of the benchmark.

Letters match in either case and any blank matches any other.  The budget is
``rate`` of an item's length.  Items of less than ``2 q`` characters match
exactly.  Offsets are code points of the text.

Defined results: null or empty texts and items match nothing; rows with null or
equal ids are judged alone; equal items are all reported; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common, rolling

Q = 8
RATE = 0.06
WINDOW = 64
BITS = 21
MATCH = "item_id long, start int, end int, edits int"
#: Characters of documents that are hashed together.
CHUNK = 1 << 19


def fold(text: str) -> str:
    """Lower case, blanks alike; as long as the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_BLANKS)


_BLANKS = {c: " " for c in (9, 10, 11, 12, 13, 0xA0)}


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def alignment_end(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(edits, end) of the best match of the whole item to some part of the region."""
    at = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, c in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (region != c), row[1:] + 1)
        row = np.minimum.accumulate(best - at) + at
    end = int(np.argmin(row))
    return int(row[end]), end


def align(item: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match, if within the budget."""
    edits, end = alignment_end(item, region)
    if edits > budget:
        return None
    # from the end backwards: the same best match, now with its start
    back = region[max(0, end - len(item) - budget) : end][::-1]
    at = np.arange(len(back) + 1)
    row = at.copy()
    for i, c in enumerate(item[::-1], 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (back != c), row[1:] + 1)
        row = np.minimum.accumulate(best - at) + at
    return edits, end - int(np.argmin(row)), end


@dataclass
class Items:
    """A block of items, indexed by q-gram."""

    ids: list[int]
    texts: list[str]
    q: int = Q
    rate: float = RATE
    exact: list[int] = field(default_factory=list)

    def __post_init__(self):
        folded = [fold(t) for t in self.texts]
        self.codes = [codes(t) for t in folded]
        self.folded = folded
        n = len(folded)
        self.budget = np.zeros(n, np.int64)
        self.need = np.zeros(n, np.int64)
        hashes, owner, place = [], [], []
        window_need = WINDOW
        for i, c in enumerate(self.codes):
            m = len(c)
            if m < 2 * self.q:
                self.exact += [i] if m else []
                continue
            k = min(int(self.rate * m), (m - self.q) // self.q)
            grams = m - self.q + 1
            self.budget[i], self.need[i] = k, grams - k * self.q
            window_need = min(window_need, -(-int(self.need[i]) // -(-(grams + k) // WINDOW)))
            hashes.append(rolling.window_hashes(c, self.q))
            owner.append(np.full(grams, i))
            place.append(np.arange(grams))
        self.window_need = max(1, window_need)
        self.longest = max([len(c) for c in self.codes], default=0) + int(self.budget.max(initial=0))
        if hashes:
            h = np.concatenate(hashes)
            by = np.argsort(h, kind="stable")
            self.hashes, self.owner, self.place = h[by], np.concatenate(owner)[by], np.concatenate(place)[by]
        else:
            self.hashes = np.zeros(0, np.uint64)
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.hashes >> np.uint64(64 - BITS)] = True
        shift = max(1, int(self.budget.max(initial=0)))
        self.shift = max(4, shift.bit_length())

    def find(self, texts: list[str]) -> list[list[tuple]]:
        """Matches (item id, start, end, edits) of each text."""
        out: list[list[tuple]] = [[] for _ in texts]
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            group.append(i)
            size += len(t)
            if size >= CHUNK or i + 1 == len(texts):
                self._find_in(group, texts, out)
                group, size = [], 0
        return out

    def _find_in(self, group: list[int], texts: list[str], out: list[list[tuple]]) -> None:
        folded = [fold(texts[i]) for i in group]
        for j in self.exact:
            for i, t in zip(group, folded):
                at = t.find(self.folded[j])
                while at >= 0:
                    out[i].append((self.ids[j], at, at + len(self.folded[j]), 0))
                    at = t.find(self.folded[j], at + 1)
        if not len(self.hashes):
            return
        c = codes("\0".join(folded))
        h = rolling.window_hashes(c, self.q)
        hit = self.bitmap[h >> np.uint64(64 - BITS)]
        total = np.concatenate(([0], np.cumsum(hit)))
        dense = np.flatnonzero(total[WINDOW:] - total[:-WINDOW] >= self.window_need) if len(h) > WINDOW else (
            np.zeros(int(total[-1] >= self.window_need), np.int64)
        )
        if not len(dense):
            return
        near = np.zeros(len(h) + 1, np.int64)
        np.add.at(near, np.maximum(dense - self.longest, 0), 1)
        np.add.at(near, np.minimum(dense + WINDOW + self.longest, len(h)), -1)
        at = np.flatnonzero(hit & (np.cumsum(near[:-1]) > 0))
        begin = np.searchsorted(self.hashes, h[at], "left")
        count = np.searchsorted(self.hashes, h[at], "right") - begin
        at, begin, count = at[count > 0], begin[count > 0], count[count > 0]
        if not len(at):
            return
        entry = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        position = np.repeat(at, count)
        item = self.owner[entry]
        # diagonals are counted from the first one that any item can have
        diagonal = position - self.place[entry] + self.longest
        band = diagonal >> self.shift
        lower = (diagonal & ((1 << self.shift) - 1)) <= self.budget[item]
        keys = np.concatenate((item << 40 | band, (item << 40 | (band - 1))[lower]))
        keys, hits = np.unique(keys, return_counts=True)
        keys = keys[hits >= self.need[keys >> 40]]
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in folded])))
        for key in keys.tolist():
            self._verify(key >> 40, key & (1 << 40) - 1, c, starts, group, out)

    def _verify(self, j: int, band: int, c: np.ndarray, starts: np.ndarray, group: list[int], out) -> None:
        k, m = int(self.budget[j]), len(self.codes[j])
        low = (band << self.shift) - self.longest - k
        high = low + (2 << self.shift) + m + 3 * k
        low, high = max(0, low), min(high, len(c))
        # a region is cut at document borders; each part is aligned alone
        first = int(np.searchsorted(starts, low, "right")) - 1
        for d in range(first, len(group)):
            begin, end = max(low, int(starts[d])), min(high, int(starts[d + 1]) - 1)
            if int(starts[d]) >= high:
                break
            if end - begin < m - k:
                continue
            found = align(self.codes[j], c[begin:end], k)
            if found:
                edits, s, e = found
                offset = begin - int(starts[d])
                out[group[d]].append((self.ids[j], offset + s, offset + e, edits))


def distinct(matches: list[tuple]) -> list[tuple]:
    """The best of overlapping matches of an item."""
    kept: list[tuple] = []
    for m in sorted(matches, key=lambda m: (m[0] is None, m[0] or 0, m[3], m[1], m[2])):
        if not any(o[0] == m[0] and o[1] < m[2] and m[1] < o[2] for o in kept[-50:]):
            kept.append(m)
    return sorted(kept, key=lambda m: (m[1], m[2], m[0] is None, m[0] or 0))


_INDEXES: dict[tuple, Items] = {}


def _index(ids: list[int], texts: list[str], q: int, rate: float) -> Items:
    """The index of a block, built once per process."""
    key = (tuple(ids), hash(tuple(texts)), q, rate)
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Items(ids, texts, q, rate)
    return _INDEXES[key]


def blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[tuple[list, list]]:
    """The items in blocks; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    for r in rows.toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"])
        if size >= block_chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    q: int = Q,
    rate: float = RATE,
    block_chars: int = 1 << 20,
) -> DataFrame:
    """One row per match: doc_id, item_id, start, end, edits."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("body"))
    schema = f"doc_id long, {MATCH}"
    out = None
    for ids, texts in blocks(items, item_id_col, item_text_col, block_chars):

        def search(batches, ids=ids, texts=texts):
            index = _index(ids, texts, q, rate)
            for batch in batches:
                found = index.find(batch["body"].tolist())
                hits = [(d, *m) for d, ms in zip(batch["doc_id"].astype(object), found) for m in distinct(ms)]
                frame = pd.DataFrame(hits, columns=["doc_id", "item_id", "start", "end", "edits"], dtype=object)
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64", "start": "int32", "end": "int32", "edits": "int32"})

        part = rows.mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", q: int = Q, rate: float = RATE, block_chars: int = 1 << 20) -> DataFrame:
    """``docs`` without the rows in which an item is found, all columns kept."""
    for ids, texts in blocks(items, item_id_col, item_text_col, block_chars):

        @F.pandas_udf("boolean")
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = _index(ids, texts, q, rate)  # noqa: B023  pickled before the next block
            for batch in batches:
                yield pd.Series([not m for m in index.find(batch.tolist())], dtype=bool)

        docs = docs.where(clean(common.text_of(text_col)))
    return docs


def op7_contamination(spark, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
