"""Removal of repeated strings by a distributed, hash-compared suffix sort.

A byte goes if a ``length``-byte string over it also starts in a document with a
smaller id.  Sorting all suffixes of a corpus would shuffle it many times over, so
the suffixes are sorted where they can matter, without losing any:

1. Every string of ``length`` bytes picks an anchor, the k-gram of least hash in it
   (leftmost if several), so equal strings pick equal anchors at equal offsets.
   About one position in twenty is an anchor.  Anchors of only one text end here;
   only hashes are shuffled for that.
2. The strings of a repeated anchor form a context.  Equal contexts need no sort:
   all but the one of the smallest id go.  What is left is sorted: suffixes of one
   anchor and offset, by mergesort, where two suffixes are compared by a binary
   search for their common extension on prefix polynomial hashes; a suffix whose first
   ``length`` bytes have a hash of their own is left out, and of those that share one
   hash one is sorted and places the others.  Neighbours of
   ``length`` common bytes are equal strings, which is verified on the bytes.
3. The runs found are merged per document and cut from its text.

Hot strings: within a chunk of a task, anchors seen in several texts and contexts
that an earlier id has are settled at once, so a string that a third of all
texts contain sends one row a chunk.  An anchor met in more than ``hot`` chunks
sends its strings one by one, keyed by their own hash, so that texts which differ
around it go to different tasks.  Whole copies are found by a digest and counted
once.

Defined results: a null text is empty; texts shorter than ``length`` stay; a null
id counts as larger than all others; rows with equal ids never remove from one
another; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common, rolling

LENGTH = 50
GRAM = 16
CHUNK = 1 << 24
LAST = (1 << 63) - 1
#: Bytes of texts that are looked at together.
TEXT_BYTES = 1 << 16
#: Contexts that are sorted together, if one anchor does not have more.
SLICE = 1 << 14
#: Of an anchor's order, the bits that a position takes beside the hash.
POSITION_BITS = 24

#: Text, hash, position, first string, number of strings, and hash of the bytes of all its strings.
Anchors = namedtuple("Anchors", "text, hash, position, start, strings, whole")


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first string, number of strings) of the anchors of a text."""
    found = _anchors(data, np.array([len(data)]), length, gram)
    return found.hash, found.position, found.start, found.strings


def _anchors(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> Anchors:
    """The anchors of texts of these sizes, one behind the other in ``data``."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return Anchors(none, none.astype(np.uint64), none, none, none, none.astype(np.uint64))
    sums = rolling.prefix_hashes(data)
    _, down = rolling.powers(len(data) + 1)
    size = len(data) - gram + 1
    h = (sums[gram:] - sums[:-gram]) * down[:size]
    width = length - gram + 1
    # the least (upper bits of the hash, position) of every window, by doubling
    low = np.uint64((1 << POSITION_BITS) - 1)
    if len(h) <= int(low):
        best = h & ~low
        best |= np.arange(len(h), dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            best = np.minimum(best[:-step], best[step:])
            step *= 2
        if step < width:
            size = len(h) - width + 1
            best = np.minimum(best[:size], best[width - step : width - step + size])
        at = (best & low).view(np.int64)
    else:  # too long for a position beside the hash
        best, at, step = h & ~low, np.arange(len(h)), 1
        while step * 2 <= width:
            best, at = _less(best, at, step)
            step *= 2
        if step < width:
            best, at = _less(best, at, width - step, len(h) - width + 1)
    # a string lies in one text; texts have no anchor in common
    n = len(data) - length + 1
    change = np.append(True, at[1:] != at[:-1])
    end = np.cumsum(sizes)
    last = np.clip(end - length + 1, 0, n)
    for a, b, e in zip(np.append(0, end[:-1]).tolist(), last.tolist(), end.tolist()):
        change[max(a, b) : e] = False
        if a < b:
            change[a] = True
        if max(a, b) < n:
            change[max(a, b)] = True  # what begins here is no string of this text
    starts = np.flatnonzero(change)
    strings = np.diff(np.append(starts, n))
    text = np.searchsorted(end, starts, "right")
    inside = starts < last[np.minimum(text, len(last) - 1)]
    starts, strings, text = starts[inside], strings[inside], text[inside]
    position = at[starts]
    stop = starts + strings + length - 1
    return Anchors(text, rolling.spread(h[position]), position, starts, strings, (sums[stop] - sums[starts]) * down[starts])


def _less(best: np.ndarray, at: np.ndarray, step: int, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    size = len(best) - step if size is None else size
    a, b = best[:size], best[step : step + size]
    left = a <= b
    return np.where(left, a, b), np.where(left, at[:size], at[step : step + size])


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Rows of the batches in chunks of a bounded number of bytes."""
    held, size = [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            raw = row.body.encode("utf-8", "surrogatepass")
            held.append((row, raw))
            size += len(raw)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _chunk_anchors(texts: list[bytes], length: int, gram: int) -> Anchors:
    """The anchors of the texts of a chunk, with places in each text."""
    out: list[Anchors] = []
    first, size = 0, 0
    for i, raw in enumerate(texts):
        size += len(raw)
        if size >= TEXT_BYTES or i + 1 == len(texts):
            some = texts[first : i + 1]
            sizes = np.array([len(t) for t in some])
            found = _anchors(np.frombuffer(b"".join(some), np.uint8), sizes, length, gram)
            begin = (np.cumsum(sizes) - sizes)[found.text]
            out.append(found._replace(text=found.text + first, position=found.position - begin, start=found.start - begin))
            first, size = i + 1, 0
    return Anchors(*[np.concatenate(x) for x in zip(*out)])


def _repeated(rows: DataFrame, length: int, gram: int, buckets: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(key, hashes), the anchors of each text that other texts have too, and ``hot_hash``."""
    groups = buckets  # of texts, that answers are sent to
    bits = max(1, (buckets - 1).bit_length())

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _texts(batches):
            keys = np.array([row.key for row, _ in chunk], np.int64)
            anchored = _chunk_anchors([raw for _, raw in chunk], length, gram)
            by = np.argsort(anchored.hash, kind="stable")
            found, owner = anchored.hash[by], anchored.text[by]
            once = np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1]))[: len(found)]
            found, owner = found[once], owner[once]
            begin = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
            size = np.diff(np.append(begin, len(found)))
            mine = keys[owner]
            first = mine[begin]
            # repeated here: by texts of different keys
            several = np.minimum.reduceat(mine, begin) != np.maximum.reduceat(mine, begin) if len(begin) else np.zeros(0, bool)
            known = np.repeat(several, size)
            out = []
            by = np.argsort(owner[known], kind="stable")
            own, hashes = owner[known][by], found[known][by]
            cuts = np.searchsorted(own, np.arange(len(chunk) + 1)).tolist()
            for o, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    out.append((int(keys[o]) & 0x7FFFFFFF, 1, hashes[a:b].tobytes(), keys[o : o + 1].tobytes(), b""))
            # one entry for each hash: who asks, or that it is known to be repeated
            unique = found[begin]
            bucket = (unique >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            for b in range(1 << bits):
                s = slice(cuts[b], cuts[b + 1])
                if cuts[b] < cuts[b + 1]:
                    out.append((b, 0, unique[s].tobytes(), first[s].tobytes(), np.packbits(several[s]).tobytes()))
            yield pd.DataFrame(out, columns=["bucket", "kind", "hashes", "keys", "several"])

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole buckets at a time; the answers of several buckets go out together."""
        held: list = []
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            out: list[tuple] = []
            passed: list[tuple[np.ndarray, np.ndarray]] = []
            for r in batch.itertuples(index=False):
                if r.kind == 1:
                    passed.append((np.repeat(np.frombuffer(r.keys, np.int64), len(r.hashes) // 8), np.frombuffer(r.hashes, np.uint64)))
                    continue
                if held and r.bucket != held[-1].bucket:
                    ready.append(_asked(held, hot, out))
                    held = []
                held.append(r)
            ready.extend(passed)
            if sum(len(k) for k, _ in ready) > 1 << 20:
                out.extend(_packed(ready, groups))
                ready = []
            yield _answers(out)
        last: list[tuple] = []
        if held:
            ready.append(_asked(held, hot, last))
        yield _answers(last + _packed(ready, groups))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The answers to each text, of all tasks; one group of texts at a time."""
        found: list = []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if found and r.part != found[-1].part:
                    yield _gathered(found)
                    found = []
                found.append(r)
        if found:
            yield _gathered(found)

    sent = rows.mapInPandas(collect, "bucket int, kind int, hashes binary, keys binary, several binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("kind", "bucket")
    answers = common.materialize(dealt.mapInPandas(answer, PACKED), "suffix-answers")
    asked = answers.where("part is not null").select("part", "keys", "hashes")
    asked = asked.repartition("part").sortWithinPartitions("part")
    return (
        common.materialize(asked.mapInPandas(gather, "key long, hashes binary"), "suffix-anchors"),
        common.materialize(answers.where("hot_hash is not null").select("hot_hash"), "suffix-hot"),
    )


PACKED = "part int, keys binary, hashes binary, hot_hash long"

def _answers(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["part", "keys", "hashes", "hot_hash"], dtype=object)
    return frame.astype({"part": "Int32", "hot_hash": "Int64"})


def _asked(rows: list, hot: int, out: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, hashes): answers to texts that ask about hashes which another chunk has too.

    Rows of hot hashes are added to ``out``.
    """
    hashes = np.concatenate([np.frombuffer(r.hashes, np.uint64) for r in rows])
    keys = np.concatenate([np.frombuffer(r.keys, np.int64) for r in rows])
    several = np.concatenate(
        [np.unpackbits(np.frombuffer(r.several, np.uint8))[: len(r.hashes) // 8].astype(bool) for r in rows]
    )
    by = np.argsort(hashes, kind="stable")
    hashes, keys, several = hashes[by], keys[by], several[by]
    begin = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    size = np.diff(np.append(begin, len(hashes)))
    low, high = np.minimum.reduceat(keys, begin), np.maximum.reduceat(keys, begin)
    repeated = np.repeat((low != high) | np.logical_or.reduceat(several, begin), size)
    out.extend((None, b"", b"", h) for h in hashes[begin][size > hot].view(np.int64).tolist())
    pick = repeated & ~several  # chunks that know by themselves need no answer
    return keys[pick], hashes[pick]


def _packed(answers: list[tuple[np.ndarray, np.ndarray]], groups: int) -> list[tuple]:
    """A row for each group of texts: (group, keys, hashes, None)."""
    keys = np.concatenate([np.zeros(0, np.int64), *[k for k, _ in answers]])
    hashes = np.concatenate([np.zeros(0, np.uint64), *[h for _, h in answers]])
    part = keys % groups
    by = np.argsort(part, kind="stable")
    keys, hashes, part = keys[by], hashes[by], part[by]
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
    return [
        (int(part[a]), keys[a:b].tobytes(), hashes[a:b].tobytes(), None) for a, b in zip(begin, [*begin[1:], len(part)])
    ]


def _gathered(rows: list) -> pd.DataFrame:
    keys = np.concatenate([np.frombuffer(r.keys, np.int64) for r in rows])
    hashes = np.concatenate([np.frombuffer(r.hashes, np.uint64) for r in rows])
    by = np.argsort(keys, kind="stable")
    keys, hashes = keys[by], hashes[by]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return pd.DataFrame(
        {"key": keys[begin], "hashes": [hashes[a:b].tobytes() for a, b in zip(begin, [*begin[1:], len(keys)])]}
    )


def _hot(hits: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, hot): which of a text's anchors are hot; every text hears of all of them."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [np.frombuffer(h, np.int64) for h in batch["hashes"]]
            yield pd.DataFrame(
                {"key": np.repeat(batch["key"].to_numpy(np.int64), [len(h) for h in hashes]), "hot_hash": np.concatenate([*hashes, np.zeros(0, np.int64)])}
            )

    each = hits.mapInPandas(explode, "key long, hot_hash long")
    return each.join(hot.distinct(), "hot_hash").groupBy("key").agg(F.collect_set("hot_hash").alias("hot"))


#: Contexts of a bucket of anchors (kind 0), or settled runs of a group of texts (kind 1: keys, starts, ends as offsets).
CONTEXTS = "bucket int, kind int, anchors binary, keys binary, ids binary, starts binary, strings binary, offsets binary, bytes binary"
KINDS = {"anchors": np.int64, "keys": np.int64, "ids": np.int64, "starts": np.int32, "strings": np.int32, "offsets": np.int32}
RUNS = "part int, keys binary, starts binary, ends binary"
Context = namedtuple("Context", "anchor, key, id, start, strings, offset, bytes")


def _contexts(texts: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """The contexts of repeated anchors that no smaller id of the chunk has, by buckets of anchors."""
    bits = max(1, (buckets - 1).bit_length())
    width = 2 * length - gram

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _texts(batches):
            chunk.sort(key=lambda r: r[0].id)
            raws = [raw for _, raw in chunk]
            found = _chunk_anchors(raws, length, gram)
            cuts = np.searchsorted(found.text, np.arange(len(chunk) + 1)).tolist()
            take = [_among(found.hash[a:b], np.sort(np.frombuffer(row.hashes, np.uint64))) for (row, _), a, b in zip(chunk, cuts, cuts[1:])]
            found = Anchors(*[x[np.concatenate(take)] for x in found])
            offset = found.position - found.start
            name = _signed(found.hash)
            burning = np.zeros(len(name), bool)
            for i, (row, _) in enumerate(chunk):
                if row.hot is not None and len(row.hot):
                    a, b = np.searchsorted(found.text, [i, i + 1])
                    burning[a:b] = np.isin(found.hash[a:b].view(np.int64), np.array(row.hot, np.int64))
            if burning.any():
                found, name, offset = _one_by_one(found, name, offset, burning, raws, length)
            ids, keys = (np.array([getattr(row, c) for row, _ in chunk], np.int64)[found.text] for c in ("id", "key"))
            size = found.strings + length - 1
            begin = np.cumsum([0, *[len(raw) for raw in raws]])[found.text] + found.start
            first = _first_equal(name, offset, found.strings, found.whole)
            windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join([*raws, bytes(width)]), np.uint8), width)
            settled = np.zeros(len(name), bool)
            some = np.flatnonzero(ids[first] < ids)
            for a in range(0, len(some), SLICE):
                i = some[a : a + SLICE]
                j = first[i]
                equal = (name[i] == name[j]) & (offset[i] == offset[j]) & (size[i] == size[j])
                settled[i] = equal & _equal_bytes(windows[begin[i]], windows[begin[j]], size[i])
            out = []
            # contexts come in the order of the text: what is settled forms runs
            text, start, end = _joined(found.text[settled], found.start[settled], (found.start + size)[settled])
            for r in _packed_runs(np.array([row.key for row, _ in chunk], np.int64)[text], start, end, buckets):
                out.append((r[0], 1, b"", r[1], b"", r[2], b"", r[3], b""))
            rest = np.flatnonzero(~settled)
            bucket = (name[rest].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            rest = rest[np.argsort(bucket, kind="stable")]
            cuts = np.searchsorted(np.sort(bucket), np.arange((1 << bits) + 1)).tolist()
            columns = {"anchors": name, "keys": keys, "ids": ids, "starts": found.start, "strings": found.strings, "offsets": offset}
            packed = [x[rest].astype(KINDS[c]) for c, x in columns.items()]
            bytes_ = [raws[t][a:b] for t, a, b in zip(found.text[rest].tolist(), found.start[rest].tolist(), (found.start + size)[rest].tolist())]
            for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    out.append((n, 0, *[x[a:b].tobytes() for x in packed], b"".join(bytes_[a:b])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CONTEXTS.split(", ")])

    return texts.mapInPandas(cut, CONTEXTS)


def _among(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which hashes are wanted; ``wanted`` is sorted."""
    if not len(wanted):
        return np.zeros(len(hashes), bool)
    return wanted[np.minimum(wanted.searchsorted(hashes), len(wanted) - 1)] == hashes


def _signed(h: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones of the same order."""
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def _first_equal(name: np.ndarray, offset: np.ndarray, strings: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """For each context the first one that is equal, by hash."""
    place = (offset.astype(np.uint64) << np.uint64(32)) + strings.astype(np.uint64)
    _, first, same = np.unique(
        rolling.spread(rolling.spread(name.view(np.uint64) + rolling.spread(place)) ^ whole), return_index=True, return_inverse=True
    )
    return first[same]


def _equal_bytes(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows whose first ``size`` bytes are equal."""
    return ~((a != b) & (np.arange(a.shape[1]) < size[:, None])).any(1)


def _one_by_one(found: Anchors, name: np.ndarray, offset: np.ndarray, burning: np.ndarray, raws: list[bytes], length: int) -> tuple:
    """The strings of hot anchors on their own, each under a name of its content."""
    n = np.where(burning, found.strings, 1)
    each = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    found, name, offset = Anchors(*[x[each] for x in found]), name[each], offset[each] - nth
    found = found._replace(start=found.start + nth, strings=np.where(burning[each], 1, found.strings))
    for i in np.flatnonzero(burning[each]).tolist():
        a = int(found.start[i])
        name[i] = int.from_bytes(hashlib.md5(raws[found.text[i]][a : a + length]).digest()[:8], "little") - (1 << 63)
        found.whole[i] = name[i].view(np.uint64)
    return found, name, offset


def _joined(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that meet or overlap as one; they come by group, a number from 0 on, and start."""
    if not len(group):
        return group, start, end
    far = int(end.max()) + 2
    base = group.astype(np.int64) * far
    reach = np.maximum.accumulate(base + end)
    new = np.flatnonzero(np.append(True, (base + start)[1:] > reach[:-1]))
    last = np.append(new[1:], len(group)) - 1
    return group[new], start[new], reach[last] - base[last]


def _packed_runs(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, groups: int) -> list[tuple]:
    """A row for each group of texts."""
    part = keys % groups
    by = np.argsort(part, kind="stable")
    keys, starts, ends, part = keys[by], starts[by].astype(np.int32), ends[by].astype(np.int32), part[by]
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(part) else []
    return [(int(part[a]), keys[a:b].tobytes(), starts[a:b].tobytes(), ends[a:b].tobytes()) for a, b in zip(begin, [*begin[1:], len(part)])]


class SuffixOrder:
    """Compares suffixes of a byte buffer by prefix hashes, up to ``depth`` bytes."""

    def __init__(self, data: np.ndarray, depth: int):
        self.data, self.depth = data, depth
        self.sums = rolling.prefix_hashes(data)
        _, self.down = rolling.powers(len(data) + 1)

    def window(self, a: np.ndarray) -> np.ndarray:
        """Hashes of the first ``depth`` bytes of suffixes that are as long."""
        return (self.sums[a + self.depth] - self.sums[a]) * self.down[a]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.depth)
        while True:
            middle = (low + high + 1) >> 1
            if not (low < high).any():
                return low
            same = (self.sums[a + middle] - self.sums[a]) * self.down[a] == (self.sums[b + middle] - self.sums[b]) * self.down[b]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        differ = n < self.depth
        return differ & (self.data[a + n - (~differ)] < self.data[b + n - (~differ)])

    def sort(self, segment: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Order of suffixes by (segment, suffix); a stable mergesort of all segments at once."""
        order = np.argsort(segment, kind="stable")
        seg = segment[order]
        begin = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        size = np.diff(np.append(begin, len(seg)))
        base = np.repeat(begin, size)
        end = base + np.repeat(size, size)
        local = np.arange(len(seg)) - base
        run = 1
        while run < size.max(initial=0):
            mine = local // run
            right = mine % 2 == 1
            other = base + np.where(right, mine - 1, mine + 1) * run
            low, high = np.minimum(other, end), np.minimum(other + run, end)
            first = low.copy()
            s = start[order]
            # rank in the sibling run: of equal suffixes the left run's come first
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                theirs, own = s[middle], s[open_]
                goes = np.where(right[open_], ~self.less(own, theirs), self.less(theirs, own))
                low[open_] = np.where(goes, middle + 1, low[open_])
                high[open_] = np.where(goes, high[open_], middle)
            place = base + (mine - right) * run + local % run + (low - first)
            merged = np.empty_like(order)
            merged[place] = order
            order = merged
            run *= 2
        return order


def _settled(rows: list, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, starts, ends) of the strings that a smaller id has too; whole anchors, a slice of them at a time."""
    anchor, key, id_, start, strings, offset = (
        np.concatenate([np.frombuffer(getattr(r, c), kind) for r in rows]) for c, kind in KINDS.items()
    )
    width = 2 * length - gram
    data = np.frombuffer(b"".join([*[r.bytes for r in rows], bytes(width)]), np.uint8)
    begin = np.cumsum(strings + (length - 1), dtype=np.int64) - strings - (length - 1)
    windows = np.lib.stride_tricks.sliding_window_view(data, width)
    by = np.lexsort((id_, anchor))
    several = anchor[by][1:] == anchor[by][:-1]
    by = by[np.append(several, False) | np.append(False, several)]  # anchors of one context end here
    ends = np.append(np.flatnonzero(anchor[by][1:] != anchor[by][:-1]) + 1, len(by))
    done = 0
    while done < len(by):
        end = ends[max(np.searchsorted(ends, done + SLICE, "right") - 1, np.searchsorted(ends, done, "right"))]
        some = by[done:end]
        yield _sorted_out(*[x[some] for x in (anchor, key, id_, start, strings, offset)], windows[begin[some]], length)
        done = end


def _sorted_out(anchor, key, id_, start, strings, offset, windows, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, starts, ends) of the strings that a smaller id has too; contexts come by anchor and id."""
    data = windows.reshape(-1)
    order = SuffixOrder(data, length)
    begin = np.arange(len(windows)) * windows.shape[1]
    size = strings + length - 1
    # equal contexts: all but the smallest id go, the rest is sorted
    first = _first_equal(anchor, offset, strings, (order.sums[begin + size] - order.sums[begin]) * order.down[begin])
    settled = np.zeros(len(anchor), bool)
    i = np.flatnonzero(id_[first] < id_)
    j = first[i]
    settled[i] = (anchor[i] == anchor[j]) & (offset[i] == offset[j]) & (size[i] == size[j]) & _equal_bytes(windows[i], windows[j], size[i])
    out = [(key[settled], start[settled], (start + size)[settled])]

    def found() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*out))

    kept = np.flatnonzero(~settled)
    several = anchor[kept][1:] == anchor[kept][:-1]
    kept = kept[np.append(several, False) | np.append(False, several)] if len(kept) else kept
    if not len(kept):
        return found()
    count = strings[kept]
    own = np.repeat(kept, count)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[own] + nth
    group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1]))
    segment = group[own] * (length + 1) + offset[own] - nth
    # suffixes whose first bytes have a hash of their own need no comparison: no other suffix begins like them
    whole = order.window(at) ^ (segment.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by = np.sort(whole)
    twice = by[1:][by[1:] == by[:-1]]
    take = _among(whole, twice)
    own, nth, at, segment = own[take], nth[take], at[take], segment[take]
    if not len(own):
        return found()
    # of those that share it one is sorted, and the others take its place
    _, one, same = np.unique(whole[take], return_index=True, return_inverse=True)
    place = np.empty(len(one), np.int64)
    place[order.sort(segment[one], at[one])] = np.arange(len(one))
    by = np.lexsort((segment, place[same]))
    own, nth, at, segment = own[by], nth[by], at[by], segment[by]
    near = (segment[1:] == segment[:-1]) & (order.common(at[1:], at[:-1]) >= length)
    pairs = np.flatnonzero(near)
    window = np.arange(length)
    for a in range(0, len(pairs), SLICE):
        some = pairs[a : a + SLICE]
        if (data[at[some + 1][:, None] + window] != data[at[some][:, None] + window]).any():
            # equal hashes of different bytes
            rows = [Context(*r[:-1], r[-1].tobytes()) for r in zip(*[x[kept].tolist() for x in (anchor, key, id_, start, strings, offset)], windows[kept])]
            out.append(tuple(np.array(x, np.int64) for x in zip(*_by_bytes(rows, length))) or (key[:0], start[:0], start[:0]))
            return found()
    ids = id_[own]
    begin_run = np.flatnonzero(np.append(True, ~near))
    least = np.repeat(np.minimum.reduceat(ids, begin_run), np.diff(np.append(begin_run, len(ids))))
    gone = ids > least
    own, nth = own[gone], nth[gone]
    by = np.lexsort((nth, own))
    own, nth = own[by], nth[by]
    if len(own):
        new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (nth[1:] != nth[:-1] + 1)))
        last = np.append(new[1:], len(own)) - 1
        out.append((key[own[new]], start[own[new]] + nth[new], start[own[last]] + nth[last] + length))
    return found()


def _by_bytes(kept: list, length: int) -> list[tuple]:
    """The same result by the strings themselves, where hashes collide."""
    least: dict = {}
    strings = [
        (r, i, (r.anchor, r.offset - i, r.bytes[i : i + length])) for r in kept for i in range(r.strings)
    ]
    for r, _, s in strings:
        least[s] = min(least.get(s, r.id), r.id)
    return [(r.key, r.start + i, r.start + i + length) for r, i, s in strings if r.id > least[s]]


def _removed(contexts: DataFrame, length: int, gram: int, groups: int) -> DataFrame:
    """(key, starts, ends) of the runs to remove from each text."""

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole buckets at a time; the runs of several buckets go out together."""
        held: list = []
        ready: list[tuple] = []

        def packed(ready: list[tuple]) -> pd.DataFrame:
            rows = _packed_runs(*[np.concatenate(x) for x in zip(*ready)], groups) if ready else []
            return pd.DataFrame(rows, columns=[c.split()[0] for c in RUNS.split(", ")])

        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.kind == 1:
                    ready.append(tuple(np.frombuffer(x, kind) for x, kind in ((r.keys, np.int64), (r.starts, np.int32), (r.offsets, np.int32))))
                    continue
                if held and r.bucket != held[-1].bucket:
                    ready.extend(_settled(held, length, gram))
                    held = []
                held.append(r)
            if sum(len(k) for k, *_ in ready) > 1 << 20:
                yield packed(ready)
                ready = []
        if held:
            ready.extend(_settled(held, length, gram))
        yield packed(ready)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The runs of each text, of all tasks; one group of texts at a time."""
        found: list = []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if found and r.part != found[-1].part:
                    yield _runs_by_text(found)
                    found = []
                found.append(r)
        if found:
            yield _runs_by_text(found)

    dealt = contexts.repartition("bucket").sortWithinPartitions("kind", "bucket")
    runs = common.materialize(dealt.mapInPandas(settle, RUNS), "suffix-runs")
    return runs.repartition("part").sortWithinPartitions("part").mapInPandas(gather, "key long, starts binary, ends binary")


def _runs_by_text(rows: list) -> pd.DataFrame:
    key = np.concatenate([np.frombuffer(r.keys, np.int64) for r in rows])
    start, end = (np.concatenate([np.frombuffer(getattr(r, c), np.int32) for r in rows]) for c in ("starts", "ends"))
    by = np.lexsort((start, key))
    keys, group = np.unique(key[by], return_inverse=True)
    group, start, end = _joined(group, start[by], end[by])
    start, end = start.astype(np.int32), end.astype(np.int32)
    cuts = np.searchsorted(group, np.arange(len(keys) + 1)).tolist()
    return pd.DataFrame(
        {"key": keys, "starts": [start[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], "ends": [end[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]}
    )


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    hot: int = 5000,
    with_kept: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept)."""
    spark = docs.sparkSession
    body = common.text_of(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        body.alias("body"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"),
        F.xxhash64(body).alias("key"),
    )
    long = rows.where(F.octet_length("body") >= length)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    hits, hots = _repeated(long.select("key", "body"), length, gram, buckets, hot)
    digests = common.materialize(
        long.groupBy("key", F.md5(F.col("body").cast("binary")).alias("digest")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")),
        "suffix-texts",
    )
    wanted = hits
    if hots.isEmpty():
        wanted = wanted.withColumn("hot", F.lit(None).cast("array<bigint>"))
    else:
        wanted = wanted.join(_hot(hits, hots), "key", "left")
    wanted = wanted.join(digests.select("key", F.col("first_id").alias("id")), "key")
    texts = long.select("key", "id", "body").join(wanted, ["key", "id"]).select("key", "id", "body", "hashes", "hot")
    runs = _removed(_contexts(texts, length, gram, buckets), length, gram, buckets)
    copies = digests.where(F.col("copies") > 1).select("key", "digest", "first_id")
    firsts = copies.groupBy("key").agg(F.collect_list(F.struct("digest", "first_id")).alias("texts"))
    notes = common.materialize(runs.join(firsts, "key", "full"), "suffix-notes")
    noted = rows.join(notes, "key", "left")
    copy = F.exists(
        "texts", lambda t: (t["digest"] == F.md5(F.col("body").cast("binary"))) & (t["first_id"] < F.col("id"))
    )
    noted = noted.select("doc_id", "body", "starts", "ends", (F.coalesce(copy, F.lit(False)) & (F.octet_length("body") >= length)).alias("copy"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, starts, ends, is_copy in zip(batch["doc_id"].astype("object"), batch["body"], batch["starts"], batch["ends"], batch["copy"]):
                raw = text.encode("utf-8", "surrogatepass")
                found = [] if starts is None else zip(np.frombuffer(starts, np.int32).tolist(), np.frombuffer(ends, np.int32).tolist())
                spans = [(0, len(raw))] if is_copy else list(found)
                at, left = 0, []
                for a, b in spans:
                    left.append(raw[at:a])
                    at = b
                left.append(raw[at:])
                kept = b"".join(left)
                row = (doc_id, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_kept else row)
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            frame["doc_id"] = pd.array([None if pd.isna(d) else int(d) for d in frame["doc_id"]], "Int64")
            yield frame

    return noted.mapInPandas(keep, schema)


def op3_remove_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))
