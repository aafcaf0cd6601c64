"""Token counts of a byte-fallback pair-merging vocabulary, by array merging.

The vocabulary is a public ``sentencepiece`` model with identity normalisation;
its path is a parameter.  A text becomes "blank mark + text" with every blank
replaced by the mark.  No piece has a mark after another character, so a text
can be cut before each run of marks, and around characters that occur in no
longer piece, without changing a merge.  Such pre-tokens are counted once per
batch, and kept in a bounded cache.

Pre-tokens of a batch lie in one ragged array of symbol ids.  Each round looks up
the rank of every neighbouring pair, finds each sequence's lowest rank (leftmost
if several) and merges that pair in all sequences at once, until no sequence has
a pair.  A surviving symbol outside the vocabulary counts its bytes.

A round merges one pair a sequence, so very long pre-tokens would need very many
rounds; above ``LONG`` symbols the same merges are made with a heap.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows keep their
ids, null or repeated; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common

MARK = "▁"
LONG = 400
CACHE_ENTRIES = 500_000
NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Symbol ids, merge table and token costs, read from a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        score = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        self.ids = {piece: i for i, piece in enumerate(score)}
        self.cost = [1] * len(score)
        for c in sorted({c for piece in score for c in piece}):
            if c not in self.ids:
                self.ids[c] = len(self.cost)
                self.cost.append(len(c.encode("utf-8", "surrogatepass")))
        self.known = len(self.cost)
        self.by_code = np.full(0x110000, self.known, np.int64)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.by_code[ord(c)] = i
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        keys, ranks, merged = [], [], []
        for piece, s in score.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(order[s])
                    merged.append(self.ids[piece])
        by = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[by]
        self.ranks = np.array(ranks, np.int64)[by]
        self.merged = np.array(merged, np.int64)[by]
        self.pairs = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.merged)}
        joined = {c for piece in score if len(piece) > 1 for c in piece}
        self.inside = joined - {MARK}
        inner = re.escape("".join(sorted(self.inside)))
        self.pattern = re.compile(f"{MARK}*[{inner}]+|{MARK}+|[^{MARK}{inner}]")
        self.cache: dict[str, int] = {}

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts."""
        out, cache = [], self.cache
        # a slice of texts at a time keeps the list of pre-tokens small
        for group in _slices(texts, 1 << 21):
            cut = [
                self.pattern.findall(MARK + t.replace(" ", MARK)) if t else [] for t in group
            ]
            new = {w for words in cut for w in words if w not in cache}
            if len(cache) + len(new) > CACHE_ENTRIES:
                cache.clear()
                new = {w for words in cut for w in words}
            if new:
                cache.update(self._count_words(sorted(new)))
            get = cache.__getitem__
            out.extend(sum(map(get, words)) for words in cut)
        return out

    def _count_words(self, words: list[str]) -> Iterator[tuple[str, int]]:
        short = [w for w in words if len(w) <= LONG]
        for begin in range(0, len(short), 1 << 15):
            some = short[begin : begin + (1 << 15)]
            yield from zip(some, self._merge_arrays(some))
        for w in words:
            if len(w) > LONG:
                yield w, self._merge_heap(w)

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the characters, and the bytes of those that no piece has."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.by_code[code]
        wide = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        return sym, np.where(sym == self.known, wide, 0)

    def _merge_arrays(self, words: list[str]) -> list[int]:
        sym, extra = self._symbols(words)
        own = np.repeat(np.arange(len(words)), [len(w) for w in words])
        total = np.bincount(own, extra, len(words)).astype(np.int64)
        cost = np.array([*self.cost, 0], np.int64)
        while len(sym):
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (own[:-1] == own[1:])
            rank = np.append(np.where(hit, self.ranks[at], NONE), NONE)
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            best = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(sym)))
            active = np.repeat(best < NONE, size)
            if not active.all():  # finished sequences leave the arrays
                total += np.bincount(own[~active], cost[sym[~active]], len(words)).astype(np.int64)
                sym, own, rank = sym[active], own[active], rank[active]
                at = np.append(at, 0)[active]
                if not len(sym):
                    break
                keep = best < NONE
                best, size = best[keep], size[keep]
            else:
                at = np.append(at, 0)
            lowest = np.flatnonzero(rank == np.repeat(best, size))
            first = lowest[np.append(True, own[lowest][1:] != own[lowest][:-1])]
            sym[first] = self.merged[at[first]]
            left = np.ones(len(sym), bool)
            left[first + 1] = False
            sym, own = sym[left], own[left]
        return total.tolist()

    def _merge_heap(self, word: str) -> int:
        codes, more = self._symbols([word])
        sym, extra = codes.tolist(), int(more.sum())
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, heap = self.pairs, []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (p := pairs.get(sym[i] << 32 | sym[after[i]])):
                heap.append((p[0], i, sym[i], sym[after[i]], p[1])) if fill else heapq.heappush(
                    heap, (p[0], i, sym[i], sym[after[i]], p[1])
                )

        fill = True
        for i in range(n):
            offer(i)
        heapq.heapify(heap)
        fill = False
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            if sym[i] != left or after[i] >= n or sym[after[i]] != right:
                continue
            j = after[i]
            sym[i], sym[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        cost = [*self.cost, 0]
        return extra + sum(cost[s] for s in sym if s >= 0)


def _slices(texts: list[str], chars: int) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_count(text: str | Column, path: str | None = None) -> Column:
    """Column of token counts; ``path`` must exist on every executor."""
    path = path or default_path()

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = vocabulary(path)
        for batch in batches:
            yield pd.Series(known.count_all(batch.tolist()), dtype="int64")

    return counted(common.text_of(text))


def token_counts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, path: str | None = None
) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(common.text_of(text_col)).cast("long").alias("n_bytes"),
        token_count(text_col, path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
