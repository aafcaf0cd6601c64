"""Fill-in-the-middle rearrangement of texts, cut at unit boundaries.

A text is cut into units (a word with the blanks before it; blanks at the end are
one unit).  The ends of its units form a :class:`BoundarySet`, a compressed set of
positions: positions are divided by their high 16 bits into containers, and each
container keeps its low 16 bits in the smallest of three forms, a sorted array, a
bitmap, or runs.  Cumulative cardinalities lead from a unit number to its
container, where a local select gives the offset, so both cuts of a text are two
look-ups, however long it is.

All choices come from a hash of seed and id, so reruns agree: the two cuts, whether
a text is rearranged at all, and in which order.  ``psm`` writes prefix, suffix,
middle; ``spm`` writes suffix, prefix, middle; a text that is empty or contains one
of the three markers stays ``plain``, so that :func:`restore` gives the exact text
back from output and form alone.

Defined results: a null or empty text has 0 units and stays plain; a null id is
hashed as no digits; rows of one id get the same draws, each on its own text; very
long texts are cut whole; other columns are ignored, whatever their names.  Texts
are taken as Unicode strings: bytes that are no UTF-8 are not supported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: positions of one container, and the size from which an array is larger than a bitmap
SPAN, ARRAY_MOST = 1 << 16, 4096


@dataclass(frozen=True)
class ArrayContainer:
    """Sorted low bits."""

    low: np.ndarray

    def select(self, i: int) -> int:
        return int(self.low[i])

    def rank(self, low: int) -> int:
        return int(np.searchsorted(self.low, low, "right"))


@dataclass(frozen=True)
class BitmapContainer:
    """One bit a position in 64-bit words, with the bits set before each word."""

    words: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(low: np.ndarray) -> BitmapContainer:
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return BitmapContainer(words, np.cumsum(counts) - counts)

    def select(self, i: int) -> int:
        at = int(np.searchsorted(self.before, i, "right")) - 1
        # words without bits share their count with the next one; the last has the bit
        word, left = int(self.words[at]), i - int(self.before[at])
        for _ in range(left):
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1

    def rank(self, low: int) -> int:
        at = low >> 6
        below = int(self.words[at]) & ((2 << (low & 63)) - 1)
        return int(self.before[at]) + below.bit_count()


@dataclass(frozen=True)
class RunContainer:
    """First positions and lengths of runs, with the positions before each run."""

    start: np.ndarray
    length: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(low: np.ndarray, first: np.ndarray) -> RunContainer:
        length = np.diff(np.append(first, len(low)))
        return RunContainer(low[first], length, first)

    def select(self, i: int) -> int:
        at = int(np.searchsorted(self.before, i, "right")) - 1
        return int(self.start[at]) + i - int(self.before[at])

    def rank(self, low: int) -> int:
        at = int(np.searchsorted(self.start, low, "right")) - 1
        if at < 0:
            return 0
        return int(self.before[at]) + min(low - int(self.start[at]) + 1, int(self.length[at]))


Container = ArrayContainer | BitmapContainer | RunContainer


def container(low: np.ndarray) -> Container:
    """The smallest form for these sorted low bits."""
    first = np.flatnonzero(np.append(True, np.diff(low) != 1))
    if 4 * len(first) < min(2 * len(low), SPAN // 8):
        return RunContainer.of(low, first)
    return ArrayContainer(low.astype(np.uint16)) if len(low) <= ARRAY_MOST else BitmapContainer.of(low)


class BoundarySet:
    """A set of positions with select and rank, in containers of 2^16 positions."""

    def __init__(self, positions: np.ndarray):
        """``positions`` in ascending order, without repeats."""
        high = positions >> 16
        begin = np.flatnonzero(np.append(True, np.diff(high) != 0)) if len(positions) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(positions))
        self.keys = high[begin]
        self.before = begin
        self.size = len(positions)
        self.containers = [container(positions[a:b] & (SPAN - 1)) for a, b in zip(begin, end)]

    def select(self, i: int) -> int:
        """The ``i``-th smallest position, from 0."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        at = int(np.searchsorted(self.before, i, "right")) - 1
        return (int(self.keys[at]) << 16) + self.containers[at].select(i - int(self.before[at]))

    def rank(self, position: int) -> int:
        """How many positions are at most ``position``."""
        at = int(np.searchsorted(self.keys, position >> 16, "right")) - 1
        if at < 0:
            return 0
        if self.keys[at] != position >> 16:
            return int(self.before[at + 1]) if at + 1 < len(self.before) else self.size
        return int(self.before[at]) + self.containers[at].rank(position & (SPAN - 1))

    def cut(self, units: int) -> int:
        """The offset after that many units."""
        return self.select(units - 1) if units else 0


def unit_ends(text: str) -> np.ndarray:
    """Offsets, in code points, at which the units of a text end."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (code == 32) | ((code >= 9) & (code <= 13))
    ends = ~blank
    ends[:-1] &= blank[1:]
    if len(code):
        ends[-1] = True
    return np.flatnonzero(ends) + 1


def rearrange(form: str, text: str, first: int, second: int) -> str:
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == PSM:
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restore(form: str, output: str) -> str:
    """The text, from its rearranged form alone."""
    if form == PLAIN:
        return output
    head, middle = output.split(MIDDLE)
    if form == PSM:
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX)
    else:
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX)
    return prefix + middle + suffix


def draws(id_col: str | Column, seed: int, count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers out of the hash of seed and id."""
    digits = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), digits), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(count)]


def transform(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42,
    rate: int = 50, spm_rate: int = 80,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output, restored`` per row.

    ``rate`` per cent of the texts are rearranged, ``spm_rate`` per cent of those as
    ``spm``.  ``restored`` is the text rebuilt from output and form.
    """
    markers = (PREFIX, SUFFIX, MIDDLE)

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string, restored string")
    def moved(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *numbers in batches:
            rows = []
            for text, h1, h2, h3, h4 in zip(texts, *(n.tolist() for n in numbers)):
                ends = BoundarySet(unit_ends(text))
                n = ends.size
                if h3 % 100 >= rate or not text or any(m in text for m in markers):
                    rows.append((n, PLAIN, None, None, text, text))
                    continue
                first, second = (ends.cut(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
                form = SPM if h4 % 100 < spm_rate else PSM
                output = rearrange(form, text, first, second)
                rows.append((n, form, first, second - first, output, restore(form, output)))
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "restored"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = moved(common.text_of(text_col), *draws(id_col, seed))
    return docs.select(F.col(id_col).alias("doc_id"), made.alias("made")).select("doc_id", "made.*")


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = transform(common.table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), numbers AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM hashed
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT doc_id, text, n, form,
         coalesce(array_to_string(units[1:a], ''), '') AS p,
         coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(units[b + 1:], ''), '') AS s
  FROM formed
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
