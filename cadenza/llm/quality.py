"""Quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled texts.  Every
whole text is compressed with either and with none; the difference of the two
sizes, per byte and relative, is what tells the classes apart.  A logistic
calibration, with the plain ratio and the length beside the differences, makes
it a score from 0 to 1.

Fitting reads a bounded sample of labelled rows (``dictionary_rows`` and
``calibration_rows`` a class, chosen by a hash of the id; of a dictionary's texts
at most ``dictionary_bytes`` each).  Rows whose crc32(id as text) mod 5 is 0 are
held out.  The dictionaries are trained on one half of the rest, the calibration
on the other.  Scoring reads every text in full, in one pass without a shuffle.

Defined results: a null or empty text is scored as empty; a null id is not held
out and never learned from; labels other than 0 and 1 are ignored; without both
labels the score is the share of label 1 (0.5 without any); repeated rows score
alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common

LEVEL = 3
FEATURES = ("per_byte", "relative", "ratio", "log_bytes")


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # bias, then FEATURES

    def score(self, text: str | Column) -> Column:
        sizes = _sizes(self.good, self.bad)(common.text_of(text))
        total = F.lit(self.weights[0])
        for w, f in zip(self.weights[1:], _features(F.octet_length(common.text_of(text)), sizes)):
            total = total + w * f
        return 1 / (1 + F.exp(-total))


def is_held_out(id_col: str | Column) -> Column:
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def _features(n_bytes: Column, sizes: Column) -> list[Column]:
    """The sizes a text has without, with the good and with the bad dictionary."""
    plain, good, bad = sizes[0], sizes[1], sizes[2]
    n = (n_bytes + 1).cast("double")
    gap = (bad - good).cast("double")
    return [10 * gap / n, 5 * gap / F.greatest(good, bad), 3 * plain / n, F.log(n) / 8]


def _sizes(good: bytes, bad: bytes):
    @F.pandas_udf("array<long>")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        coders = [zstandard.ZstdCompressor(level=LEVEL)]
        for content in (good, bad):
            held = zstandard.ZstdCompressionDict(content)
            held.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held))
        for batch in batches:
            yield pd.Series([[len(c.compress(raw)) for c in coders] for raw in (t.encode() for t in batch)])

    return sizes


def train_dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; of few texts, their plain content."""
    import zstandard

    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(size, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(texts)[-size:] or b"\n").rjust(8, b"\n")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    dictionary_rows: int = 3000,
    dictionary_bytes: int = 16 << 10,
    dictionary_size: int = 64 << 10,
    calibration_rows: int = 4000,
) -> Model:
    known = labels.select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")
    ).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out("id"))
    part = F.when(F.floor(F.crc32(F.col("id").cast("string")) / 5) % 2 == 0, "dictionary").otherwise("calibration")
    known = known.withColumn("part", part)
    picked = None
    for name, most in (("dictionary", dictionary_rows), ("calibration", calibration_rows)):
        for label in (0, 1):
            some = (
                known.where((F.col("part") == name) & (F.col("label") == label))
                .orderBy(F.xxhash64("id"), "id")
                .limit(most)
            )
            picked = some if picked is None else picked.union(some)
    # at most 2 (dictionary_rows + calibration_rows) ids go to every task
    chosen = common.materialize(
        docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("body")).join(
            F.broadcast(picked.dropDuplicates(["id"])), "id"
        ),
        "quality-sample",
    )
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(shares) < 2:
        share = float(next(iter(shares))) if shares else 0.5
        bias = float(np.clip(np.log((share + 1e-3) / (1 - share + 1e-3)), -6, 6))
        return Model(b"\n" * 8, b"\n" * 8, (bias, *[0.0] * len(FEATURES)))
    content = {}
    for label in (0, 1):
        rows = (
            chosen.where((F.col("part") == "dictionary") & (F.col("label") == label))
            .select("id", F.substring(F.col("body").cast("binary"), 1, dictionary_bytes).alias("raw"))
            .orderBy("id", "raw")
            .limit(dictionary_rows)
            .collect()
        )
        content[label] = train_dictionary([bytes(r["raw"]) for r in rows], dictionary_size)
    sizes = _sizes(content[1], content[0])(F.col("body"))
    rows = (
        chosen.where(F.col("part") == "calibration")
        .select("id", "label", F.octet_length("body").alias("n"), sizes.alias("sizes"))
        .select("id", "label", *[f.alias(n) for n, f in zip(FEATURES, _features(F.col("n"), F.col("sizes")))])
        .orderBy("id", *FEATURES)
        .limit(2 * calibration_rows)
        .collect()
    )
    if len({r["label"] for r in rows}) < 2:
        return Model(content[1], content[0], (0.0, 1.0, 1.0, *[0.0] * (len(FEATURES) - 2)))
    x = np.array([[r[f] for f in FEATURES] for r in rows], float)
    y = np.array([r["label"] for r in rows], float)
    # the sample may hold more of one class than the labels do; the bias is set right
    w = _logistic(x, y)
    sampled = y.mean() / (1 - y.mean())
    w[0] += np.log(shares[1] / shares[0] / sampled)
    return Model(content[1], content[0], tuple(map(float, w)))


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        is_held_out(id_col).alias("held_out"),
        model.score(text_col).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns kept."""
    (score,) = common.fresh(docs, "score")
    return docs.withColumn(score, model.score(text_col)).where(F.col(score) >= threshold).drop(score)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, common.table(spark, sf_dir, "labels")))
