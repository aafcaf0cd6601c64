"""Mixing sources to target weights by Sainte-Lague apportionment.

The corpus is cut into blocks of about ``block_words`` words.  Sources win blocks
by highest quotients target / (2 k + 1); the blocks of a source are apportioned
to its shards in the same way; each shard then selects its quota of blocks, in a
seeded order of its documents.  A quota above the number of blocks repeats all
of them, at most ``max_repeats`` times.

Only (id, source, size) leave the scan.  A shard holds about ``shard_words``
words, so a source with a third of all rows is spread over as many tasks as its
size needs.  Known to the driver is one row per source: a mixture is stated by
source, so that table has the size of a configuration.

Defined results: a null or empty text has size 0 and takes 0; a null source is a
source of its own, last in order; a null id is a document like any other; equal
rows are separate documents; an empty table gives an empty result; other columns
are ignored whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cadenza.llm import common


def sainte_lague(votes: Sequence[int | Fraction], seats: int) -> list[int]:
    """Seats by highest quotients vote / (2 k + 1); ties go to the earlier party.

    A bisected divisor gives all seats but the last few, so the work does not
    grow with their number.
    """
    if seats <= 0 or not any(v > 0 for v in votes):
        return [0] * len(votes)

    def at(divisor: Fraction) -> list[int]:
        return [int(Fraction(v) / divisor + Fraction(1, 2)) for v in votes]

    low = high = Fraction(sum(votes)) / seats
    while sum(at(high)) > seats:
        high *= 2
    for _ in range(64):
        if seats - sum(at(high)) <= 2 * len(votes):
            break
        middle = (low + high) / 2
        low, high = (middle, high) if sum(at(middle)) > seats else (low, middle)
    won = at(high)
    heap = [(-Fraction(v) / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, won)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(won)):
        _, i = heapq.heappop(heap)
        won[i] += 1
        heapq.heappush(heap, (-Fraction(votes[i]) / (2 * won[i] + 1), i))
    return won


def targets(sizes: Sequence[int], weights: Sequence[int], most: int) -> list[Fraction]:
    """Shares of the total by weight, none above ``most`` times its own size.

    What a capped source leaves is shared by the others by weight, until no
    share is above its cap.
    """
    out = [Fraction(0)] * len(sizes)
    left, open_ = Fraction(sum(sizes)), list(range(len(sizes)))
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    max_repeats: int = 3,
    block_words: int = 64,
    shard_words: int = 1 << 20,
    seed: int = 17,
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, taken."""
    spark = docs.sparkSession
    sized = common.materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            common.word_count(text_col).alias("size"),
        ),
        "mix-sizes",
    )
    known = [
        (r["source"], int(r["words"]))
        for r in sized.groupBy("source").agg(F.sum("size").alias("words")).collect()
    ]
    known.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [words for _, words in known]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(known))], max_repeats)
    quotas = sainte_lague(aims, round(sum(sizes) / block_words))
    if sum(sizes) and sum(quotas) == 0:  # less than a block in all
        quotas = [int(a > 0) for a in aims]
    plan = spark.createDataFrame(
        [
            (name, i, words, float(aims[i]), quotas[i], max(1, -(-words // shard_words)))
            for i, (name, words) in enumerate(known)
        ],
        T.StructType(
            [
                T.StructField("_source", T.StringType()),
                T.StructField("source_no", T.IntegerType()),
                T.StructField("source_size", T.LongType()),
                T.StructField("target", T.DoubleType()),
                T.StructField("source_quota", T.LongType()),
                T.StructField("n_shards", T.LongType()),
            ]
        ),
    )
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    placed = placed.withColumn(
        "order_key", F.xxhash64(F.lit(seed), F.col("doc_id"))
    ).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("size")), F.col("n_shards"))
    )
    blocks = F.greatest(F.lit(1), F.round(F.col("words") / block_words)).cast("long")
    shards = (
        placed.groupBy("source_no", "shard", "source_quota", "source_size")
        .agg(F.sum("size").alias("words"))
        .withColumn("blocks", blocks)
    )
    shards = _apportion(shards, max_repeats).select("source_no", "shard", "words", "blocks", "quota")
    inside = Window.partitionBy("source_no", "shard").orderBy("order_key", "doc_id", "size")
    rows = placed.withColumn(
        "end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ).join(shards, ["source_no", "shard"], "left")
    return rows.select(
        "doc_id", "size", "source", "source_size", "target", _taken(seed).alias("taken")
    )


def _apportion(shards: DataFrame, most: int) -> DataFrame:
    """Sainte-Lague quotas of the shards of each source.

    A shard's seats lie within two of its exact share, so only the three seats
    from one below it compete; the rest is settled without ranking.
    """
    base = F.greatest(
        F.lit(0), F.floor(F.col("source_quota") * F.col("words") / F.col("source_size")) - 1
    ).cast("long")
    shards = shards.withColumn("base", F.coalesce(base, F.lit(0)))
    left = F.col("source_quota") - F.sum("base").over(Window.partitionBy("source_no"))
    seats = shards.withColumn("left", left).withColumn(
        "seat", F.explode(F.sequence(F.lit(0), F.lit(2)))
    )
    by_quotient = Window.partitionBy("source_no").orderBy(
        (F.col("words") / (2 * (F.col("base") + F.col("seat")) + 1)).desc(), "shard", "seat"
    )
    won = seats.withColumn("rank", F.row_number().over(by_quotient)).groupBy(
        "source_no", "shard", "words", "blocks", "base"
    ).agg(F.sum((F.col("rank") <= F.col("left")).cast("long")).alias("more"))
    return won.withColumn("quota", F.least(F.col("base") + F.col("more"), F.col("blocks") * most))


def _taken(seed: int):
    """Words of a document that lie in selected blocks, with repeats.

    Block j of a shard is the words [j W / n, (j + 1) W / n) of its documents in
    seeded order.  A quota of q = a n + r takes every block a times and r of them
    once more, spread evenly from a seeded start.
    """
    n, w, q = F.col("blocks"), F.col("words"), F.col("quota")
    start, end = F.col("end") - F.col("size"), F.col("end")
    rest = F.pmod(q, n)
    turn = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("source_no"), F.col("shard")), n)

    def div(a, b):
        return F.floor((a - F.pmod(a, b)) / b).cast("long")

    def more(total, j):
        begin, stop = div(j * w, n), div((j + 1) * w, n)
        words = F.greatest(F.lit(0), F.least(end, stop) - F.greatest(start, begin))
        chosen = div((j + 1 + turn) * rest, n) > div((j + turn) * rest, n)
        return total + F.when(chosen, words).otherwise(0)

    span = F.sequence(div(start * n, w), F.least(n - 1, div(end * n, w)))
    extra = F.aggregate(span, F.lit(0).cast("long"), more)
    whole = div(q, n) * F.col("size")
    return F.when(F.col("size") > 0, whole + F.when(rest > 0, extra).otherwise(0)).otherwise(0).cast("long")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )
