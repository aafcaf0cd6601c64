"""Exact Jaccard self-join on word n-grams, by grouped prefixes.

1. Every text becomes its set of distinct n-word shingles, as 64-bit hashes.
   Texts of equal sets form a class; one text stands for it from here on.
2. Shingles are put in one global order, rare ones first: tasks count the shingles
   that several texts of a chunk have, and the most frequent of their sums
   (``LISTED`` of them) are listed.  A shingle that is not listed comes before all that
   are, in the order of hashes; listed ones follow by count.  Two sets within the
   bound share a shingle among the first |x| - ceil(t |x|) + 1 of either (the prefix);
   that holds in any order, the counts only keep frequent shingles out of prefixes.
3. Classes of equal size and equal prefix form a group.  Groups meet by prefix
   shingle, and pairs must fulfil the size and position bounds.
4. First every group is compared with one of the least groups that it meets, that which
   it meets most often (and every class with the least of its group); what is linked is
   one component.  Then all pairs
   that still lie in different components are expanded to classes and compared.
   So no link between components is missed, and large groups of near copies are
   not compared pair by pair.
   Pairs are compared in two steps: counts of shingles in 256 parts of the hash range
   bound what two sets can share, and only pairs within the bound send their sets.
5. Components of the links give each text its class.

Texts are sent to a comparison as shingle sets, by hub; a hub with many partners is
split by salts, with its set sent to each.

Defined results: null and empty texts, and texts of blanks, have no shingle and
link with nothing; with fewer than n words the whole sequence is one shingle;
rows that share an id are one document, linked by it; a null id is reported with
the component of its set; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm import common, rolling
from cadenza.llm.components import components

#: length of the list of frequent shingles, texts that make one frequent, shingles counted together
LISTED, FREQUENT, CHUNK = 1 << 19, 4, 1 << 22
HUB = 2000
COARSE = 64
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, letters A to Z lower-cased."""
    out: list[np.ndarray] = []
    for group in _groups(texts):
        out.extend(_shingle_sets(group, n))
    return out


def _groups(texts: list[str], size: int = 1 << 20) -> Iterator[list[bytes]]:
    group, total = [], 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass").lower()
        group.append(raw)
        total += len(raw)
        if total >= size:
            yield group
            group, total = [], 0
    if group:
        yield group


def _shingle_sets(raws: list[bytes], n: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    blank = _BLANK[data]
    start = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    stop = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
    sums = rolling.prefix_hashes(data)
    _, down = rolling.powers(len(data) + 1)
    word = rolling.spread((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raws])
    first = np.searchsorted(start, np.concatenate(([0], ends[:-1])))
    last = np.append(first[1:], len(start))
    grams = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for j in range(n):  # position counts, so a b c is not c b a
        grams = grams * _MIX[0] + word[j : j + len(grams)]
    grams = rolling.spread(grams + np.uint64(n))
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in word[a:b]:
                h = h * _MIX[1] + w
            out.append(rolling.spread(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> int:
    return struct.unpack("<q", hashlib.md5(shingles.tobytes()).digest()[:8])[0]


def frequent(rows: DataFrame, n: int, listed: int = LISTED) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, in ascending order, and the texts counted for each.

    Shingles are counted per chunk of a task, where one that a single text has is
    dropped; what is frequent over all is so in many chunks.  The list has a fixed
    greatest length, whatever the number of texts.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def several() -> pd.DataFrame:
            found = np.concatenate(held)
            held.clear()  # before the arrays below are made
            found.sort()
            first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            times = np.diff(np.append(first, len(found)))
            keep = times > 1
            return pd.DataFrame({"shingle": signed(found[first[keep]]), "texts": times[keep]})

        for batch in batches:
            for s in shingle_sets(batch["body"].tolist(), n):
                if len(s):
                    held.append(s)
                    size += len(s)
                if size >= CHUNK:
                    yield several()
                    size = 0
        if held:
            yield several()

    counts = rows.select("body").mapInPandas(count, "shingle long, texts long").groupBy("shingle").agg(F.sum("texts").alias("texts"))
    top = counts.where(F.col("texts") >= FREQUENT).orderBy(F.desc("texts"), "shingle").limit(listed).toPandas()
    shingles = top["shingle"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(shingles)
    return shingles[by], top["texts"].to_numpy(np.int64)[by]


def rare_first(shingles: np.ndarray, listed: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """The first ``length`` of ascending shingles in the global order."""
    names, texts = listed
    if not len(names):
        return shingles[:length]
    at = np.minimum(np.searchsorted(names, shingles), len(names) - 1)
    known = names[at] == shingles
    rare = shingles[~known]
    if len(rare) >= length:
        return rare[:length]
    more = shingles[known][np.argsort(texts[at[known]], kind="stable")]
    return np.concatenate([rare, more])[:length]


def prefix_length(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _described(rows: DataFrame, n: int, num: int, den: int, listed: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n_shingles, node (hash of the set), prefix (hashes in global order)."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, nodes, prefixes, profiles, parts = [], [], [], [], []
            for s in shingle_sets(batch["body"].tolist(), n):
                sizes.append(len(s))
                nodes.append(set_key(s) if len(s) else None)
                prefixes.append(signed(rare_first(s, listed, prefix_length(len(s), num, den))) if len(s) else None)
                profiles.append(profile(s) if len(s) else None)
                parts.append(coarse_profile(s) if len(s) else None)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"], "n_shingles": sizes, "node": pd.array(nodes, "Int64"),
                    "prefix": prefixes, "profile": profiles, "parts": parts,
                }
            )

    # parts bound what sets share wherever entries meet, profiles once more before sets are sent
    return rows.mapInPandas(describe, "doc_id long, n_shingles long, node long, prefix array<long>, profile binary, parts binary")


def _meetings(entries: DataFrame, num: int, den: int, stars: bool) -> DataFrame:
    """Pairs (a, b) of groups that meet at a prefix shingle and may be linked."""
    return _met(entries, num, den, stars).select("a", "b").distinct()


def _met(entries: DataFrame, num: int, den: int, stars: bool) -> DataFrame:
    """The pairs of :func:`_meetings` with the number of shingles (n) that they met at, in several rows.

    ``entries``: token, gid, size, place, label, parts (a coarse profile).  With ``stars`` only the pair with
    the least group of the bucket that fits; else all pairs of different or unknown
    label.
    """

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_tokens(batches):
            rows["parts"] = _unpacked(rows["parts"], np.uint8)
            rows["size"] = rows["size"].astype(np.int64)  # its products with percents pass 32 bits
            cut = _cuts_of(rows["token"])
            size = np.diff(cut)
            found = []
            two = cut[:-1][size == 2]  # most buckets, all at once
            x, y = ({c: v[two + i] for c, v in rows.items()} for i in (0, 1))
            fits = _may_link(x["size"], x["place"], y["size"], y["place"], num, den)
            fits &= stars | (x["label"] != y["label"]) | (x["label"] == 0)
            fits &= _may_share(x["size"], x["parts"], y["size"], y["parts"], num, den)
            found.append((np.minimum(x["gid"], y["gid"])[fits], np.maximum(x["gid"], y["gid"])[fits]))
            for i in np.flatnonzero(size > 2).tolist():
                bucket = {c: v[cut[i] : cut[i + 1]] for c, v in rows.items()}
                found.extend(_pairs(bucket, num, den, stars))
            pairs, times = np.unique(np.array([np.concatenate(side) for side in zip(*found)]).T, axis=0, return_counts=True)
            for at in range(0, len(pairs), 1 << 16):
                some = pairs[at : at + (1 << 16)]
                yield pd.DataFrame({"a": some[:, 0], "b": some[:, 1], "n": times[at : at + (1 << 16)]})

    dealt = entries.repartition("token").sortWithinPartitions("token", "size", "gid")
    return dealt.mapInPandas(meet, "a long, b long, n long")


def _shared(entries: DataFrame) -> DataFrame:
    """The entries whose token more than one group has."""

    def several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_tokens(batches):
            same = rows["token"][1:] == rows["token"][:-1]
            keep = np.append(same, False) | np.append(False, same)
            yield pd.DataFrame({c: v[keep] for c, v in rows.items()})

    dealt = entries.repartition("token").sortWithinPartitions("token")
    return dealt.mapInPandas(several, entries.schema)


def _apart(entries: DataFrame) -> DataFrame:
    """The entries of the tokens whose groups are not all known to be in one component."""

    def open_ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_tokens(batches):
            cut = _cuts_of(rows["token"])
            begin, size = cut[:-1], np.diff(cut)
            label = rows["label"]
            mixed = np.minimum.reduceat(label, begin) != np.maximum.reduceat(label, begin)
            mixed |= np.logical_or.reduceat(label == 0, begin)
            keep = np.repeat(mixed, size)
            yield pd.DataFrame({c: v[keep] for c, v in rows.items()})

    dealt = entries.repartition("token").sortWithinPartitions("token")
    return dealt.mapInPandas(open_ones, entries.schema)


def _whole_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """Columns of the rows in order, cut only between tokens."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        token = batch["token"].to_numpy()
        if held and held[-1]["token"].iloc[-1] != token[0]:
            yield _columns(held)
            held = []
        cut = int(np.searchsorted(token, token[-1]))  # where the last token begins
        if cut:
            yield _columns([*held, batch.iloc[:cut]])
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield _columns(held)


def _columns(frames: list[pd.DataFrame]) -> dict:
    frame = pd.concat(frames) if len(frames) > 1 else frames[0]
    return {c: frame[c].to_numpy() for c in frame.columns}


def _cuts_of(token: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]))


def _pairs(bucket: dict, num: int, den: int, stars: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    gid, size, place, label, parts = (bucket[c] for c in ("gid", "size", "place", "label", "parts"))
    if stars:
        # the least group of the bucket; those it does not fit get the least of the rest
        rest = np.arange(len(gid))
        while len(rest) > 1:
            hub = rest[np.argmin(gid[rest])]
            fits = _may_link(size[hub], place[hub], size[rest], place[rest], num, den)
            fits &= _may_share(size[hub], parts[hub], size[rest], parts[rest], num, den)
            others = rest[fits & (gid[rest] != gid[hub])]
            if len(others):
                yield np.full(len(others), gid[hub]), gid[others]
            rest = rest[~fits & (gid[rest] != gid[hub])]
        return
    for i in range(len(gid) - 1):
        top = np.searchsorted(size, size[i] * den // num, "right")
        j = np.arange(i + 1, max(i + 1, top))
        j = j[_may_link(size[i], place[i], size[j], place[j], num, den) & (gid[j] != gid[i])]
        j = j[(label[j] != label[i]) | (label[i] == 0)]
        j = j[_may_share(size[i], parts[i], size[j], parts[j], num, den)]
        if len(j):
            yield np.minimum(gid[i], gid[j]), np.maximum(gid[i], gid[j])


def _may_link(size, place, sizes, places, num: int, den: int) -> np.ndarray:
    """Size bound and, at a first common shingle, the bound on what may follow."""
    low, high = np.minimum(size, sizes), np.maximum(size, sizes)
    need = -(-num * (size + sizes) // (num + den))
    return (den * low >= num * high) & (np.minimum(size - place, sizes - places) >= need)


def profile(shingles: np.ndarray) -> bytes:
    """How many shingles lie in each of 256 parts of the hash range; 65535 for more."""
    counts = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=256)
    return np.minimum(counts, 65535).astype(np.uint16).tobytes()


def coarse_profile(shingles: np.ndarray) -> bytes:
    """The same for fewer parts, 255 for more: small enough to travel with every entry."""
    counts = np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=COARSE)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _unpacked(packed, kind) -> np.ndarray:
    """Profiles as rows of counts."""
    counts = np.frombuffer(b"".join(packed), kind)
    return counts.reshape(len(packed), -1) if len(packed) else counts.reshape(0, 1)


def _may_share(size, parts, sizes, others, num: int, den: int) -> np.ndarray:
    """Whether what two sets can share, part by part, reaches the bound.

    The largest value of a profile stands for any number: a part where both have it bounds nothing.
    """
    least = np.minimum(parts, others)
    most = least.sum(axis=-1, dtype=np.int64)
    return (least.max(axis=-1) == np.iinfo(least.dtype).max) | ((num + den) * most >= num * (size + sizes))


def _within_profiles(pairs: DataFrame, profiles: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose profiles allow the bound: sets share at most the smaller count of each part."""

    def allow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (_unpacked(batch[c], np.uint16) for c in ("px", "py"))
            fits = _may_share(batch["nx"].to_numpy(), x, batch["ny"].to_numpy(), y, num, den)
            yield batch.loc[fits, ["a", "b"]]

    # few nodes are in pairs: their profiles alone are shuffled
    nodes = common.materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "jaccard-nodes")
    some = profiles.join(nodes, "node", "left_semi")
    both = pairs.join(some.toDF("a", "nx", "px"), "a").join(some.toDF("b", "ny", "py"), "b")
    return both.mapInPandas(allow, "a long, b long")


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, profiles: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are within the bound."""
    met = common.materialize(pairs, "jaccard-met")
    pairs = common.materialize(_within_profiles(met, profiles, num, den), "jaccard-pairs")
    common.discard(met)
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("salts"))
    hubs = degree.select(
        F.col("a").alias("node"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    members = pairs.join(degree, "a").select(
        F.col("b").alias("node"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")
    )
    wants = common.materialize(
        hubs.union(members).groupBy("node").agg(F.collect_list(F.struct("hub", "salt")).alias("wants")).join(reps, "node"),
        "jaccard-wants",
    )
    texts = docs.join(wants, "doc_id").select("node", "body", "wants")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, total = [], 0
            for node, wants, s in zip(batch["node"], batch["wants"], shingle_sets(batch["body"].tolist(), n)):
                if not len(s) or set_key(s) != node:  # another text of the same id
                    continue
                raw = s.tobytes()
                for w in wants:
                    out.append((w["hub"], w["salt"], int(w["hub"] != node), node, raw))
                    total += len(raw)
                if total > 1 << 22:
                    yield pd.DataFrame(out, columns=["hub", "salt", "member", "node", "shingles"])
                    out, total = [], 0
            yield pd.DataFrame(out, columns=["hub", "salt", "member", "node", "shingles"])

    sent = texts.mapInPandas(send, "hub long, salt int, member int, node long, shingles binary")
    dealt = sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            linked = []
            for r in batch.itertuples(index=False):
                theirs = np.frombuffer(r.shingles, np.uint64)
                if r.member == 0:
                    hub, mine = r.hub, theirs
                elif r.hub == hub:
                    both = len(mine) + len(theirs) - len(np.union1d(mine, theirs))
                    if den * both >= num * (len(mine) + len(theirs) - both):
                        linked.append((hub, r.node))
            yield pd.DataFrame(linked, columns=["u", "v"], dtype=np.int64)

    links = common.materialize(dealt.mapInPandas(compare, "u long, v long").distinct(), "jaccard-links")
    common.discard(pairs, wants)
    return links


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    num, den = percent, 100
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("body"))
    described = common.materialize(_described(rows, n, num, den, frequent(rows, n)), "jaccard-sets")
    some = described.where(F.col("n_shingles") > 0)
    classes = common.materialize(
        some.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("prefix").alias("prefix"), F.first("profile").alias("profile"), F.first("parts").alias("parts")
        ).withColumn("gid", F.xxhash64("size", "prefix")),
        "jaccard-classes",
    )
    found = common.materialize(described.select("doc_id", "n_shingles", "node"), "jaccard-ids")
    common.discard(described)
    profiles = classes.select("node", "size", "profile")
    reps = classes.where(F.col("doc_id").isNotNull()).select("node", "doc_id")
    # most groups are one class; only of the others the head is looked up
    heads_of_many = common.materialize(
        classes.groupBy("gid").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1").select("gid", "first"),
        "jaccard-heads",
    )
    groups = classes.join(heads_of_many, "gid", "left").where(F.col("first").isNull() | (F.col("first") == F.col("node"))).select(
        "gid", F.col("node").alias("head"), "size", "prefix",
        # sets of one group differ: what several may share is left open
        F.when(F.col("first").isNull(), F.col("parts")).otherwise(F.lit(b"\xff" * COARSE)).alias("parts"),
    )
    # most shingles are in one group only and end here
    entries = common.materialize(
        _shared(
            groups.select("gid", "size", F.posexplode("prefix").alias("place", "token")).select(
                "token", "gid", F.col("size").cast("int").alias("size"), "place"
            )
        ),
        "jaccard-entries",
    )
    heads, parts = groups.select("gid", "head"), groups.select("gid", "parts")
    star = _met(entries.join(parts, "gid").withColumn("label", F.lit(0).cast("long")), num, den, True)
    # the hub that a group met most often; the others are looked at below if that one is no link
    star = star.groupBy("a", "b").agg(F.sum("n").alias("n")).groupBy("b").agg(F.max(F.struct("n", "a")).alias("hub")).select(F.col("hub.a").alias("a"), "b")
    star = star.join(heads.toDF("a", "u"), "a").join(heads.toDF("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    inside = classes.join(heads, "gid").where(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = _verified(rows, reps, star.union(inside).distinct(), profiles, n, num, den)
    label = common.materialize(components(links), "jaccard-labels")
    labelled = common.materialize(
        classes.select("gid", "node").join(label, "node", "left").select("gid", "node", F.coalesce("component", "node").alias("label")),
        "jaccard-labelled",
    )
    # a group whose classes differ has no label (0), so its pairs are all looked at
    spread = labelled.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    own = spread.select("gid", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(0)).alias("label"))
    # buckets of one label end here, before profiles are added to their entries
    apart = common.materialize(_apart(entries.join(own, "gid")), "jaccard-apart")
    rest = _meetings(apart.join(parts, "gid"), num, den, False)
    left, right = labelled.toDF("a", "u", "p"), labelled.toDF("b", "v", "q")
    across = rest.join(left, "a").join(right, "b").where(F.col("p") != F.col("q")).select(F.col("u").alias("a"), F.col("v").alias("b"))
    mixed = spread.where(F.col("low") != F.col("high")).select("gid")
    loose = labelled.join(mixed, "gid")
    within = loose.toDF("gid", "a", "p").join(loose.toDF("gid", "b", "q"), "gid").where(
        (F.col("a") < F.col("b")) & (F.col("p") != F.col("q"))
    ).select("a", "b")
    pairs = across.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _verified(rows, reps, pairs, profiles, n, num, den)
    return _with_components(found, classes, links.union(more))


def _with_components(found: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    # rows that share an id are one document: their sets hang together
    several = found.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("node").alias("u"), F.max("node").alias("v")
    )
    shared = several.where(F.col("u") != F.col("v")).select("doc_id", "u")
    same_id = found.join(shared, "doc_id").select("u", F.col("node").alias("v")).where(F.col("u") != F.col("v"))
    parts = components(links.union(same_id))
    of_class = classes.select("node", "doc_id").join(parts, "node", "left").select(
        "node", "doc_id", F.coalesce("component", "node").alias("part")
    )
    least = of_class.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    table = common.materialize(of_class.join(least, "part").select("node", "component_id"), "jaccard-components")
    named = found.select("doc_id", "n_shingles", "node").join(table, "node", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of the smallest id of each component, all columns kept.

    An id is one document: where rows repeat it, the first with a word stays, in the order of the texts'
    hashes.  Rows with a null id are no document of a group; of those with equal sets one stays, and all
    without a word.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, n=n, percent=percent)
    id_, key, place = common.fresh(docs, "kept_id", "kept_key", "kept_place")
    body = common.text_of(text_col)
    number = docs[id_col].cast("long")
    # a row without a word has no set, so an id's component is the least of its rows'
    least = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("component_id").alias("least"))
    keep = least.where(F.col("doc_id") == F.col("least")).select(F.col("doc_id").alias(id_))
    # numbered before the join: each task sends one row a key, however often it is repeated
    wordless = ~body.rlike(r"[^\x20\x09-\x0D]")
    named = docs.where(number.isNotNull()).withColumn(key, number)
    named = _first_of(named, key, place, wordless, F.xxhash64(body), body)
    named = named.join(keep, F.col(key) == F.col(id_), "left_semi").drop(key)

    @F.pandas_udf("long")
    def node(texts: pd.Series) -> pd.Series:
        return pd.Series([set_key(s) for s in shingle_sets(texts.tolist(), n)], dtype="int64")

    loose = docs.where(number.isNull())
    sets = _first_of(loose.where(~wordless).withColumn(key, node(body)), key, place, F.xxhash64(body), body).drop(key)
    return named.unionByName(sets).unionByName(loose.where(wordless))


def _first_of(rows: DataFrame, key: str, place: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    ranked = rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col(place) == 1).drop(place)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), n=3, percent=90)
