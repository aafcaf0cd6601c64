"""Nearest neighbours by inner product, in vantage-point trees.

The largest inner product becomes a smallest distance: with M the greatest norm of
all vectors, a vector x gets one more coordinate, sqrt(M^2 - |x|^2), and a query q a
zero there.  Then |q - x|^2 = M^2 + |q|^2 - 2 q.x, so the Euclidean triangle
inequality may prune.

* Equal vectors are one point with its smallest ids, as many as an answer can name;
  a vector that a third of all rows have is a single point.
* A router, a vantage-point tree fitted on a bounded sample, divides the points into
  shards by region; a region with more than ``SHARD`` points is divided again by
  hash.  Every shard has a vantage-point tree of all its points.
* Each query is searched in the shard of its own region first.  Its k-th score then
  decides which other regions it must visit: a subtree is left out if ``factor``
  times the least distance that the triangle inequality allows is beyond the k-th
  distance.  Factor one is exact search; greater factors leave out more.
* Inside a shard, queries go through the tree in blocks, with one product of
  matrices per node or leaf.  Scores are computed again from the original
  components, one pair at a time in one order, so equal vectors have equal scores.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part, neither as queries nor as candidates; vectors of different lengths are
never compared.  A query is a row; all other rows are its candidates, those of the
same id too.  Ties go to the smaller id, a null id last; a null id is never a
query's.  With fewer candidates than ``k`` all are returned, without any the query
has no row; an empty table gives an empty result; other columns are ignored.
Components are read as doubles; squares of norms must be finite doubles.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import common

#: points of a shard and of a leaf of its tree; sampled points of a region of the router, and of all
SHARD, LEAF, SAMPLE_PER_REGION, SAMPLE = 4096, 128, 16, 16_384
#: queries that meet a shard in one task; beyond that the shard is sent to several tasks
SLICE = 65_536
#: queries of one block
BLOCK = 512
NO_ID = np.iinfo(np.int64).max


@dataclass
class Tree:
    """A vantage-point tree over points in tree order; leaves hold ranges of them.

    Node ``i`` has vantage point ``vantage[i]``, the radius that divides it, two
    children (a leaf's number is -1 - child) and the distances they can have.
    """

    points: np.ndarray
    order: np.ndarray
    vantage: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaves: np.ndarray
    root: int

    @staticmethod
    def build(points: np.ndarray, most: float, leaf: int, open_ended: bool = False) -> Tree:
        """``open_ended``: children stand for all of their side, not for these points alone."""
        lifted = np.column_stack([points, np.sqrt(np.maximum(0, most**2 - (points**2).sum(1)))])
        order, vantage, radius, child, low, high, leaves = [], [], [], [], [], [], []

        def leaf_of(rows: np.ndarray) -> int:
            begin = sum(map(len, order))
            order.append(rows)
            leaves.append((begin, begin + len(rows)))
            return -len(leaves)

        todo = [(np.arange(len(points)), None)]
        root = 0
        while todo:
            rows, place = todo.pop()
            number = None
            if len(rows) > leaf:
                # of a few points that with the widest distances parts best
                tried = rows[np.linspace(0, len(rows) - 1, 8).astype(int)]
                d = _distances(lifted[rows], lifted[tried])
                best = int(d.std(axis=0).argmax())
                d = d[:, best]
                r = float(np.median(d))
                inside = d <= r
                if 0 < inside.sum() < len(rows):
                    number = len(radius)
                    vantage.append(points[tried[best]])
                    radius.append(r)
                    child.append([0, 0])
                    sides = (d[inside], d[~inside])
                    low.append([0.0, r] if open_ended else [x.min() for x in sides])
                    high.append([r, np.inf] if open_ended else [x.max() for x in sides])
                    todo += [(rows[inside], (number, 0)), (rows[~inside], (number, 1))]
            if number is None:
                number = leaf_of(rows)
            if place is None:
                root = number
            else:
                child[place[0]][place[1]] = number
        width = points.shape[1]
        at = np.concatenate(order) if order else np.zeros(0, np.int64)
        return Tree(
            points[at], at, np.array(vantage).reshape(-1, width), np.array(radius),
            np.array(child, np.int64).reshape(-1, 2), np.array(low).reshape(-1, 2), np.array(high).reshape(-1, 2),
            np.array(leaves, np.int64).reshape(-1, 2), root,
        )

    def route(self, points: np.ndarray, squared: np.ndarray, most: float, lift: bool) -> np.ndarray:
        """The leaf number on whose side each point lies (``lift``: a stored point, no query)."""
        at = np.full(len(points), self.root)
        extra = np.sqrt(np.maximum(0, most**2 - squared)) if lift else np.zeros(len(points))
        for i in range(len(self.radius)):
            rows = np.flatnonzero(at == i)
            if len(rows):
                v = self.vantage[i]
                up = math.sqrt(max(0.0, most**2 - float((v**2).sum())))
                d = ((points[rows] - v) ** 2).sum(1) + (extra[rows] - up) ** 2
                at[rows] = self.child[i][(np.sqrt(d) > self.radius[i]).astype(int)]
        return -1 - at


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(0, square))


class Search:
    """A block of queries and the best points that each has met so far."""

    def __init__(self, queries: np.ndarray, k: int, most: float, factor: float, known: np.ndarray | None = None):
        """``known``: a score of each query that at least ``k`` points are known to reach."""
        self.queries, self.k, self.most, self.factor = queries, k, most, factor
        self.squared = (queries**2).sum(1)
        n = len(queries)
        self.score = np.full((n, k), -np.inf) if known is None else np.repeat(known[:, None], k, 1)
        self.least = np.full((n, k), NO_ID)
        self.point = np.full((n, k), -1)
        self.slack = 1e-6 * (most + np.sqrt(self.squared))
        self.noise = 1e-12 * most * np.sqrt(self.squared)
        #: candidates not yet merged, and pairs of query and point that were compared
        self.waiting, self.held, self.compared = [], 0, 0

    def reach(self, rows: np.ndarray) -> np.ndarray:
        """Distance of the k-th point; infinite as long as there are fewer."""
        score = self.score[rows, -1]
        return np.sqrt(np.maximum(0, self.most**2 + self.squared[rows] - 2 * score)) + self.slack[rows]

    def sides(self, tree: Tree, i: int, rows: np.ndarray) -> list[np.ndarray]:
        """Of these queries those that must visit either child of node ``i``."""
        inner = self.queries[rows] @ tree.vantage[i]
        d = np.sqrt(np.maximum(0, self.most**2 + self.squared[rows] - 2 * inner))
        reach = self.reach(rows)
        return [
            rows[self.factor * np.maximum(d - tree.high[i, s], tree.low[i, s] - d) <= reach] for s in (0, 1)
        ]

    def visit(self, tree: Tree, least: np.ndarray, point: np.ndarray) -> None:
        """Search a tree whose points have these smallest ids and names."""
        everyone = np.arange(len(self.queries))
        own = tree.route(self.queries, self.squared, self.most, lift=False)
        for leaf in np.unique(own):
            self.open(tree, leaf, everyone[own == leaf], least, point)
        self.settle()
        todo = [(tree.root, everyone)]
        while todo:
            node, rows = todo.pop()
            if node >= 0:
                todo += [(int(c), r) for c, r in zip(tree.child[node], self.sides(tree, node, rows)) if len(r)]
                continue
            rows = rows[own[rows] != -1 - node]
            if len(rows):
                self.open(tree, -1 - node, rows, least, point)
        self.settle()

    def open(self, tree: Tree, leaf: int, rows: np.ndarray, least: np.ndarray, point: np.ndarray) -> None:
        begin, end = tree.leaves[leaf]
        points, k = tree.points[begin:end], self.k
        self.compared += len(rows) * len(points)
        rough = self.queries[rows] @ points.T
        floor = self.score[rows, -1] - self.noise[rows]
        if len(points) > k and not np.isfinite(floor).all():
            floor = np.maximum(floor, np.partition(rough, -k, axis=1)[:, -k] - self.noise[rows])
        r, c = np.nonzero(rough >= floor[:, None])
        if len(r):
            exact = (self.queries[rows[r]] * points[c]).sum(1)
            self.waiting.append((rows[r], exact, least[begin + c], point[begin + c]))
            self.held += len(r)
            if self.held >= 8 * len(self.queries):
                self.settle()

    def settle(self) -> None:
        """Merge the waiting candidates into the best ones."""
        if not self.waiting:
            return
        k = self.k
        r, exact, ids, names = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.held = [], 0
        old = np.unique(r)
        row = np.concatenate([np.repeat(old, k), r])
        score = np.concatenate([self.score[old].ravel(), exact])
        ids = np.concatenate([self.least[old].ravel(), ids])
        names = np.concatenate([self.point[old].ravel(), names])
        by = np.lexsort([names, ids, -score, row])
        first = np.searchsorted(row[by], old)
        kept = by[(first[:, None] + np.arange(k)).ravel()]
        self.score[old] = score[kept].reshape(-1, k)
        self.least[old] = ids[kept].reshape(-1, k)
        self.point[old] = names[kept].reshape(-1, k)


# --- on Spark ------------------------------------------------------------------

def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_points(rows: DataFrame, k: int) -> DataFrame:
    """``point, v, ids, asked`` per distinct vector of rows with ``id, v, asked``.

    ``ids`` are its ``k + 1`` smallest, a null id last; an answer never names more.
    The limit acts before the shuffle, so that a frequent vector costs no more.
    """
    least = Window.partitionBy("v", "asked").orderBy(F.col("id").asc_nulls_last())
    few = rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    entry = F.struct(F.col("id").isNull().alias("none"), "id")
    found = few.groupBy("v").agg(
        F.slice(F.sort_array(F.collect_list(entry)), 1, k + 1).alias("ids"), F.max("asked").alias("asked")
    )
    return common.materialize(found.withColumn("point", F.monotonically_increasing_id()), "points")


@dataclass
class Router:
    """Regions of the vectors of one length, and the shards of each region."""

    tree: Tree
    most: float
    first: np.ndarray | None = None
    shards: np.ndarray | None = None

    def home(self, points: np.ndarray, names: np.ndarray, lift: bool) -> np.ndarray:
        """A shard of each point's own region."""
        leaf = self.tree.route(points, (points**2).sum(1), self.most, lift)
        return leaf if self.first is None else self.first[leaf] + _scattered(names) % self.shards[leaf]


def _scattered(names: np.ndarray) -> np.ndarray:
    mixed = names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(33)).astype(np.int64)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(sizes):
        yield int(width), np.flatnonzero(sizes == width)


def _routed(points: DataFrame, routers: dict[int, Router]) -> DataFrame:
    """``width, shard`` in front of the columns of ``points``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("shard", T.LongType()), *points.schema])
    schema = to_arrow_schema(spark_schema)
    at_v, at_name = points.columns.index("v"), points.columns.index("point")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, rows in _by_length(batch.column(at_v)):
                some = batch.take(pa.array(rows))
                names = some.column(at_name).to_numpy(zero_copy_only=False)
                shard = routers[width].home(_matrix(some.column(at_v)), names, lift=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), width, np.int32)), pa.array(shard), *some.columns], schema=schema
                )

    return points.mapInArrow(run, spark_schema)


def fit_routers(points: DataFrame, shard: int = SHARD) -> dict[int, Router]:
    """Regions from a sample of at most ``SAMPLE`` vectors, by hash; counts of all points."""
    sizes = points.groupBy(F.size("v").alias("width")).agg(
        F.count("*").alias("n"),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square"),
    )
    about = {r["width"]: (r["n"], math.sqrt(r["square"]) * (1 + 1e-12)) for r in sizes.collect()}
    regions = {w: min(SAMPLE // SAMPLE_PER_REGION, -(-n // shard)) for w, (n, _) in about.items()}
    wanted = min(SAMPLE, SAMPLE_PER_REGION * sum(regions.values()))
    sample: dict[int, list] = {w: [] for w in about}
    for r in points.select("v").orderBy(F.xxhash64("v"), "v").limit(wanted).collect():
        sample[len(r["v"])].append(r["v"])
    routers = {}
    for w, (_, most) in about.items():
        drawn = np.array(sample[w], float).reshape(-1, w)
        leaf = max(1, -(-len(drawn) // regions[w]))
        routers[w] = Router(Tree.build(drawn, most, leaf, open_ended=True), most)
    counts = {(r["width"], r["shard"]): r["count"] for r in _routed(points, routers).groupBy("width", "shard").count().collect()}
    made = 0
    for w, router in routers.items():
        held = [counts.get((w, leaf), 0) for leaf in range(len(router.tree.leaves))]
        router.shards = np.array([max(1, -(-n // shard)) for n in held])
        router.first = made + np.cumsum(router.shards) - router.shards
        made += int(router.shards.sum())
        # regions stand for whole sides; the sampled points are not needed any more
        router.tree.points = router.tree.order = np.zeros((0, w))
    return routers


def build_index(points: DataFrame, routers: dict[int, Router], leaf: int = LEAF) -> DataFrame:
    """``shard, tree``: the packed tree of each shard, written to the shared folder."""
    most = {w: r.most for w, r in routers.items()}
    schema = pa.schema([("shard", pa.int64()), ("tree", pa.binary())])

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        points = _matrix(rows.column("v").chunk(0))
        tree = Tree.build(points, most[points.shape[1]], leaf)
        least = rows.column("least").to_numpy()[tree.order]
        names = rows.column("point").to_numpy()[tree.order]
        tree.order = tree.order[:0]
        packed = pickle.dumps((tree, least, names), protocol=pickle.HIGHEST_PROTOCOL)
        return pa.table({"shard": rows.column("shard").slice(0, 1), "tree": [packed]}, schema=schema)

    least = F.coalesce(F.col("ids")[0]["id"].cast("long"), F.lit(NO_ID))
    rows = _routed(points.select("point", "v", least.alias("least")), routers)
    index = rows.groupBy("shard").applyInArrow(build, "shard long, tree binary")
    return common.materialize(index, "vantage-points", common.LARGE_ROWS)


_FOUND = "query long, v array<double>, home long, scores array<double>, leasts array<long>, points array<long>"


def _searched(index: DataFrame, visits: DataFrame, most: dict[int, float], k: int, factor: float, slices: int) -> DataFrame:
    """What each visit (``shard, query, v, known``) finds; a task holds one tree and one block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    parts = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    trees = index.select("shard", parts.alias("slice"), F.lit(0).alias("turn"), "tree")
    asked = visits.withColumn("slice", F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int")).withColumn("turn", F.lit(1))
    both = trees.unionByName(asked, allowMissingColumns=True)
    columns = ["shard", "turn", "tree", "query", "v", "known"]
    schema = to_arrow_schema(T.StructType.fromDDL(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, None
        for batch in batches:
            turn = batch.column("turn").to_numpy(zero_copy_only=False)
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, (turn[1:] != turn[:-1]) | (shards[1:] != shards[:-1])))
            for x, y in zip(first, np.append(first[1:], len(turn))):
                if not turn[x]:
                    held, shard = pickle.loads(batch.column("tree")[int(x)].as_py()), shards[x]
                    continue
                for at in range(x, y, BLOCK):
                    rows = batch.slice(at, min(y, at + BLOCK) - at)
                    yield answer(rows, *held, int(shard))

    def answer(rows: pa.RecordBatch, tree: Tree, least: np.ndarray, names: np.ndarray, shard: int) -> pa.RecordBatch:
        queries = _matrix(rows.column("v"))
        known = rows.column("known").to_numpy(zero_copy_only=False)
        search = Search(queries, k, most[queries.shape[1]], factor, known)
        search.visit(tree, least, names)
        size = (search.point >= 0).sum(1)
        # found points come first: placeholders of a known score lose every tie
        offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
        mask = search.point >= 0
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[mask])) for x in (search.score, search.least, search.point)]
        return pa.RecordBatch.from_arrays(
            [rows.column("query"), rows.column("v"), pa.array(np.full(rows.num_rows, shard)), *lists], schema=schema
        )

    met = both.repartition("shard", "slice").sortWithinPartitions("shard", "slice", "turn")
    return met.select(*columns).mapInArrow(run, _FOUND)


def _further_visits(found: DataFrame, routers: dict[int, Router], k: int, factor: float) -> DataFrame:
    """The shards besides its first that each query cannot leave out."""
    spark_schema = "shard long, query long, v array<double>, known double"
    schema = pa.schema([("shard", pa.int64()), ("query", pa.int64()), ("v", pa.list_(pa.float64())), ("known", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, rows in _by_length(batch.column("v")):
                router, some = routers[width], batch.take(pa.array(rows))
                queries = _matrix(some.column("v"))
                sizes = some.column("scores").value_lengths().to_numpy(zero_copy_only=False)
                known = np.array([s[-1] if n == k else -np.inf for s, n in zip(some.column("scores").to_pylist(), sizes)])
                search = Search(queries, k, router.most, factor, known)
                home = some.column("home").to_numpy(zero_copy_only=False)
                todo = [(router.tree.root, np.arange(len(rows)))]
                while todo:
                    node, who = todo.pop()
                    if node >= 0:
                        sides = search.sides(router.tree, node, who)
                        todo += [(int(c), r) for c, r in zip(router.tree.child[node], sides) if len(r)]
                        continue
                    first, more = int(router.first[-1 - node]), int(router.shards[-1 - node])
                    for shard in range(first, first + more):
                        left = who[home[who] != shard]
                        for at in range(0, len(left), 4096):
                            part = pa.array(left[at : at + 4096])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(part), shard)), some.column("query").take(part), some.column("v").take(part),
                                 pa.array(known[left[at : at + 4096]])],
                                schema=schema,
                            )

    return found.mapInArrow(run, spark_schema)


def nearest(
    rows: DataFrame, asked: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
    factor: float = 1.0, shard: int = SHARD,
) -> DataFrame:
    """``query_id, rank, <id>, score`` of the ``k`` nearest rows of each row that is ``asked``.

    ``asked`` is a condition on the columns of ``rows``; ids are whole numbers.
    """
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    usable_rows = rows.select(
        F.col(id_col).alias("id"), vector.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")
    ).where(usable(F.col("v")))
    points = distinct_points(usable_rows, k)
    routers = fit_routers(points, shard)
    index = build_index(points, routers)
    most = {w: r.most for w, r in routers.items()}
    # an answer may have to leave its own row out
    kept = k + 1
    queries = points.where("asked").select("point", "v")
    asked_count = queries.count()
    start = _routed(queries, routers).select(
        "shard", F.col("point").alias("query"), "v", F.lit(float("-inf")).alias("known")
    )
    found = common.materialize(_searched(index, start, most, kept, factor, 1), "neighbours")
    visits = _further_visits(found, routers, kept, factor)
    further = _searched(index, visits, most, kept, factor, max(1, -(-asked_count // SLICE)))
    entries = found.unionByName(further).select(
        "query", F.explode(F.arrays_zip("scores", "leasts", "points")).alias("e")
    ).select("query", F.col("e.scores").alias("score"), F.col("e.leasts").alias("least"), F.col("e.points").alias("point"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least", "point")
    top = entries.withColumn("n", F.row_number().over(best)).where(F.col("n") <= kept)
    ids = points.select("point", "ids")
    named = top.join(ids, "point").withColumn(
        "named",
        F.transform("ids", lambda i: F.struct((-F.col("score")).alias("away"), i["none"].alias("none"), i["id"].alias("id"), F.col("point").alias("point"))),
    )
    # at most (k + 1)^2 entries a query
    answers = named.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("named"))), 1, kept).alias("all"))
    own = usable_rows.where("asked").join(points.where("asked").select("v", F.col("point").alias("query")), "v").select("id", "query")
    itself = F.array_position(F.transform("all", lambda e: e["id"].eqNullSafe(F.col("id")) & (e["point"] == F.col("query"))), True)
    others = F.slice(F.filter("all", lambda e, i: i + 1 != F.col("itself")), 1, k)
    return (
        own.join(answers, "query").withColumn("itself", itself)
        .select(F.col("id").alias("query_id"), F.posexplode(others).alias("n", "e"))
        .select("query_id", (F.col("n") + 1).alias("rank"), F.col("e.id").alias(id_col), (-F.col("e.away")).alias("score"))
    )


#: measured on the given tables: see the README
FACTOR = 1.0


def op13_nearest_vectors(spark, sf_dir: str) -> DataFrame:
    """Queries: rows whose ``vec_id`` is divisible by 20."""
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, factor=FACTOR)


OP13_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS place, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.place <> c.place AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS n FROM scored
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 20
"""
