"""Operator 12: approximate nearest neighbours by inner product with a forest of random-projection trees.

Vectors get one more component that makes all of one length, so that the nearest by angle has the largest inner product. A node of a tree splits
the vectors of its place at the median of their projections on a random direction, of ``TRIES`` the one that spreads them most. Trees are fitted to a
sample of ``SAMPLE`` vectors, those with the smallest hashes; every vector is then filed in one leaf of each tree. A query takes leaves from one
priority queue that all trees share, those first that lie the least far beyond the splits on the way to them, and every vector of a leaf taken is
compared exactly. How many leaves that are is fitted too: so many that ``CHECKED`` queries of the sample find ``TARGET`` of their true neighbours there;
among more vectors neighbours are nearer, and recall is higher.

Bounds: the sample, and with it the trees, are broadcast; ``SAMPLE`` and ``LEAF`` bound them. Vectors that are equal are filed once, with the
``k + 1`` smallest of their ids: no more can be among the nearest. A leaf with many vectors is cut into slices of about ``SLICE``, and a task holds one
slice and streams the queries that take it. A query passes on only what reaches its k-th score among the sample's vectors in its leaves.

Scores are inner products of the vectors as they are given, in double precision, summed from the first component to the last. Vectors that are
null, empty, all zero, or hold a null or non-finite component take no part. Only vectors of the same length are compared, and those of a length that the
sample has too few of to split are all compared. Ties go to the smaller id. A row with the query's id and vector is its own and no candidate; such rows
that are repeated count once, and rows with its id and another vector are candidates. With fewer than k candidates there are fewer ranks; empty tables
give no rows. Null ids take no part. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_length, join_unique, matrix, own, scratch, table, task, written

K, EVERY = 20, 20
#: Trees; vectors of the sample that a leaf has at most; vectors they are fitted to; directions tried for each split.
TREES, LEAF, SAMPLE, TRIES = 4, 64, 16_384, 12
#: The share of true neighbours that the number of leaves is fitted for, and the queries of the sample that it is fitted by.
TARGET, CHECKED = 0.96, 256
#: Vectors that a task holds at a time, about.
SLICE = 8_192


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part, each once."""
    big = F.lit(float("inf"))
    x = own(df, key, vector).where(F.col(f"`{key}`").isNotNull() & F.col(f"`{vector}`").isNotNull()).select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    x = x.where(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < big), F.lit(False))) & F.exists("v", lambda c: c != 0))
    return x.distinct()


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from first to last: the same for the same vectors, wherever they stand."""
    return np.cumsum(x * q, axis=1)[:, -1]


class Forest:
    """Trees over vectors of one length; ``visits`` leaves are taken for each query. Without a split there is one tree of one leaf."""

    def __init__(self, sample: np.ndarray, norm: float, k: int = K, trees: int = TREES, leaf: int = LEAF, target: float = TARGET, seed: int = 0):
        self.norm, self.k, self.sample = norm, k, sample
        rng = np.random.default_rng([seed, sample.shape[1]])
        x = self.lengthened(sample)
        self.children, self.leaves, self.roots = [], 0, []  # of a node: (left, right), or its leaf as (-1, leaf)
        self.directions, self.edges = [], []
        for _ in range(trees if len(sample) > leaf else 1):
            self.roots.append(self._grow(x, np.arange(len(x)), leaf, rng))
        self.directions, self.edges = np.array(self.directions).reshape(len(self.edges), x.shape[1]), np.array(self.edges)
        self.where = self.filed(sample)  # the sample's own leaves
        self.tree = [t for t, row in enumerate(self.where) for _ in np.unique(row)]  # leaves are numbered tree by tree
        self.size = np.bincount(self.where.ravel(), minlength=self.leaves).tolist()
        self.visits = self.leaves
        if len(self.roots) > 1:
            self.visits = self._fitted(target, rng)

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        """Vectors of length 1, with the component that the longest vector has not."""
        x = x / self.norm
        return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))[:, None]])

    def _grow(self, x: np.ndarray, at: np.ndarray, leaf: int, rng) -> int:
        node = len(self.children)
        self.children.append(None)
        self.directions.append(np.zeros(x.shape[1]))
        self.edges.append(0.0)
        if len(at) > leaf:
            tried = rng.normal(size=(TRIES, x.shape[1]))
            tried /= np.linalg.norm(tried, axis=1)[:, None]
            far = x[at] @ tried.T
            best = far.var(0).argmax()
            edge = np.median(far[:, best])
            left = far[:, best] < edge
            if left.any():
                self.directions[node], self.edges[node] = tried[best], edge
                self.children[node] = (self._grow(x, at[left], leaf, rng), self._grow(x, at[~left], leaf, rng))
                return node
        self.children[node] = (-1, self.leaves)
        self.leaves += 1
        return node

    def filed(self, x: np.ndarray) -> np.ndarray:
        """A row of each tree's leaf for each vector."""
        x = self.lengthened(x)
        out = np.empty((len(self.roots), len(x)), np.int64)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(x)))]
            while todo:
                node, at = todo.pop()
                left, right = self.children[node]
                if left < 0:
                    out[t, at] = right
                elif len(at):
                    low = x[at] @ self.directions[node] < self.edges[node]
                    todo += [(left, at[low]), (right, at[~low])]
        return out

    def taken(self, q: np.ndarray, visits: int | None = None) -> list[list[int]]:
        """For each query the leaves it takes, in order, from the queue that all trees share: more than ``visits`` only where these hold too few vectors of the sample."""
        q = np.hstack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))])
        visits = self.visits if visits is None else visits
        out = []
        for beyond in q @ self.directions.T - self.edges:
            queue, leaves, held, beyond = [(0.0, root) for root in self.roots], [], [0] * len(self.roots), beyond.tolist()
            while queue and (len(leaves) < visits or max(held) <= self.k):
                far, node = heapq.heappop(queue)
                left, right = self.children[node]
                if left < 0:
                    leaves.append(right)
                    held[self.tree[right]] += self.size[right]
                    continue
                m = beyond[node]
                heapq.heappush(queue, (far + m * m if m > 0 else far, left))
                heapq.heappush(queue, (far + m * m if m < 0 else far, right))
            out.append(leaves)
        return out

    def _fitted(self, target: float, rng) -> int:
        """Leaves to take, so that ``target`` of the true neighbours of some vectors of the sample are in them."""
        some = np.sort(rng.permutation(len(self.sample))[:CHECKED])
        score = self.sample[some] @ self.sample.T
        score[np.arange(len(some)), some] = -np.inf
        k = min(self.k, len(self.sample) - 1)
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        needed: list[int] = []
        for leaves, ids in zip(self.taken(self.sample[some], self.leaves), near):
            place = np.empty(self.leaves, np.int64)
            place[leaves] = np.arange(len(leaves))
            needed += (place[self.where[:, ids]].min(0) + 1).tolist()
        return int(np.sort(needed)[max(0, math.ceil(len(needed) * target) - 1)])

    def least(self, q: np.ndarray, taken: list[list[int]]) -> np.ndarray:
        """A score that each query's k-th of the vectors in its leaves reaches, its own aside; less a little for another order of sums."""
        score, out = q @ self.sample.T, np.empty(len(q))
        for i, leaves in enumerate(taken):
            there = np.zeros(self.leaves, bool)
            there[leaves] = True
            near = score[i, there[self.where].any(0)]
            out[i] = np.partition(near, -self.k - 1)[-self.k - 1] if len(near) > self.k else -np.inf
        return out - 1e-9 * self.norm * np.linalg.norm(q, axis=1)


_INDEX = "g string, part int, query boolean, id bigint, v array<{kind}>, ids array<bigint>, least double"


def _filer(shared, schema: pa.Schema):
    def run(batches):
        forests = shared.value
        for b in batches:
            for n, at in by_length(b.column("v")).items():
                rows = b.take(pa.array(at))
                leaves = forests[n].filed(matrix(rows.column("v"), n)) if n in forests else np.zeros((1, len(at)), np.int64)
                for tree in leaves:
                    m = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{n}:{x}" for x in tree]), pa.nulls(m, pa.int32()), pa.array([False] * m), rows.column("id"), rows.column("v"), rows.column("ids"), pa.nulls(m, pa.float64())], schema=schema)

    return run


def _asker(shared, schema: pa.Schema):
    """A row for each query, leaf and slice of the leaf."""

    def run(batches):
        forests, slices = shared.value
        for b in batches:
            for n, at in by_length(b.column("v")).items():
                for a in range(0, len(at), 64):
                    rows = b.take(pa.array(at[a : a + 64]))
                    v = matrix(rows.column("v"), n)
                    leaves = forests[n].taken(v) if n in forests else [[0]] * len(v)
                    least = forests[n].least(v, leaves) if n in forests else np.full(len(v), -np.inf)
                    asked = [(i, f"{n}:{x}", s) for i, some in enumerate(leaves) for x in some for s in range(slices.get(f"{n}:{x}", 0))]
                    for z in range(0, len(asked), 4096):
                        i, g, s = (list(c) for c in zip(*asked[z : z + 4096]))
                        rep = rows.take(pa.array(i))
                        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(s, pa.int32()), pa.array([True] * len(i)), rep.column("id"), rep.column("v"), pa.nulls(len(i), pa.list_(pa.int64())), pa.array(least[i])], schema=schema)

    return run


def _compared(k: int):
    """Of rows sorted by (g, part, query): a slice's vectors are held, then its queries stream by."""

    def run(batches):
        here, held, ids, firsts = None, [], [], []
        ready: np.ndarray | None = None
        for b in batches:
            g, part, asks = b.column("g").to_pylist(), b.column("part").to_pylist(), b.column("query").to_pylist()
            cuts = [0, *[i for i in range(1, len(g)) if (g[i], part[i], asks[i]) != (g[i - 1], part[i - 1], asks[i - 1])], len(g)]
            found = []
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if here != (g[a], part[a]):
                    here, held, ids, firsts, ready = (g[a], part[a]), [], [], [], None
                rows = b.slice(a, z - a)
                v = matrix(rows.column("v"), int(g[a].split(":")[0]))
                if not asks[a]:
                    held.append(v)
                    ids.append(np.asarray(rows.column("id")))
                    firsts += rows.column("ids").to_pylist()
                    continue
                if ready is None:
                    if not held:
                        continue
                    ready, all_ids = np.concatenate(held), np.concatenate(ids)
                    length = np.linalg.norm(ready, axis=1).max()
                qid, least = np.asarray(rows.column("id")), np.asarray(rows.column("least"))
                rough = v @ ready.T
                slack = 1e-9 * length * np.linalg.norm(v, axis=1)
                edge = least if rough.shape[1] <= k + 1 else np.maximum(least, np.partition(rough, -k - 1, 1)[:, -k - 1])
                i, j = np.nonzero(rough >= (edge - slack)[:, None])
                if len(i):
                    found.append((qid[i], all_ids[j], products(ready[j], v[i]), [firsts[x] for x in j], (ready[j] == v[i]).all(1)))
            if found:
                yield pa.RecordBatch.from_pydict({"query": np.concatenate([x[0] for x in found]), "id": np.concatenate([x[1] for x in found]), "score": np.concatenate([x[2] for x in found]), "ids": pa.array([y for x in found for y in x[3]], pa.list_(pa.int64())), "same": np.concatenate([x[4] for x in found])})

    return run


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """A table with an ``id`` for each row, written once: read again it has the same ids."""
    return written(df.withColumn("id", F.monotonically_increasing_id()), name)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, target: float = TARGET, slice_rows: int = SLICE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found; both sides are (vec_id, v) as ``usable`` gives them."""
    with scratch() as keep:
        return keep(written(_nearest(vectors, queries, k, sample, trees, leaf, target, slice_rows), "nearest"))


def _nearest(vectors, queries, k, sample, trees, leaf, target, slice_rows):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = vectors.sparkSession
    kind = vectors.schema["v"].dataType.elementType.simpleString()
    first = vectors.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1)  # the limit goes before the shuffle
    unlike = _numbered(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "unlike")  # lists of k + 1 at most
    asked = _numbered(queries.select("v").distinct(), "asked")
    norms = {r.n: r.m for r in unlike.groupBy(F.size("v").alias("n")).agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))).alias("m"), F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(64).collect()}
    some = unlike.orderBy(F.xxhash64("v"), "id").select("v").limit(sample).toArrow().column("v").combine_chunks()
    size = np.asarray(some.value_lengths()) if len(some) else np.zeros(0, int)
    forests = {int(n): Forest(matrix(some.filter(pa.array(size == n)), int(n)), norms[int(n)], k, trees, leaf, target) for n in np.unique(size) if int(n) in norms}
    ddl = _INDEX.format(kind=kind)
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    files = spark.sparkContext.broadcast(forests)
    filed = unlike.mapInArrow(task(_filer(files, schema)), ddl)
    slices = {r.g: r.s for r in filed.groupBy("g").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("s")).collect()}  # as many as there are leaves and lengths
    parts = spark.createDataFrame([(g, s) for g, s in slices.items()], "g string, parts int")
    filed = filed.drop("part").join(F.broadcast(parts), "g").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).select(*schema.names)
    asks = asked.mapInArrow(task(_asker(spark.sparkContext.broadcast((forests, slices)), schema)), ddl)
    met = filed.unionByName(asks).repartition("g", "part").sortWithinPartitions("g", "part", "query")
    pairs = met.mapInArrow(task(_compared(k)), "query bigint, id bigint, score double, ids array<bigint>, same boolean")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    pairs = pairs.repartition("query").dropDuplicates(["query", "id"]).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    each = pairs.select("query", F.explode("ids").alias("vec_id"), "score", "same")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", F.desc("same"))
    each = each.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct(F.col("_n").alias("n"), "vec_id", "score", "same"))).alias("best"))
    found = written(each.join(asked.withColumnRenamed("id", "query"), "query").select("v", "best"), "found")
    sizes = queries.groupBy("v").agg(F.count("*").alias("n"))
    out = join_unique(queries.withColumnRenamed("vec_id", "query_id"), found, "v", sizes, queries.count(), "inner")
    others = F.slice(F.filter("best", lambda x: ~(x["same"] & (x["vec_id"] == F.col("query_id")))), 1, k)
    return out.select("query_id", F.posexplode(others).alias("_at", "x")).select("query_id", (F.col("_at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op12_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
