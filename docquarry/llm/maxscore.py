"""Operator 5: exact top-k search by inner product with MaxScore.

Dimensions are the query's terms. Within a block of vectors each component is shifted by the block's smallest (or, for negative query weights,
taken from the block's largest) value, so that every term adds at least 0 and its bound is |weight| x (largest - smallest). A query whose bounds in sum
can't lift a vector of the block over its k-th score so far skips the block. Of its terms, in groups of ``GROUP`` columns, those with the smallest bounds
that can't do so either are non-essential: the essential groups alone are traversed for the whole block, and only vectors that stay competitive are
probed with the other groups, largest bounds first. Blocks of candidates are searched apart, each partition keeps k for each query, and these are
merged. All partitions start from the same thresholds: the k-th scores in a sample of ``SAMPLE`` vectors, which are scores that any result reaches.

Components are floor(256 * x) in double precision; scores are integers. Where products of a block could lose digits in double precision, bounds leave room
for that and the vectors that stay are scored in whole numbers; a score beyond a long is given as the nearest long. Vectors that are null, or hold a null or non-finite component, take no part;
vectors of another length than the query's don't match it, empty ones match none. Every row takes part: those with the same id are candidates and queries
each, and no row with the query's id is a candidate for it. Ties go to the smaller id; with fewer than k other vectors there are fewer ranks; empty
tables give no rows. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_length, matrix, own, table, task, written

K, EVERY, SCALE = 5, 50, 256.0
#: Queries that are broadcast together, and that a block is searched with at a time; vectors of a block, columns that are traversed together, and vectors that give the first thresholds.
QUERIES, TOGETHER, BLOCK, GROUP, SAMPLE = 16_384, 2_048, 2_048, 8, 4_096
#: Of a block's vectors at most one in so many is probed.
PROBED = 4


def scaled(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(key, v) with integer components as doubles, for the vectors that take part."""
    big = F.lit(float("inf"))
    x = own(df, key, vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.transform(F.col(vector), lambda c: c.cast("double")).alias("v"))
    x = x.where(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < big), F.lit(False))))
    return x.select(key, F.transform("v", lambda c: (F.floor(c * scale)).cast("double")).alias("v"))


def whole(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size; those that no long can hold are the nearest long."""
    weights = [int(w) for w in q.tolist()]
    return np.array([min(max(sum(int(a) * w for a, w in zip(row, weights)), -(2**63) + 1), 2**63 - 1) for row in x.tolist()], np.int64)


class Queries:
    """Query vectors of one length, and their k best so far; ``least`` are scores that their k-th results reach at least."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()
        self.traversed = 0  # products of essential terms so far

    def block(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Searches one block of candidates."""
        low, high = x.min(0), x.max(0)
        largest = np.abs(self.q).max(1, initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1]) * 4
        exact = bool(largest.max(initial=0) < 2**53)
        edge = self.least if exact else self.least - largest * 1e-13  # sums are rounded then, and those near the edge are worked out in whole numbers
        groups = np.array_split(np.argsort(-(np.abs(self.q).mean(0) * (high - low)), kind="stable"), -(-x.shape[1] // GROUP))
        top = np.where(self.q >= 0, self.q * high, self.q * low)  # what a term adds at most; the rest of each is its bound
        bound = np.abs(self.q) * (high - low)
        live = np.flatnonzero(top.sum(1) >= edge)  # the others skip the block
        if not len(live):
            return
        by_group = np.stack([bound[live][:, g].sum(1) for g in groups], 1)
        base = (top[live] - bound[live]).sum(1)
        order = np.argsort(by_group, 1, kind="stable")
        idle = base[:, None] + np.cumsum(np.take_along_axis(by_group, order, 1), 1) < edge[live, None]  # so many groups, the smallest, are non-essential
        essential = np.ones(by_group.shape, bool)
        np.put_along_axis(essential, order, ~idle, 1)
        partial, rest = np.zeros((len(live), len(x))), np.zeros(len(live))
        for k, g in enumerate(groups):
            use = np.flatnonzero(essential[:, k])
            if len(use) == len(live):
                partial += self.q[live][:, g] @ x[:, g].T
            elif len(use):
                partial[use] += self.q[live[use]][:, g] @ x[:, g].T
            self.traversed += len(use) * len(g) * len(x)
            rest += np.where(essential[:, k], 0.0, top[live][:, g].sum(1))
        while True:  # where many vectors stay competitive, the next group is traversed too: cheaper than to probe them one by one
            many = np.flatnonzero(((partial + rest[:, None] >= edge[live, None]).sum(1) > len(x) // PROBED) & ~essential.all(1))
            if not len(many):
                break
            nxt = np.where(essential[many], -1.0, by_group[many]).argmax(1)
            for k in np.unique(nxt):
                use, g = many[nxt == k], groups[k]
                partial[use] += self.q[live[use]][:, g] @ x[:, g].T
                rest[use] -= top[live[use]][:, g].sum(1)
                essential[use, k] = True
                self.traversed += len(use) * len(g) * len(x)
        for i in np.flatnonzero(partial.max(1) + rest >= edge[live]):
            n = live[i]
            near = np.flatnonzero(partial[i] + rest[i] >= edge[n])
            score, room = partial[i, near], rest[i]
            others = np.flatnonzero(~essential[i])
            for k in others[np.argsort(-by_group[i, others], kind="stable")]:  # probe the others while competitive
                g = groups[k]
                score = score + x[near[:, None], g] @ self.q[n, g]
                room -= top[n, g].sum()
                keep = score + room >= edge[n]
                near, score = near[keep], score[keep]
                if not len(near):
                    break
            keep = ids[near] != self.ids[n]
            if keep.any():
                near, score = near[keep], score[keep].astype(np.int64) if exact else whole(x[near[keep]], self.q[n])
                self._merge(n, ids[near], score)
                if not exact:
                    edge[n] = max(edge[n], self.least[n] - largest[n] * 1e-13)

    def _merge(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        ids, score = np.concatenate([self.id[i], ids]), np.concatenate([self.score[i], score])
        best = np.lexsort((ids, ~score))[: self.k]
        self.id[i], self.score[i] = ids[best], score[best]
        if self.score[i, -1] > np.iinfo(np.int64).min:
            self.least[i] = max(self.least[i], float(self.score[i, -1]))

    def rows(self):
        real = self.score > np.iinfo(np.int64).min
        at = np.nonzero(real)
        return at[0], self.ids[at[0]], self.id[at], self.score[at]


_OUT = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrices(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in the columns, ids and vectors by length."""
    return {n: (at, np.asarray(ids)[at], matrix(vectors.take(pa.array(at)), n)) for n, at in by_length(vectors).items() if n}


def _collected(some: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    rows = some.select("vec_id", "v").toArrow().combine_chunks()
    return _matrices(*[c.combine_chunks() for c in rows.columns]) if rows.num_rows else {}


def thresholds(ids: np.ndarray, q: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """For each query the k-th score in a sample of (ids, vectors), its own id aside."""
    out = np.full(len(ids), -np.inf)
    if sample is not None and len(sample[0]) >= k:
        for i in range(0, len(ids), 1024):
            s = q[i : i + 1024] @ sample[1].T
            s[ids[i : i + 1024, None] == sample[0][None, :]] = -np.inf
            out[i : i + 1024] = np.partition(s, -k, 1)[:, -k]
    return out


def _searcher(shared, k: int):
    def run(batches):
        queries: dict[int, list[tuple[np.ndarray, Queries]]] = {}
        for n, parts in shared.value.items():
            queries[n] = [(at, Queries(ids, q, k, least)) for at, ids, q, least in zip(*[[x[i : i + TOGETHER] for i in range(0, len(x), TOGETHER)] for x in parts])]
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                for n, (_, ids, x) in _matrices(part.column(0), part.column(1)).items():
                    for _, q in queries.get(n, []):
                        q.block(ids, x)
        for at, q in (x for some in queries.values() for x in some):
            where, *rows = q.rows()
            yield pa.RecordBatch.from_arrays([pa.array(at[where]), *[pa.array(c) for c in rows]], schema=_OUT)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k vectors with the highest inner product, those of the query's own id aside.

    Both sides are (vec_id, v) as ``scaled`` gives them. Queries go over the vectors in blocks of about ``block``; each block is broadcast, and with
    more than one its results are written before the next.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // block))
    sample = _collected(vectors.limit(SAMPLE))
    parts = []
    for b in range(blocks):
        by_size = _collected(queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b))  # about ``block`` rows
        shared = spark.sparkContext.broadcast({n: (at, ids, q, thresholds(ids, q, sample[n][1:] if n in sample else None, k)) for n, (at, ids, q) in by_size.items()})
        found = vectors.mapInArrow(task(_searcher(shared, k)), "query bigint, query_id bigint, vec_id bigint, score bigint")
        w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(found if blocks == 1 else written(found, "found"))
        if blocks > 1:
            shared.unpersist()
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP5_SQL = """
with valid as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), pairs as (
    select q.n, q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
    from (select *, row_number() over () as n from valid where vec_id % 50 = 0) q join valid c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
), ranked as (
    select query_id, cast(row_number() over (partition by n order by score desc, vec_id) as integer) as rank, vec_id, score from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
