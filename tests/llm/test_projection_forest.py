from functools import reduce
from operator import add

import numpy as np
import pytest
from docquarry.llm import projection_forest as pf
from pyspark.sql import functions as F


def brute(rows, k, every=20):
    """Of each query the k nearest of all, by the same sums; rows are (vec_id, vector)."""
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = {}
    for i, q in ok:
        if i % every == 0:
            s = sorted((-reduce(add, (a * b for a, b in zip(q, v))), j) for j, v in ok if len(v) == len(q) and (j, v) != (i, q))[:k]
            out.setdefault(i, []).append([(n + 1, j, -x) for n, (x, j) in enumerate(s)])
    return out


def found(spark, rows, k=20, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' as v", "1 as g", "2 as score", "3 as id").repartition(5)
    v = pf.usable(df)
    out = {}
    for r in pf.nearest(v, v.where(F.col("vec_id") % 20 == 0), k, **more).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {i: sorted(x) for i, x in out.items()}


def recall(got, want):
    return np.mean([len({y[1] for y in got.get(i, [])} & {y[1] for y in w[0]}) / len(w[0]) for i, w in want.items()])


def clustered(n, dims, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(20, dims))[r.integers(0, 20, n)] + 0.4 * r.normal(size=(n, dims))
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_recall_scores_and_order(spark):
    rows = clustered(3000, 24, 1)
    got, want = found(spark, rows, sample=1000, leaf=32, slice_rows=40), brute(rows, 20)
    assert recall(got, want) >= 0.9
    exact = {i: np.array(v) for i, v in rows}
    for i, x in got.items():
        assert [y[0] for y in x] == list(range(1, 21)) and [y[1:] for y in x] == sorted([y[1:] for y in x], key=lambda y: (-y[1], y[0])) and i not in [y[1] for y in x]
        assert all(s == float(np.cumsum(exact[i] * exact[j])[-1]) for _, j, s in x)


def test_fewer_leaves_are_taken_than_there_are():
    x = np.array([v for _, v in clustered(4000, 24, 2)])
    forest = pf.Forest(x[:2000], np.linalg.norm(x, axis=1).max(), leaf=32)
    assert len(forest.roots) == pf.TREES and forest.visits < 0.3 * forest.leaves
    filed, q = forest.filed(x), x[::40]
    score = q @ x.T
    near = np.argsort(-score, 1)[:, :20]
    taken = forest.taken(q)
    assert np.mean([np.isin(filed[:, ids], t).any(0).mean() for ids, t in zip(near, taken)]) >= 0.9
    for one, all_ in zip(taken, forest.taken(q, forest.leaves)):
        assert all_[: len(one)] == one and sorted(all_) == list(range(forest.leaves))


def test_small_tables_are_exact(spark):
    rows = clustered(50, 6, 3)
    rows += [(100 + i, rows[3][1]) for i in range(60)]  # copies, queries among them
    rows += [(200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (220, [0.0] * 6), (240, []), (None, rows[1][1]), (260, [1.0, 2.0]), (261, [3.0, -0.5]), (280, [5.0]), rows[0], rows[7], (20, rows[9][1])]
    got, want = found(spark, rows, k=7), brute(rows, 7)
    assert {i: x for i, x in got.items() if i != 20} == {i: x[0] for i, x in want.items() if i != 20 and x[0]}
    assert got[20] == sorted(y for x in want[20] for y in x)  # two rows with that id


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 0.0])]])
def test_no_results(spark, rows):
    assert found(spark, rows) == {}


def test_copies_are_filed_once(spark):
    """A third of all rows are one vector; its copies come by id, and other queries still find their own."""
    rows = clustered(900, 12, 4)
    rows += [(10_000 + i, rows[5][1]) for i in range(500)]
    got, want = found(spark, rows, sample=400, leaf=32), brute(rows, 20)
    assert recall(got, want) >= 0.9
    assert got[10_020] == want[10_020][0]
