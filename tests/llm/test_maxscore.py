import math
import random
from collections import Counter

import duckdb
import numpy as np
from docquarry.llm import maxscore as ms


def brute(rows, k=5):
    """A count of result rows."""
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q, w in ok:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in ok if i != q and len(v) == len(w) and v)
            out.update((q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k]))
    return out


def test_equals_brute_force(spark):
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 0.2) if r.random() < 0.8 else 0.0 for _ in range(12)]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2050, [0.0] * 12), (2100, [1.0, 2.0]), (2101, [0.5, -1.0]), (2150, []), (None, [0.0] * 12)]
    rows += [rows[0], rows[1], rows[7], (50, rows[9][1]), (3, rows[11][1])]  # repeated ids, with the same vector and others
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' as v", "1 as score", "2 as rank").repartition(5)
    v = ms.scaled(df)
    q = v.where("vec_id % 50 = 0")
    assert Counter(map(tuple, ms.top_k(v, q).collect())) == brute(rows)
    assert Counter(map(tuple, ms.top_k(v, q, block=4).collect())) == brute(rows)
    embeddings = df.select("vec_id", "embedding").toPandas()  # noqa: F841
    assert Counter(duckdb.sql(ms.OP5_SQL).fetchall()) == brute(rows)
    assert ms.top_k(v.where("vec_id = 0"), q.where("vec_id = 0")).collect() == []
    assert ms.top_k(v.where("vec_id < 0"), q.where("vec_id < 0")).collect() == []


def test_non_essential_terms_are_left_out():
    """With one block after another, later blocks have fewer essential terms, and results stay exact."""
    r = np.random.default_rng(0)
    x = np.floor(r.normal(0, 50, (4000, 16)) * np.linspace(0.05, 2, 16))
    q = ms.Queries(np.arange(20), x[:20], 5)
    for a in range(0, 4000, 500):
        q.block(np.arange(a, a + 500), x[a : a + 500])
    for i in range(20):
        s = x @ x[i]
        s[i] = -np.inf
        assert q.id[i].tolist() == sorted(range(4000), key=lambda j: (-s[j], j))[:5]
    assert q.traversed < 0.8 * 20 * 16 * 4000
    again = ms.Queries(np.arange(20), x[:20], 5, ms.thresholds(np.arange(20), x[:20], (np.arange(4000), x), 5))
    for a in range(0, 4000, 500):
        again.block(np.arange(a, a + 500), x[a : a + 500])
    assert (again.id == q.id).all() and again.traversed < q.traversed


def test_products_beyond_double_precision(spark):
    """Components of millions: scores fit a long and come out exactly, ties and order too; those that fit none are the nearest long."""
    r = random.Random(9)
    rows = [(i, [float(r.randint(1_000_000, 7_000_000)) * r.choice([1, -1]) + r.random() for _ in range(2)]) for i in range(200)] + [(300 + i, [7e6 + i / 256] * 2) for i in range(30)]
    v = ms.scaled(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3))
    assert Counter(map(tuple, ms.top_k(v, v.where("vec_id % 50 = 0")).collect())) == brute(rows)
    huge = ms.scaled(spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0])], "vec_id bigint, embedding array<double>"))
    assert [tuple(x) for x in ms.top_k(huge, huge.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63) + 1)]
