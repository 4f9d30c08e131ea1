import duckdb
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
from docquarry.llm import elkan_codes as ec


def lloyd(rows, entries=16, rounds=6):
    """All distances, in whole numbers of Python; rows are (vec_id, vector, label)."""
    ok = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    sizes = [len(r[1]) for r in ok]
    n = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    ok = sorted((r for r in ok if len(r[1]) == n), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = -(-n // 8)
    x = [[math.floor(int(c) * 4096 if abs(c) >= 2**53 else c * 4096) for c in r[1]] + [0] * (8 * d - n) for r in ok]
    part = lambda v, p: v[p * d : p * d + d]
    books = [[part(v, p) for v in x[:entries]] for p in range(8)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    near = lambda v, p: min((far(part(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        of = [[near(v, p)[1] for p in range(8)] for v in x]
        for p in range(8):
            for e in range(len(books[p])):
                mine = [part(v, p) for v, o in zip(x, of) if o[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for r, v in zip(ok, x):
        best = [near(v, p) for p in range(8)]
        out.append((r[0], "".join(f"{e:02x}" for _, e in best), sum(s for s, _ in best), r[2]))
    of_label = {}
    for o in out:
        of_label[o[3]] = of_label.get(o[3], 0) + o[2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    fit = lambda s: s if s < 2**63 else None
    return sorted(((o[0], o[1], fit(o[2]), fit(of_label[o[3]]), digest) for o in out), key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "'x' as v", "1 as code", "2 as sums").repartition(4)
    return sorted((tuple(r) for r in ec.codes(df, **more).collect()), key=str)


def made(n, seed, dims=16, grid=False):
    r = random.Random(seed)
    draw = (lambda: r.randint(-3, 3) / 2) if grid else (lambda: r.gauss(0, 0.3))
    return [(i, [draw() for _ in range(dims)], r.choice([None, 0, 1, 2])) for i in range(n)]


def test_equals_all_distances(spark):
    rows = made(700, 1)
    rows += [(2000 + i, rows[3][1], 5) for i in range(300)]  # copies
    rows += [(3000, None, 1), (3001, [None] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [float("inf")] * 16, 1), (3004, [1.0], 1), (3005, [], 1), (None, rows[5][1], None), rows[0], (0, rows[9][1], 2)]
    assert got(spark, rows) == lloyd(rows)


def test_ties_take_the_lower_entry(spark):
    rows = made(500, 2, dims=8, grid=True)
    assert got(spark, rows) == lloyd(rows)


def test_few_rows_odd_lengths_and_large_numbers(spark):
    for rows in (made(5, 3), made(60, 4, dims=13), [(i, [], 1) for i in range(3)], [(i, [c * 1e6 for c in v], k) for i, v, k in made(80, 5)], [(i, [c * 10.0 ** (i % 30 * 10) for c in v], k) for i, v, k in made(60, 6)]):
        assert got(spark, rows) == lloyd(rows)
    assert got(spark, []) == []


def test_sql(spark):
    rows = made(300, 7)
    embeddings = pa.table({"vec_id": [r[0] for r in rows], "embedding": [r[1] for r in rows], "label": [r[2] for r in rows]})  # noqa: F841
    found = duckdb.sql(ec.OP13_SQL).select("vec_id, code, error, label_error, codebooks_sha256").fetchall()
    assert sorted(found, key=str) == lloyd(rows)


def test_bounds_hold_and_spare_distances():
    """Through rounds of packed bounds: never beyond the true distances, and most entries aren't compared."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(16, 32))
    x = ec.whole(centres[r.integers(0, 16, 4000)] + 0.05 * r.normal(size=(4000, 32)), False)
    books, scale, state, spent = ec.Codebooks(x[:16].transpose(1, 0, 2).copy()), 7.0, None, []
    for _ in range(6):
        now = ec.Round(books, scale)
        code, upper, lower = state or now.first(x)
        code, upper, lower, square = now.assign(x, code, upper, lower)
        true = ec.squares(x[:, :, None, :], books.entries[None])
        assert (code == true.argmin(2)).all() and (square == true.min(2)).all()
        upper, lower = ec.packed(upper, scale, True).astype(float) * scale, ec.packed(lower, scale, False).astype(float) * scale
        assert (upper**2 >= square).all() and (lower**2 <= true * (1 + 1e-12)).all()
        spent.append(now.compared / true.size)
        state, books = (code, upper, lower), books.after(*ec._summed(x, code, 16))
    assert spent[-1] < 0.3 < spent[0]
