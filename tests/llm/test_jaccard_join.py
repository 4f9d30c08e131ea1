import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from docquarry.llm import jaccard_join as jj
from docquarry.llm.shingles import common, shingle_sets

from .conftest import documents


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * len(sets[i] | sets[j]) or rows[i][0] == rows[j][0]:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    return sorted(((d, len(sets[i]), None if d is None else min(least[root(i)])) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=260):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnopq") + r.choice("rstuvw")
    passage = " ".join(word() for _ in range(60))
    bases = [[word() for _ in range(r.randint(8, 90))] for _ in range(12)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.7:
            w = list(r.choice(bases))
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = word()
            w = w[: len(w) - r.randint(0, len(w) // 5)]
        elif kind < 0.85:
            w = passage.split() + [word() for _ in range(r.randint(0, 25))]
        else:
            w = [word() for _ in range(r.randint(0, 30))]
        rows.append((i, r.choice([" ", "\n", "\t"]).join(w) if r.random() < 0.8 else " ".join(w).upper()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "a b c d"), (1006, "a b c d"), (None, rows[0][1]), (None, None), (5, rows[5][1]), (6, "another text of this id"), (1007, "w " * 50_000), (1008, "É x"), (1009, "é x")]
    got = sorted(map(tuple, jj.similar_groups(documents(spark, rows, extra=True).repartition(5)).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("meeting", [1, 3, 8])
def test_large_meetings_are_dealt_over_slices(spark, monkeypatch, meeting):
    monkeypatch.setattr(jj, "MEETING", meeting)
    monkeypatch.setattr(jj, "PART", 500)
    monkeypatch.setattr(jj, "OPEN", 300)
    monkeypatch.setattr(jj, "FEW", 2)
    monkeypatch.setattr(jj, "CHUNK", 70)
    monkeypatch.setattr(jj, "WORDS64", 1)
    rows = corpus(3, 200)
    assert sorted(map(tuple, jj.similar_groups(documents(spark, rows)).collect()), key=str) == brute(rows)


def test_frequent_shingles_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(jj, "PART", 60)
    r = random.Random(19)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if r.random() > 0.03 else f"e{r.random()}" for w in base)) for i in range(120)] + [(200 + i, " ".join(f"v{r.random()}" for _ in range(40))) for i in range(30)]
    seen = []
    plain = jj._meet
    monkeypatch.setattr(jj, "_meet", lambda parts: seen.append(parts) or plain(parts))
    docs = documents(spark, rows)
    assert sorted(map(tuple, jj.similar_groups(docs).collect()), key=str) == brute(rows)
    sketch = np.zeros(jj.SLOTS, np.uint8)
    sketch[:] = 6
    level = spark.sparkContext.broadcast(sketch)
    files = docs.select("text").mapInArrow(jj._file(level, seen[0]), "part bigint, tokens binary, owners binary").collect()
    assert {x.part // seen[0] for x in files} == set(range(1, 1 + 64 * 8 // 60))


def test_each_pair_of_a_large_meeting_shares_one_slice(spark, monkeypatch):
    monkeypatch.setattr(jj, "MEETING", 3)
    r = random.Random(8)
    for groups in ([1] * 9 + [2, 3, 4, 5, 6, 7, -1, -1], list(range(10)), [4] * 11, [-1] * 7, [1, 2]):
        seen = [(7, a, g, len(groups)) for a, g in enumerate(groups)]
        r.shuffle(seen)
        got = jj.dealt(spark.createDataFrame(seen, "token bigint, a bigint, g bigint, size bigint"), spark.createDataFrame([(7, len(groups))], "token bigint, size bigint")).collect()
        slices, pairs = {}, []
        for x in got:
            slices.setdefault(x.slice, []).append((x.side, x.a))
        for seats in slices.values():
            sides = {s for s, _ in seats}
            pairs += [tuple(sorted((a, b))) for s, a in seats for t, b in seats if (a < b if sides == {0} else (s, t) == (1, 2))]
            assert sides <= {0} or sides <= {1, 2}
        want = {(a, b) for b in range(len(groups)) for a in range(b) if groups[a] < 0 or groups[a] != groups[b]}
        assert len(pairs) == len(set(pairs)) and want <= set(pairs)


@pytest.mark.parametrize("words", [1, 16])
def test_bounds_keep_every_pair_that_is_similar(monkeypatch, words):
    monkeypatch.setattr(jj, "WORDS64", words)
    monkeypatch.setattr(jj, "CHUNK", 100)
    rows = corpus(4, 150)
    r = random.Random(14)
    long = [f"w{i}" for i in range(900)]
    rows += [(500 + k, " ".join(w if r.random() > k / 400 else f"v{r.random()}" for w in long)) for k in range(12)]
    sets = [s for s in shingle_sets([t for _, t in rows]) if len(s)]
    n = np.array([len(s) for s in sets])
    known = jj.Signatures(n, [jj.bitmap(s).tobytes() for s in sets])
    group = np.arange(len(sets)) // 2
    group[::7] = -1
    differ = lambda i, j: group[i] != group[j] or group[i] < 0
    similar = {(i, j) for j in range(len(sets)) for i in range(j) if jj.linked(common(sets[i], sets[j]), n[i], n[j])}
    order = np.lexsort((n, group))
    tree = lambda at: jj.Tree(n[at], known.short[at], group[at])
    got = {tuple(sorted((order[a], order[b]))) for x, y in tree(order).pairs() for a, b in zip(x.tolist(), y.tolist())}
    assert {p for p in similar if differ(*p)} <= got and len(got) < len(sets) ** 2 / 4
    left, right = order[: len(order) // 3], order[len(order) // 3 :]
    two = [tuple(sorted((left[a], right[b]))) for x, y in tree(left).pairs(tree(right)) for a, b in zip(x.tolist(), y.tolist())]
    assert {p for p in similar if differ(*p) and len({*p} & {*left.tolist()}) == 1} <= set(two) and len(two) == len(set(two))
    x, y = np.triu_indices(len(sets), 1)
    ok = known.room(x, y, 75)
    assert similar <= set(zip(x[ok].tolist(), y[ok].tolist())) and ok.sum() < len(x) / 4


def test_inner_nodes_prune_by_what_must_be_lacking():
    r = np.random.default_rng(1)
    base = [np.unique(r.integers(0, 2**63, 400, dtype=np.uint64)) for _ in range(2)]
    sets = [np.unique(np.concatenate([b[np.sort(r.choice(400, 385, False))], base[0][:5]])) for b in base for _ in range(8)]
    tree = jj.Tree(np.array([len(s) for s in sets]), np.stack([jj.bitmap(s) for s in sets]), np.full(16, -1))
    assert not tree.room(tree, 1, np.array([0]), np.array([1]), 75)[0] and tree.room(tree, 1, np.array([0]), np.array([0]), 75)[0]


def test_edges(spark):
    assert jj.similar_groups(documents(spark, [])).collect() == []
    assert [tuple(r) for r in jj.similar_groups(documents(spark, [(3, None)])).collect()] == [(3, 0, 3)]
    rows = [(1, "a b c d e f"), (2, "A B C D E F"), (3, "other words entirely here now then"), (None, "x")]
    assert sorted(str(r.doc_id) for r in jj.one_of_each(documents(spark, rows)).collect()) == ["1", "3", "None"]


def test_a_words_hash_does_not_depend_on_what_came_before():
    """The first texts of a worker may have words of one letter only."""
    import subprocess
    import sys

    code = "from docquarry.llm import shingles as s; a = s.shingle_sets(['a b'])[0]; s.shingle_sets(['longer words']); assert (a == s.shingle_sets(['a b'])[0]).all() and (a == s.shingle_sets(['longer words', 'A b'])[1]).all()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_bitmaps_tell_shared_passages_from_similar_sets():
    """Sets with 0.6 of their members in common don't leave the trees as pairs, those that are similar do."""
    r = np.random.default_rng(5)
    for n in (900, 1000, 3500):
        for share, room in ((0.6, False), (0.87, True)):
            a = r.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate([a[: int(share * n)], r.integers(0, 1 << 63, n - int(share * n)).astype(np.uint64)])
            s = jj.Signatures(np.array([n, n]), [jj.bitmap(np.sort(x)).tobytes() for x in (a, b)])
            assert s.room(np.array([0]), np.array([1]), 75)[0] == room, (n, share)


def test_memory_of_a_parts_bitmaps():
    """Beside the column itself: the shortest width of each class, and little else, whatever the widths."""
    r = np.random.default_rng(3)
    words = np.repeat([16, 32, 64], 20_000)
    column = pa.array([x.tobytes() for x in np.split(r.integers(0, 1 << 63, words.sum(), np.uint64), np.cumsum(words)[:-1])], pa.binary())
    order = r.permutation(len(words))
    x = r.integers(0, len(words), 20_000)
    tracemalloc.start()
    known = jj.Signatures(words[order] * 16, column, order)
    known.room(x, (x + 1) % len(words), 75)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < known.short.nbytes + 12_000_000
    for i in (0, 5, 59_999):
        bits = np.frombuffer(column[int(order[i])].as_py(), np.uint64)
        assert (known.short[i] == jj.folded(bits, 16)).all() and (known.rows(np.array([i]), len(bits))[0] == bits).all()
