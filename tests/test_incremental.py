"""Incremental near-duplicate groups, windows, roots and folder ranges against plain Python."""

import random

from docquarry.operators import dedup, folders, near_index, search
from docquarry.sources import files as src
from docquarry.sources.versions import kept
from pyspark.sql import functions as F


def greedy(hashes):
    """The groups of a walk over items in order; (key, item, similarity)."""
    seeds, home = [], {}
    for i in sorted(hashes):
        near = next((s for s in seeds if (hashes[s] ^ hashes[i]).bit_count() <= 6), None)
        if near is None:
            seeds.append(i)
        home[i] = i if near is None else near
    many = {s for s in home.values() if sum(x == s for x in home.values()) > 1}
    return {(f"simhash_{s}", i, 1 - (hashes[s] ^ hashes[i]).bit_count() / 64) for i, s in home.items() if s in many}


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def frame(spark, hashes):
    return spark.createDataFrame([(i, signed(h)) for i, h in hashes.items()], "item_id bigint, h bigint")


def flipped(r, h, most):
    for _ in range(r.randint(0, most)):
        h ^= 1 << r.randrange(64)
    return h


def test_repaired_groups_equal_greedy_ones(spark, tmp_path):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(4)]
    draw = lambda: flipped(r, r.choice(base), 8)
    now = {i: draw() for i in range(10, 60)}
    index = near_index.NearIndex(spark, f"file://{tmp_path}/n", buckets=16, parts=4).build(frame(spark, now))
    got = lambda df: {tuple(x) for x in df.collect()}
    assert got(index.groups()) == greedy(now) == got(dedup.near_groups(frame(spark, now)))
    for step in range(2):
        changed = {i: draw() for i in r.sample(range(75), 8)}  # some come before all others, some share a hash
        changed |= {i: now[r.choice(sorted(now))] for i in r.sample(range(75), 2)}
        gone = r.sample(sorted(now), 6)
        index.update(frame(spark, changed), spark.createDataFrame([(g,) for g in gone], "item_id bigint"))
        for g in gone:
            now.pop(g)
        now |= changed
        assert got(index.groups()) == greedy(now), step


def test_repair_takes_few_rounds_in_large_groups(spark, tmp_path, monkeypatch):
    """Members of a group wait for its seed, not for each other."""
    now = {i: 1 << i for i in range(1, 31)}
    index = near_index.NearIndex(spark, f"file://{tmp_path}/n", buckets=16, parts=4).build(frame(spark, {0: (1 << 64) - 1}))
    names = []
    monkeypatch.setattr(near_index, "kept", lambda df, name: (names.append(name), kept(df, name))[1])
    index.update(frame(spark, now))
    assert {tuple(x) for x in index.groups().collect()} == greedy({0: (1 << 64) - 1} | now)
    assert names.count("near-now") <= 3


def test_returned_hashes_pair_once(spark, tmp_path):
    """Their bands are stored twice."""
    now = {1: 5, 2: 7, 3: 1 << 60, 4: 1 << 61}
    index = near_index.NearIndex(spark, f"file://{tmp_path}/n", buckets=16, parts=4).build(frame(spark, now))
    index.update(frame(spark, {9: 1 << 50}), spark.createDataFrame([(2,)], "item_id bigint"))
    index.update(frame(spark, {2: 7, 8: 6}))
    assert {tuple(x) for x in index.groups().collect()} == greedy(now | {9: 1 << 50, 8: 6})
    pairs = [x.pair for x in index._tables(index.versions.current()[1]["tables"])["pairs"].current().collect()]
    assert len(pairs) == len(set(pairs))


def test_pairs_come_once(spark):
    r = random.Random(6)
    hashes = {i: flipped(r, (1 << 63) | 12345, 5) for i in range(40)}
    want = {(a, b) for a in hashes for b in hashes if a < b and (hashes[a] ^ hashes[b]).bit_count() <= 6}
    rows = [(x.a, x.b) for x in dedup.all_near_pairs(frame(spark, hashes).withColumnRenamed("item_id", "id")).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_first_best_window(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["in", "the", "in-the", "x", "y", "Z,in"]) for _ in range(r.randint(0, 70)))) for i in range(120)] + [(900, None), (901, "the in")]
    got = {x.item_id: (x.start, x.matches) for x in search.best_windows(spark.createDataFrame(rows, "item_id bigint, text string"), "text", ["in", "the"]).collect()}
    for i, t in rows:
        tokens = [(w, p) for p, word in enumerate((t or "").split()) for w in word.lower().replace("-", " ").replace(",", " ").split()]
        places = [(a[1], b[1]) for a, b in zip(tokens, tokens[1:]) if (a[0], b[0]) == ("in", "the")]
        counts = [(sum(s <= o and c < s + 20 for o, c in places), -s) for s in range(max(1, len((t or "").split())))]
        n, back = max(counts)
        assert got[i] == ((-back, n) if n else (0, 0)), t
    shown = search.best_snippets(spark.createDataFrame([(1, "in the " + "a " * 30 + "in the in the end")], "item_id bigint, text string"), "text", ["in", "the"]).first().snippet
    assert shown.startswith("...a a") and shown.endswith("<em>in the</em> <em>in the</em>...")


def test_many_roots_by_one_plan(spark):
    """100,000 roots make the plan that two make, and drop the same files as a predicate each does."""
    paths = [f"/data/{a}/{b}/f{c}.txt" for a in range(12) for b in ("x", "xy", "z") for c in range(3)] + ["/data/top.txt", "/other/x/f.txt"]
    files = spark.createDataFrame([(p,) for p in paths], "full_path string")
    some = ["file:/data/1", "/data/2/x/", "/data/3/xy", "/data", "/other/x", "/data/none"]
    want = {p for p in paths if not any(p.startswith(n) for n in ("/data/1/", "/data/2/x/", "/data/3/xy/"))}
    roots = spark.createDataFrame([(p,) for p in some], "root_path string")
    assert {r[0] for r in src.outside(files, roots, "/data").collect()} == want
    many = roots.unionByName(spark.range(100_000).select(F.concat(F.lit("/data/r"), "id").alias("root_path")))
    x = src.outside(files, many, "/data")
    assert {r[0] for r in x.collect()} == want
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan(x)) < 3 * len(plan(src.outside(files, roots, "/data")))
    binary = files.select(F.concat(F.lit("file:"), "full_path").alias("path"), F.lit(1).cast("bigint").alias("length"), F.lit(0).cast("timestamp").alias("modificationTime"), F.lit(b"").alias("content")).where("path like '%/data/%'")
    assert src.described(binary, "file:///data", [*some, *[f"/data/q{i}" for i in range(9)]]).count() == src.described(binary, "file:///data", some).count() == len(want) - 1


def test_ranges_of_folders(spark):
    r = random.Random(8)
    parent = {i: r.choice([None, 777, *range(1, i)]) if i > 1 else None for i in range(1, 60)}  # 777 is missing: such folders are roots
    f = spark.createDataFrame([(i, p, f"n{i}") for i, p in parent.items()], "vf_id int, parent_vf_id int, name string").repartition(7)
    numbers = folders.numbered(f)
    rows = {x.vf_id: x for x in numbers.collect()}
    assert sorted(x["first"] for x in rows.values()) == list(range(1, 60))
    for v in parent:
        below = {v}
        while True:
            more = below | {i for i, p in parent.items() if p in below}
            if more == below:
                break
            below = more
        assert {i for i, x in rows.items() if rows[v]["first"] <= x["first"] <= rows[v]["last"]} == below
    assert {x[0] for x in folders.subtree_by_range(numbers, 1).collect()} == {x[0] for x in folders.subtree(f, 1).collect()}


def test_no_nested_list_is_longer_than_a_page(spark):
    items = spark.range(500).select(F.col("id").alias("item_id"), F.lit("h").alias("sha256"), F.lit(1).cast("bigint").alias("size_bytes"), F.lit("n").alias("file_name"), F.lit("/p").alias("full_path"))
    g = dedup.exact_groups(items).first()
    assert g.item_count == 500 and g.members == list(range(dedup.PAGE)) and dedup.exact_members(items).count() == 500
    x = dedup.listing(dedup.exact_members(items).withColumn("similarity", F.lit(1.0)), items, limit=5, page=10, start=480).first()
    assert x.item_count == 500 and x.primary_id == 0 and [m.item_id for m in x.members] == list(range(480, 490))
    assert dedup.listing(dedup.exact_members(items).withColumn("similarity", F.lit(1.0)), items, start=900).first().members == []


def test_places_are_those_of_tokens(spark):
    """Overlapping places, signs and marks between tokens, words without tokens; and a file of one partition is dealt over all cores."""
    r = random.Random(8)
    odd = ["a", "A", "á", "a-a", "b", "—", "́", "a.b", "ba", "日", "áa", "a_a", "\t", "ab", "İ", "a’b"]
    rows = [(i, r.choice([" ", "  ", "\n"]).join(r.choice(odd) for _ in range(r.randint(0, 30)))) for i in range(150)] + [(900, None), (901, " a  a "), (902, "a a a")]
    x = spark.createDataFrame(rows, "item_id bigint, text string")
    for phrase in (["a"], ["a", "a"], ["a", "b"], ["a", "a", "a"], ["日", "a"], []):
        want = {i.item_id: i["_all"] for i in search._placed(x, "text", phrase, [F.col("item_id")]).collect()}
        assert {i.item_id: i["_all"] for i in search._places(x, "text", phrase, [F.col("item_id")]).collect()} == want, phrase
    plan = search.best_windows(x.coalesce(1), "text", ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan
