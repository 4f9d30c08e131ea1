"""Segmented indexes against scans of all texts."""

import random

import pytest
from docquarry.functions.text import search_tokens
from docquarry.operators import index as ix
from docquarry.operators import search
from docquarry.operators.filters import Filters
from docquarry.sources.versions import Versions
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta Über straße x1".split()


def texts(n, seed, at=0):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 12))), r.choice([None, "", "Alpha beta", "beta"])) for i in range(at, at + n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, a string, b string")


def same(index, rows, spark, q):
    got = sorted((x.item_id, x.tf, round(x.score, 9)) for x in index.bm25(q).collect())
    assert got == sorted((x.item_id, x.tf, round(x.score, 9)) for x in search.bm25(frame(spark, rows), q, ["a", "b"]).collect()), q
    return got


def test_updates_and_merges_equal_a_new_index(spark, tmp_path):
    index = ix.TextIndex(spark, f"file://{tmp_path}/i", ["a", "b"], fanout=3)
    assert index.bm25("alpha").collect() == []  # before the first build
    now = {r[0]: r for r in texts(60, 1)}
    index.build(frame(spark, list(now.values())))
    counts = []
    for step in range(5):
        changed = texts(4, 10 + step, at=step * 7) + texts(3, 20 + step, at=100 + 3 * step)
        gone = [(50 + step,), (step * 7 + 1,)] if step % 2 else [(50 + step,)]  # one of them is changed too, and stays
        index.update(frame(spark, changed), spark.createDataFrame(gone, "item_id bigint"))
        for (g,) in gone:
            now.pop(g, None)
        now |= {r[0]: r for r in changed}
        same(index, list(now.values()), spark, "alpha beta")
        counts.append(len(index.versions.current()[1]["segments"]))
    for q in ("gamma", "STRASSE", "uber", "zz", "beta alpha beta", " . "):
        same(index, list(now.values()), spark, q)
    assert max(counts) < 6 and "PushedFilters" in index.bm25("alpha")._jdf.queryExecution().toString()
    index.merge()
    _, manifest = index.versions.current()
    assert len(manifest["segments"]) == 1 and manifest["hidden"] == [] and manifest["n"] == len(now)
    index.vacuum()
    assert len(index.versions.names("segments")) == 1 and same(index, list(now.values()), spark, "alpha")


def test_an_update_writes_in_proportion_to_the_change(spark, tmp_path):
    wrote = []
    for n in (200, 2000):
        index = ix.TextIndex(spark, f"file://{tmp_path}/{n}", ["a", "b"]).build(frame(spark, texts(n, 2)))
        index.update(frame(spark, texts(5, 3)))
        store = index.versions._store()
        wrote.append([store.getContentSummary(index.versions._path("segments", x)).getLength() for x in index.versions.names("segments")])
    (_, small), (large, also) = wrote[0], wrote[1]
    assert abs(small - also) < 0.2 * small and large > 2 * also


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    assert v.current() == (0, {}) and v.commit(0, {"x": 1}) == 1
    with pytest.raises(RuntimeError):
        v.commit(0, {"x": 2})
    for n in range(1, 30):
        v.commit(n, {"x": n})
    assert v.current() == (30, {"x": 29}) and len(v.names("manifests")) < 30


def test_grams_narrow_and_patterns_decide(spark, tmp_path):
    rows = [(1, "Report[1].txt", "alpha BETA"), (2, "rEport 2", None), (3, "x*y\\z", "ab"), (4, "é𝒳abc", "100% of_it"), (5, "", "line\nbreak here"), (6, "aab", "ÉTÉ abc")]
    items = spark.createDataFrame(rows, "item_id bigint, file_name string, text string").withColumns({"full_path": F.lit("/p"), "is_deleted": F.lit(0), "modified_ts": F.lit(1), "file_type_group": F.lit("text")})
    index = ix.GramIndex(spark, f"file://{tmp_path}/g", ["file_name", "full_path", "text"]).build(items)
    for q in ("report", "REPORT", "eta", "ab", "", "0% o", "of_it", "𝒳ab", "k\nb", "\\z", "ÉTÉ", "été", "zzz", "port[1]"):
        assert {r.item_id for r in search.like_search(items, q, True, index).collect()} == {r.item_id for r in search.like_search(items, q).collect()}, q
    for q in ("Rep*", "*port*", "r?port*", "*[Bb]ETA", "*x[*]y*", "*abc", "?", "[^a]*abc", "*bre?k*", "*é*", "a*"):
        assert {r.item_id for r in search.glob_search(items, q, True, index).collect()} == {r.item_id for r in search.glob_search(items, q).collect()}, q
    assert index.candidates("%report%", False).count() == 2 and index.candidates("%ab%", False) is None
    assert ix.literal_grams("*abcd[xyz]ef?ghi", True) == ["abc", "bcd", "ghi"]
    index.update(items.where("item_id = 2").withColumn("file_name", F.lit("other")))
    assert {r.item_id for r in index.candidates("%report%", False).collect()} == {1}


def test_search_by_index_equals_search_by_scan(spark, tmp_path):
    rows = [(i, f"f{i}.txt", f"/d/f{i}.txt", t, 0 if i % 5 else 1, i % 7, i) for i, t, _ in texts(80, 4)]
    items = spark.createDataFrame(rows, "item_id bigint, file_name string, full_path string, text string, is_deleted int, size_bytes bigint, modified_ts bigint").withColumn("file_type_group", F.lit("text"))
    text = ix.TextIndex(spark, f"file://{tmp_path}/t", ["file_name", "full_path", "text"]).build(items)
    grams = ix.GramIndex(spark, f"file://{tmp_path}/g", ["file_name", "full_path", "text"]).build(items)
    for q in ("alpha beta", "gamma", "", "f1*", "lph", "nothing at all", "?"):
        r = search.SearchRequest(q=q, filters=Filters(min_size=1), limit=7, offset=2 if q == "gamma" else 0)
        a, b = search.search(items, r), search.search(items, r, index=text, grams=grams)
        assert [tuple(x) for x in a.collect()] == [tuple(x) for x in b.collect()] and a.columns == b.columns, q
        assert "text" not in a.columns


def test_tokens_of_blocks_are_those_of_search(spark):
    """Letters beyond ASCII, signs among them, rows that end in a token and texts of any length."""
    odd = ["", None, "ab", "cd e", "Ünï—cödé “x”", "ÅΣΑΣ ΟΔΟΣ", "é𝒳abc ½ ²x Ⅷ", "áb ́ c", "日本 語、x", "İı ǅ", "x" * 70000, " a b_c", "٣٤ १२a"]
    x = spark.createDataFrame([(i, t, odd[-1 - i]) for i, t in enumerate(odd)], "item_id bigint, a string, b string").repartition(2)
    got = sorted((r.item_id, r.token, r.col, r.positions, r.dl) for r in ix.postings(x, ["a", "b"]).collect())
    want = []
    for r in x.select("item_id", *[search_tokens(F.coalesce(c, F.lit(""))).alias(c) for c in ("a", "b")]).collect():
        for col, tokens in enumerate((r.a, r.b)):
            want += [(r.item_id, t, col, [i for i, u in enumerate(tokens) if u == t], len(r.a) + len(r.b)) for t in set(tokens)]
    assert got == sorted(want)


def test_segments_have_a_row_for_a_token_of_many_items(spark, tmp_path):
    """Rows grow with the number of different tokens, not with that of postings, after a build and after a merge; they come by token."""
    index = ix.TextIndex(spark, f"file://{tmp_path}/i", ["a", "b"]).build(frame(spark, texts(900, 5)))
    grams = ix.GramIndex(spark, f"file://{tmp_path}/g", ["a", "b"]).build(frame(spark, texts(900, 5)))
    for x in (index, grams):
        for merged in (False, True):
            if merged:
                x.update(frame(spark, texts(40, 6, at=880))).merge()
            rows = spark.read.parquet(f"file://{tmp_path}/{'i' if x is index else 'g'}/segments/{x.versions.current()[1]['segments'][0]['name']}/postings")
            assert rows.count() < 0.2 * rows.agg(F.sum(F.size("postings"))).first()[0]
            for part in rows.select("token", F.input_file_name().alias("f")).groupBy("f").agg(F.collect_list("token").alias("t")).collect():
                assert part.t == sorted(part.t, key=str.encode)
