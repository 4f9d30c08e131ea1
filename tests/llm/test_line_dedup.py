import os
import random

import pytest

from docquarry.llm import jaccard_join
from docquarry.llm import line_dedup as ld
from pyspark.sql import functions as F

from .conftest import documents


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute(rows):
    """Kept text by document; rows are (doc_id, text) in order."""
    lines = [(i, k, s.strip(" \t\r").lower()) for i, t in rows for k, s in enumerate((t or "").split("\n"))]
    drop = set()
    for n, (i, k, s) in enumerate(lines):
        w = s.split(" ")
        for _, _, t in lines[:n]:
            v = t.split(" ")
            if s and t and (s == t or len(w) >= 8 and len(v) >= 8 and distance(w, v) <= 1):
                drop.add((i, k))
                break
    return {i: None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if (i, k) not in drop) for i, t in rows}


@pytest.mark.parametrize("few", [64 << 20, 0])
def test_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(ld, "LIMIT", few)
    r = random.Random(9)
    base = [[r.choice("abcdefghij") for _ in range(r.randint(5, 14))] for _ in range(12)]

    def line():
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            p, kind = r.randrange(len(w)), r.randrange(3)
            w[p : p + (kind > 0)] = [r.choice("abcxyz")] * (kind < 2)
        return r.choice(["", " ", "\t"]) + (" ".join(w) if r.random() < 0.9 else " ".join(w).upper()) + r.choice(["", "\r", " "])

    rows = [(i, "\n".join(r.choice([line(), line(), line(), ""]) for _ in range(r.randint(1, 6)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "one two three four five six seven eight"), (64, "one two three four five six seven nine"), (65, "word " * 3000 + "end"), (66, "word " * 2999 + "end")]
    got = {x.doc_id: x.text for x in ld.dedup_lines(documents(spark, rows, extra=True).repartition(3)).collect()}
    want = brute(rows)
    assert got == want
    assert got[64] == "" and got[66] == ""


def test_words_repeated_and_in_another_order(spark):
    few = ["1 2 3 4 5 0 0 0 0", "0 0 0 y 0 0 0 0 0", "0 0 0 0 0 x 0 0 0", "0 0 0 0 0 y 0 0 0"]
    rows = [(i, s) for i, s in enumerate(few)]
    assert {x.doc_id: x.text for x in ld.dedup_lines(documents(spark, rows)).collect()} == brute(rows)
    assert brute(rows)[3] == ""
    r = random.Random(11)
    for letters in ("0x", "0xy"):
        rows = [(i, "\n".join(" ".join(r.choice(letters) if r.random() < 0.4 else "0" for _ in range(r.randint(8, 13))) for _ in range(3))) for i in range(60)]
        assert {x.doc_id: x.text for x in ld.dedup_lines(documents(spark, rows)).collect()} == brute(rows)


def test_keys_are_those_of_the_words_that_are_left(spark):
    r = random.Random(12)
    lines = [[r.choice("ab") for _ in range(n)] for n in range(8, 20)]
    lines += [v[:i] + v[i + 1 :] for v in lines[1:] for i in range(len(v))]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lines)], "first int, w array<string>")
    keys, words = {}, {}
    for x in ld.variants(df).collect():
        w = tuple(v for i, v in enumerate(lines[x.first]) if i != x.place)
        assert keys.setdefault(w, x.key) == x.key and words.setdefault(x.key, w) == w


def test_verifies_the_edit_distance(spark):
    r = random.Random(10)
    pairs = [([r.choice("ab") for _ in range(r.randint(0, 5))], [r.choice("ab") for _ in range(r.randint(0, 5))]) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").withColumn("ok", ld.within_one_edit("a", "b"))
    for x in df.collect():
        assert x.ok == (distance(x.a, x.b) <= 1), x


def test_edges(spark):
    assert ld.dedup_lines(documents(spark, [])).collect() == []
    rows = [(1, "x y\nz"), (1, "x y\nz"), (1, "x y\nq"), (None, "z"), (2, "Z\nw")]
    got = sorted((str(x.doc_id), x.text) for x in ld.dedup_lines(documents(spark, rows)).collect())
    assert got.count(("None", "z")) == 1 and ("2", "w") in got
    assert len(got) == 5 and got.count(("1", "")) in (0, 2) and any("x y" in t for _, t in got)
    hot = documents(spark, [(i, "the same line\nown %d" % i) for i in range(3000)])
    assert ld.dedup_lines(hot).agg(F.sum("n_dropped")).first()[0] == 2999


def test_lines_whose_keys_meet_by_chance_are_verified_with_all_partners(spark, monkeypatch):
    whole = ld.variants
    monkeypatch.setattr(ld, "variants", lambda lines: whole(lines).withColumn("key", F.pmod("key", F.lit(3))))
    r = random.Random(13)
    rows = [(i, " ".join(r.choice("abc") if r.random() < 0.3 else "x" for _ in range(r.randint(8, 10)))) for i in range(40)]
    assert {x.doc_id: x.text for x in ld.dedup_lines(documents(spark, rows)).collect()} == brute(rows)


def test_columns_of_the_operators_own_names_stay(spark):
    rows = [(1, "a\nb"), (2, "b\nc")]
    df = documents(spark, rows)
    for c in ("n_lines", "n_dropped", "_mark", "_gone", "key", "first"):
        df = df.withColumn(c, F.lit("mine"))
    got = ld.dedup_lines(df).collect()
    assert all(x[c] == "mine" for x in got for c in ("n_lines", "n_dropped", "_mark", "_gone", "key", "first"))
    assert sorted((x.doc_id, x.text, x.n_lines_, x.n_dropped_) for x in got) == [(1, "a\nb", 2, 0), (2, "c", 2, 1)]


def test_stays_native(spark):
    plans = [ld.occurrences(documents(spark, [(1, "a")])), ld.dedup_lines(documents(spark, [(1, "one two three four five six seven eight"), (2, "one two three four five six seven nine")]))]
    for plan in plans:
        said = plan._jdf.queryExecution().toString()
        assert "Python" not in said and "Arrow" not in said


def test_tables_that_nothing_reads_any_more_are_deleted(spark):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base))
    kept = ld.dedup_lines(documents(spark, [(1, "a\nb"), (2, "b")]))
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before] == ["dropped"]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a\nb"), (2, "")]
    before = set(os.listdir(base))
    groups = jaccard_join.similar_groups(documents(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")]))
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before) == ["classes", "named"]
    assert sorted(map(tuple, groups.collect())) == [(1, 2, 1), (2, 2, 1), (3, 1, 3)]
