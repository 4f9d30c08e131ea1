"""Operators on small tables, with the edges that the supplied tables don't have."""

import hashlib
import io
import math
import random
import re
import sqlite3
import zipfile

import numpy as np
import pytest
from docquarry.functions import files as fn
from docquarry.functions import formatting as fmt
from docquarry.functions import phash, text
from docquarry.operators import dedup, folders, listing, search, timeline
from docquarry.operators import index as search_index
from docquarry.operators.filters import Filters, glob, glob_regex, like
from docquarry.plans import rag, settings
from docquarry.sources import files as src
from docquarry.streaming import ingest
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_simhash_equals_a_plain_model(spark):
    def model(t):
        if t is None or len(t) < 20:
            return None
        tokens = re.findall(r"\w+", t.lower())
        runs = [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] if len(tokens) >= 3 else tokens
        votes = [0] * 64
        for r in runs:
            h = int(hashlib.md5(r.encode()).hexdigest(), 16)
            for i in range(64):
                votes[i] += 1 if h >> i & 1 else -1
        return f"{sum(1 << i for i in range(64) if votes[i] > 0):016x}"

    texts = [None, "", "x" * 19, "x" * 20, "one two three four five", "!!! ??? ... ,,, ;;; :::", "Ünï_cödé ÉCOLE straße one_two", "a b c " * 9, "two words and twenty characters"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert {r.id: r.simhash64 for r in text.simhash(rows, "id", "t").collect()} == {i: model(t) for i, t in enumerate(texts)}


def test_votes_of_long_texts_are_added_up_in_parts(spark, monkeypatch):
    r = random.Random(7)
    rows = spark.createDataFrame([(i, " ".join(r.choice("abcdefgh") * 3 for _ in range(n))) for i, n in enumerate((10, 40, 300, 1000))], "id int, t string")
    whole = sorted(map(tuple, text.simhash(rows, "id", "t").collect()))
    monkeypatch.setattr(text, "LANE", 5)
    assert sorted(map(tuple, text.simhash(rows, "id", "t").collect())) == whole


def test_near_groups_equal_the_greedy_loop(spark):
    r = random.Random(1)
    for n in (0, 1, 60):
        base = [r.getrandbits(64) for _ in range(8)]
        hashes = [(i, base[r.randrange(8)] ^ sum(1 << r.randrange(64) for _ in range(r.randrange(6))) & (2**64 - 1)) for i in range(n)]
        seen, want = set(), set()
        for k, (i, h) in enumerate(hashes):
            if i not in seen:
                group = [(j, bin(h ^ g).count("1")) for j, g in hashes[k:] if j not in seen and bin(h ^ g).count("1") <= 6]
                seen.update(j for j, _ in group)
                if len(group) > 1:
                    want |= {(f"simhash_{i}", j, 1 - d / 64) for j, d in group}
        signed = [(i, h - 2**64 if h >> 63 else h) for i, h in hashes]
        df = spark.createDataFrame([*signed, (10_000, None)], "item_id bigint, h bigint")
        assert {tuple(x) for x in dedup.near_groups(df).collect()} == want


def test_hash_bits_and_similarity(spark):
    assert one(spark, text.hash_bits(F.col("a")), a="ffffffffffffffff") == -1
    assert one(spark, text.hamming_similarity(F.lit(0), F.lit(63))) == 1 - 6 / 64
    assert one(spark, text.hamming_similarity(F.lit(None).cast("bigint"), F.lit(1))) == 0


def test_bm25_equals_an_embedded_full_text_index(spark):
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "déjà", "vu_x", "alpha"]
    rows = [(i, *[" ".join(r.choice(words) for _ in range(r.randrange(0, 9))) for _ in range(3)]) for i in range(40)]
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(id unindexed, a, b, c)")
    c.executemany("insert into t values (?, ?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "item_id int, a string, b string, c string")
    for q in ("alpha", "alpha alpha", "Beta gamma", "deja vu", "nothing here", "DÉJÀ"):
        want = dict(c.execute("select id, bm25(t) from t where t match ?", ['"' + q + '"']).fetchall())
        got = {x.item_id: x.score for x in search.bm25(df, q, ["a", "b", "c"]).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in got), q
    assert search.bm25(df, " ?! ", ["a"]).collect() == []


ITEMS = [(1, "r", "/a/Report[1].txt", "Report[1].txt", "/a", ".txt", "text", 10, 700000000, 700000000, 0, "alpha beta"), (2, "r", "/a/b_c%.md", "b_c%.md", "/a", ".md", "text", 0, 800000000, 800000000, 0, "Beta alpha"), (3, "q", "/z/É.TXT", "É.TXT", "/z", ".txt", "text", None, None, 5, 0, None), (4, "q", "/z/old.txt", "old.txt", "/z", ".txt", "text", 7, 5, 6, 1, "alpha beta")]
KINDS = "item_id int, root string, full_path string, file_name string, parent_path string, extension string, file_type_group string, size_bytes bigint, best_time_ts bigint, modified_ts bigint, is_deleted int, text string"


def test_filters_patterns_and_dispatch(spark):
    items = spark.createDataFrame(ITEMS, KINDS)
    ids = lambda df: sorted(r.item_id for r in df.select("item_id").collect())
    assert ids(items.where(Filters(min_size=0, max_size=0).column())) == [2] and ids(items.where(Filters(since_ts=0, root="").column())) == [1, 2, 3]
    assert ids(items.where(glob(F.col("file_name"), "Report[[]1[]]*"))) == [1] and ids(items.where(glob(F.col("file_name"), "report*"))) == []
    assert ids(items.where(like(F.col("file_name"), "%é.txt"))) == [] and ids(items.where(like(F.col("file_name"), "É.txt"))) == [3]
    assert ids(items.where(like(F.col("file_name"), "B_C%"))) == [2] and glob_regex("[a") == "(?!)"
    find = lambda q, **k: ids(search.search(items, search.SearchRequest(q=q, **k)))
    assert find("alpha beta") == [1] and find("beta a") == [2] and find("eta alp") == [2]
    assert find("*.md") == [2] and find("") == [1, 2, 3] and find("alpha", filters=Filters(min_size=5)) == [1]
    assert find("lph", search_content=False) == [] and find("alpha", order_by="size_bytes", limit=1) == [1]
    with pytest.raises(ValueError):
        search.SearchRequest(limit=500)


def test_snippet_marks_the_phrase(spark):
    df = spark.createDataFrame([(1, "w " * 30 + "needle The Needle, Here. " + "v " * 30), (2, "nothing"), (3, None), (4, "a a-a a b")], "id int, t string")
    got = {r.id: r.snippet for r in search.snippets(df, "t", ["needle", "here"]).collect()}
    assert got[1] == "...w w needle The <em>Needle, Here.</em> " + "v " * 13 + "v..." and got[2] == "nothing" and got[3] == ""
    assert {r.id: r.snippet for r in search.snippets(df, "t", ["a", "a"]).collect()}[4] == "<em>a a-a a</em> b"


def test_index_searches_as_texts_do_and_takes_updates(spark, tmp_path):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "déjà", "the"]
    make = lambda ids: spark.createDataFrame([(i, *[" ".join(r.choice(words) for _ in range(r.randrange(0, 9))) for _ in range(2)]) for i in ids], "item_id int, a string, b string")
    old, new = make(range(40)), make(range(30, 50))
    index = search_index.TextIndex(spark, f"file://{tmp_path}/index", ["a", "b"]).build(old)
    both = old.where("item_id < 30 and item_id not in (3, 4)").unionByName(new)
    for now, change in ((old, lambda: None), (both, lambda: index.update(new, old.where("item_id in (3, 4)")))):
        change()
        for q in ("alpha", "alpha alpha", "Beta gamma", "deja the alpha", "none of it", "?"):
            assert sorted((x.item_id, x.tf, round(x.score, 9)) for x in index.bm25(q).collect()) == sorted((x.item_id, x.tf, round(x.score, 9)) for x in search.bm25(now, q, ["a", "b"]).collect()), q
    assert "PushedFilters" in index.bm25("alpha")._jdf.queryExecution().toString()


def test_no_tokeniser_in_a_lambda(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id int, text string")
    for x in (text.simhash(df, "item_id", "text"), search.bm25(df, "a b", ["text"]), search.snippets(df, "text", ["a", "b"])):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        for m in re.finditer(r"lambdafunction\(", plan):
            depth, end = 1, m.end()
            while depth and end < len(plan):
                depth += {"(": 1, ")": -1}.get(plan[end], 0)
                end += 1
            inner = plan[m.start() : end]
            assert "regexp_extract_all" not in inner or "text#" not in inner, inner


def test_near_pairs_of_any_width_of_bands(spark, monkeypatch):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(40)]
    hashes = sorted({base[r.randrange(40)] ^ sum(1 << b for b in r.sample(range(64), r.randrange(9))) for _ in range(250)})
    df = spark.createDataFrame([(i, h - 2**64 if h >> 63 else h) for i, h in enumerate(hashes)], "id int, h bigint")
    want = {(i, j) for j in range(len(hashes)) for i in range(j) if (hashes[i] ^ hashes[j]).bit_count() <= 6}
    for blocks in (7, 8, 9, 10):
        monkeypatch.setattr(dedup, "blocks_for", lambda _, b=blocks: b)
        assert sorted((x.a, x.b) for x in dedup.near_pairs(df).collect()) == sorted(want)  # each once
        monkeypatch.undo()


def test_timeline_edges(spark):
    assert timeline.bucket_range("2024") == (1704067200, 1735689600) and timeline.bucket_range("2024-02") == (1706745600, 1709251200)
    rows = spark.createDataFrame([(1, 1709251199, 1), (2, 1709251200, None), (3, None, 1)], "item_id int, best_time_ts bigint, size_bytes bigint")
    assert {(r.bucket, r.item_count, r.total_size) for r in timeline.buckets(rows, "month").collect()} == {("2024-02", 1, 1), ("2024-03", 1, 0)}
    assert [r.item_id for r in timeline.bucket_items(rows, "2024-02-29").collect()] == [1]
    with pytest.raises(ValueError):
        timeline.buckets(rows, "week")


def test_names_and_times(spark):
    paths = ["/a/b.tar.GZ", ".hidden", "/a/.hidden", "/a/x.", "noext", "C:\\d\\e.Txt", "/a.b/c"]
    got = [one(spark, fn.suffix(F.lit(p))) for p in paths]
    assert got == [".gz", "", "", "", "", ".txt", ""]
    time, source = fn.best_time(F.col("c"), F.col("m"))
    for c, m, want in [(700000000, 700000000, (700000000, "ctime")), (5, 700000000, (700000000, "mtime")), (5, 6, (6, "mtime")), (631152000, 631152001, (631152001, "mtime")), (800000000, 700000000, (700000000, "mtime"))]:
        assert (one(spark, time, c=c, m=m), one(spark, source, c=c, m=m)) == want
    assert one(spark, fn.degrees(F.lit(10.0), F.lit(30.0), F.lit(36.0), F.lit("S"))) == -10.51
    assert one(spark, fn.epoch_of_exif(F.lit("2024:01:02 03:04:05"))) == 1704164645 and one(spark, fn.epoch_of_exif(F.lit("x"))) is None
    assert one(spark, fn.media_type(F.lit(".JSON"))) == "application/json"


def test_formats(spark):
    assert [one(spark, fmt.size(F.lit(n))) for n in (None, 0, 1023, 1024, 1536, 5 * 2**40)] == ["0 B", "0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 TB"]
    assert [one(spark, fmt.duration(F.lit(100), F.lit(e))) for e in (None, 159, 160, 3700, 7360)] == ["running", "59s", "1m 0s", "1h 0m", "2h 1m"]
    assert one(spark, fmt.clock(F.lit(3725))) == "1:02:05" and one(spark, fmt.clock(F.lit(65))) == "1:05"
    assert one(spark, fmt.percent(F.lit(3), F.lit(0))) == 0 and one(spark, fmt.percent(F.lit(5), F.lit(4))) == 100
    assert one(spark, fmt.bucket_label(F.lit("2024-03"), "month")) == "MAR 2024" and one(spark, fmt.bucket_label(F.lit("2024-03-09"), "day")) == "09/03/2024"
    assert one(spark, fmt.date(F.lit(0))) == "—" and one(spark, fmt.date_time(F.lit(86400))) == "1970-01-02 00:00"
    assert one(spark, fmt.grid(F.lit("[Sheet: a]\n\nx | y|z"))) == [["[Sheet: a]"], ["x", "y", "z"]]
    assert one(spark, fmt.preview_kind(F.lit(".zip"), F.lit(True))) == "fallback-text"
    assert one(spark, fmt.collapsed(F.lit(" a \n\t b "))) == "a b"


def test_folders(spark):
    f = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 99, "orphan")], "vf_id int, parent_vf_id int, name string")
    m = spark.createDataFrame([(2, 10, 5), (3, 11, 6)], "vf_id int, item_id int, added_ts int")
    assert {(r.vf_id, r.depth, r.path) for r in folders.tree(f).collect()} == {(1, 0, "a"), (2, 1, "a/b"), (3, 2, "a/b/c"), (4, 0, "orphan")}
    left, members = folders.delete(f, m, 2)
    assert {r.vf_id for r in left.collect()} == {1, 4} and members.collect() == []
    with pytest.raises(ValueError):
        folders.update(f, 1, parent=3)
    assert folders.update(f, 2, parent=None).where("vf_id = 2").first().parent_vf_id is None
    assert folders.update(f, 2, name="n").where("vf_id = 2").first()[1:] == (1, "n")
    assert folders.add(m, m.withColumn("added_ts", F.lit(9))).count() == 2 and folders.take_out(m, 2, 10).count() == 1
    assert [(r.vf_id, r.item_count) for r in folders.counts(folders.create(f, 5, "0"), m).collect()] == [(5, 0), (1, 0), (2, 1), (3, 1), (4, 0)]


def test_item_detail_tolerates_bad_json(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id int")
    meta = spark.createDataFrame([(1, '{"gps_lat": 1.5, "model": "m"}', ""), (2, "{bad", None)], "item_id int, meta_json string, camera_model string")
    got = {r.item_id: (r.gps_lat, r.camera) for r in listing.item_detail(items, items.withColumn("text", F.lit("x")), meta).collect()}
    assert got == {1: (1.5, "m"), 2: (None, None), 3: (None, None)}
    assert one(spark, listing.json_map(F.lit('{"k": 1}'))) == {"k": "1"} and one(spark, listing.json_map(F.lit(None).cast("string"))) == {}


def test_duplicate_groups(spark):
    items = spark.createDataFrame([(1, "h", 5, "a", "/a"), (2, "h", None, "b", "/b"), (3, None, 5, "c", "/c"), (4, "g", 1, "d", "/d")], "item_id int, sha256 string, size_bytes bigint, file_name string, full_path string")
    g = dedup.exact_groups(items)
    assert [(r.group_key, r.item_count, r.total_size, r.members) for r in g.collect()] == [("h", 2, 5, [1, 2])]
    members = g.select("group_key", F.explode("members").alias("item_id"))
    assert tuple(dedup.dup_stats(dedup.group_sizes(members, items)).first()) == (1, 5, 0)
    review = dedup.set_review(spark.createDataFrame([], "group_key string, item_id int, review_status string"), "h", 2, "keep")
    top = dedup.listing(members.withColumn("similarity", F.lit(1.0)), items, review).first()
    assert top.primary_id == 1 and [m.review_status for m in top.members] == ["pending", "keep"]


def test_settings_and_answers(spark):
    s = settings.typed({"llm_enabled": "Yes", "port": "x"}, {"llm_top_n_results": "2"})
    assert s["llm_enabled"] is True and s["port"] == 7878 and s["llm_top_n_results"] == 2 and settings.stored({"llm_enabled": True, "no": 1}) == {"llm_enabled": "1"}
    items = spark.createDataFrame(ITEMS, KINDS)
    asked = []
    out = rag.ask(items, "alpha beta", s, lambda system, user: asked.append(user) or "yes")
    assert out["llm"]["answer"] == "yes" and "[1] item_id=1\nfile_name: Report[1].txt\n" in asked[0] and len(out["results"]) == 1
    assert rag.ask(items, "alpha beta", settings.typed({}))["llm"] is None


def test_perceptual_hash(spark):
    a = np.random.default_rng(1).random((32, 32))
    direct = np.array([[sum(a[y, x] * math.cos(math.pi / 32 * (y + 0.5) * u) * math.cos(math.pi / 32 * (x + 0.5) * v) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()[1:]
    want = f"{int(''.join('1' if d > direct.mean() else '0' for d in direct), 2):016x}"
    df = spark.createDataFrame([(a.ravel().tolist(),), (None,), ([1.0, 2.0],)], "p array<double>")
    assert [r.h for r in df.select(phash.phash_matrix("p").alias("h")).collect()] == [want, None, None]


def docx(lines):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines) + "</w:body></w:document>")
    return out.getvalue()


def xlsx(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {n}><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {n}><sheetData>" + "".join("<row>" + "".join(f"<c><v>{c}</v></c>" for c in r) + "</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for name, data in {"a.txt": b"first text of the tree", "A.TXT": b"upper", ".hidden": b"x", ".notes.md": b"notes", "x.tmp": b"x", "node_modules/skip.js": b"x", "sub/b.md": b"first text of the tree", "sub2/c.txt": b"nested", "empty.txt": b"", "bad.txt": b"ok \xff\xfe", "d.docx": docx(["one", " ", "two"]), "e.xlsx": xlsx([[1, 2]] * 600), "broken.docx": b"no zip"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return root


def test_scan_and_extract(spark, tree):
    x = {r.relative: r for r in src.extracted(src.scan(spark, f"file://{tree}", [f"file://{tree}/sub2", f"{tree}x"])).collect()}
    assert set(x) == {"a.txt", "A.TXT", "sub/b.md", "bad.txt", "d.docx", "e.xlsx", "broken.docx"} | ({".notes.md"} & set(x))
    assert x["bad.txt"].text == "ok \ufffd\ufffd" and x["d.docx"].text == "one\ntwo"
    assert x["e.xlsx"].text.count("\n") == 501 and x["e.xlsx"].text.startswith("[Sheet: S1]\n1 | 2") and x["e.xlsx"].metadata["sheets"] == "S1"
    assert x["broken.docx"].text is None and x["broken.docx"].warnings and x["a.txt"].sha256 == hashlib.sha256(b"first text of the tree").hexdigest()


def test_incremental_ingestion(spark, tree, tmp_path):
    store = ingest.Store(spark, f"file://{tmp_path}/store")
    root = f"file://{tree}"
    first = store.merge(src.scan(spark, root), now=1)
    assert first["error_count"] == 1 and first["skipped_count"] == 0
    n = store.current().count()
    again = store.merge(src.scan(spark, root), full_scan=True, now=2)
    assert again == {"indexed_count": 0, "error_count": 0, "skipped_count": n}
    (tree / "a.txt").write_bytes(b"changed text, longer than it was")
    (tree / "sub" / "b.md").unlink()
    third = store.merge(src.scan(spark, root), full_scan=True, now=3)
    assert third["indexed_count"] == 1
    rows = {r.file_name: r for r in store.current().collect()}
    assert rows["a.txt"].text.startswith("changed") and rows["a.txt"].first_seen_ts == 1 and rows["a.txt"].last_indexed_ts == 3
    assert rows["b.md"].is_deleted == 1 and rows["a.txt"].is_deleted == 0 and len(rows) == n


def test_stream_gives_what_a_batch_gives(spark, tree, tmp_path):
    batch, live = ingest.Store(spark, f"file://{tmp_path}/batch"), ingest.Store(spark, f"file://{tmp_path}/live")
    batch.merge(src.scan(spark, f"file://{tree}"), now=1)
    done = []
    ingest.stream(spark, f"file://{tree}", live, f"{tmp_path}/checkpoint", 4, lambda df: done.append(df.count())).awaitTermination()
    pick = lambda s: sorted((r.full_path, r.text, r.simhash64, r.item_id) for r in s.current().collect())
    key = lambda rows: [tuple(map(str, r)) for r in rows]
    assert key(pick(batch)) == key(pick(live)) and len(done) > 1


def test_upsert_fills_and_deletes(spark):
    old = spark.createDataFrame([("a", 1, 5, 0), ("b", 2, 5, 0)], "full_path string, size int, first_seen_ts int, is_deleted int")
    new = spark.createDataFrame([("a", 9, 7, 0), ("c", 3, 7, 0)], old.schema)
    assert {tuple(r) for r in ingest.upsert(old, new).collect()} == {("a", 9, 5, 0), ("b", 2, 5, 0), ("c", 3, 7, 0)}
    assert {r.full_path for r in ingest.soft_delete(old, new).where("is_deleted = 1").collect()} == {"a"}
    assert {r.size for r in ingest.fill(old, spark.createDataFrame([("a", None), ("b", 8)], "full_path string, size int"), "full_path", ["size"]).collect()} == {1, 8}


def test_plans_stay_native(spark):
    df = spark.createDataFrame([(1, "some words that are long enough")], "item_id bigint, text string")
    hashes = text.simhash(df, "item_id", "text").select(F.col("item_id").alias("id"), text.hash_bits(F.col("simhash64")).alias("h"))
    for x in (hashes, dedup.near_pairs(hashes), search.bm25(df, "some words", ["text"])):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan


def test_names_with_other_case_are_passed_over(spark):
    for path, want in (("a/B.TMP", True), ("a/b.tmp", True), (".NOTES.MD", True), (".notes.md", False), ("x.LOCK", True), ("ok/A.TXT", False)):
        assert one(spark, fn.ignored(F.col("p")), p=path) is want, path


def test_folding_knows_all_latin_letters_and_loose_marks(spark):
    tokens = lambda t: one(spark, text.search_tokens(F.col("t")), t=t)
    assert tokens("Ãǎ ŻÓŁW Ệ e\u0301te\u0301 čšž ő straße ﬁ") == ["aa", "zołw", "e", "ete", "csz", "o", "straße", "ﬁ"]


def test_sheets_are_found_by_their_links():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda v: f'<worksheet xmlns="{main}"><sheetData><row><c><v>{v}</v></c></row></sheetData></worksheet>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="A" r:id="r2"/><sheet name="B" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/other/last.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet("one"))
        z.writestr("xl/other/last.xml", sheet("two"))
    assert src.xlsx_text(raw.getvalue())[0] == "[Sheet: A]\ntwo\n[Sheet: B]\none"


def test_audio_lines(spark):
    df = spark.createDataFrame([(1, {"title": "T", "artist": "A", "duration_seconds": "61.5"}), (2, {}), (3, {"album": "", "artist": "B"})], "id int, m map<string,string>")
    assert {r.id: r.x for r in df.select("id", src.audio_line(F.col("m")).alias("x")).collect()} == {1: "T — A — 1:01", 2: None, 3: "B"}


def test_jobs_errors_and_groups_are_kept(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    long = "a text of many words that is long enough to have a hash of its own "
    for name, body in (("a.txt", long), ("b.txt", long), ("c.md", long * 2 + "end"), ("d.docx", "broken")):
        (root / name).write_text(body)
    store = ingest.Store(spark, f"file://{tmp_path}/store")
    groups = {(r.group_type, r.item_id) for r in ingest.ingest(spark, f"file://{root}", store, f"{tmp_path}/check").collect()}
    ids = {r.file_name: r.item_id for r in store.current().collect()}
    assert {("exact", ids["a.txt"]), ("exact", ids["b.txt"]), ("similar_text", ids["a.txt"]), ("similar_text", ids["b.txt"])} <= groups and ids["d.docx"] not in {i for _, i in groups}
    log = store.error_log().collect()
    assert [r.full_path.rsplit("/", 1)[1] for r in log] == ["d.docx"] and log[0].stage == "extract"
    assert [tuple(r) for r in store.table("jobs").select("mode", "indexed_count", "error_count").collect()] == [("incremental", 3, 1)]
    store.merge(src.scan(spark, f"file://{root}").where("file_name <> 'b.txt'"), full_scan=True, job_id="again")
    after = {(r.group_type, r.item_id) for r in store.finish().collect()}
    assert ("exact", ids["b.txt"]) in after, "groups that vanish stay as they were"
    assert store.table("jobs").count() == 2


def test_settings_are_stored_and_normalised(spark, tmp_path):
    t = settings.SettingsTable(spark, f"file://{tmp_path}/settings")
    assert t.all() == {} and t.get("llm_model") == settings.DEFAULTS["llm_model"]
    out = t.put({"llm_provider": " LMStudio ", "llm_base_url": "", "llm_model": " m ", "llm_enabled": True, "llm_top_k": "x"})
    assert (out["llm_provider"], out["llm_base_url"], out["llm_model"], out["llm_top_k"]) == ("lmstudio", settings.OTHER_ADDRESS, "m", 8)
    t.put({"llm_base_url": "http://h/ "})
    assert t.get("llm_base_url") == "http://h" and t.get("llm_provider") == "lmstudio" and t.all()["llm_enabled"] == "1"


def test_folders_keep_their_other_columns(spark):
    f = spark.createDataFrame([(1, None, "a", "red", "x"), (2, 1, "b", None, "y")], "vf_id int, parent_vf_id int, name string, color string, icon string")
    f = folders.create(f, 3, "c", 2, color="blue")
    f = folders.update(folders.update(f, 2, color="green"), 1, icon="z", name="A")
    assert sorted(map(tuple, f.collect())) == [(1, None, "A", "red", "z"), (2, 1, "b", "green", "y"), (3, 2, "c", "blue", None)]


def test_pages_of_text_fall_back_to_the_file(spark):
    df = spark.createDataFrame([(1, "text", b"file", ".txt"), (2, None, b"fi\xffle", ".PY"), (3, "", b"zip", ".zip")], "id int, t string, c binary, e string")
    got = {r.id: r.x for r in df.select("id", src.text_page(F.col("t"), 500, F.col("c"), F.col("e")).alias("x")).collect()}
    assert got == {1: "text", 2: "fi\ufffdle", 3: None}
