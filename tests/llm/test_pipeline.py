import corpus_pipeline as cp
import pytest
from docquarry.llm import bpe, decontamination, jaccard_join, language_id
from docquarry.llm.common import tokenizer_path
from pyspark.sql import functions as F

from . import test_jaccard_join as tj
from . import test_line_dedup as tl
from .conftest import documents
from .test_language_id import DE, EN, text

ITEM = "what unusual vegetable grows beneath the frozen lake each winter before sunrise. certainly the purple turnip."


def rows():
    out = [(i, text(EN if i % 2 else DE, 300 + i, 30), "en" if i % 2 else "de") for i in range(120)]
    out += [(200, None, "en"), (201, "12 34 %%", None), (202, out[3][1], "en"), (203, out[5][1].rsplit(" ", 1)[0] + " extra", "en"), (204, text(EN, 9) + " " + ITEM + " " + text(EN, 8), "en")]
    return [*out, (205, text(EN, 700, 2000), None), (206, out[7][1] + "\n" + text(EN, 701), "en"), (207, out[8][1] + "\n" + out[9][1], "en"), (208, "", "en")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    documents(spark, rows()).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = cp.identify_language(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = {r.doc_id: r for r in kept.collect()}
    assert set(ids) == {i for i, *_ in rows()} - {200, 201, 208} and ids[205].lang == "en" and ids[204].text == rows()[124][1]
    own = [(r.doc_id, r.text) for r in sorted(ids.values())]
    lines = cp.dedup_lines(spark, kept, folder)
    want = {i: t for i, t in tl.brute(own).items() if t.strip() or dict(own)[i] == t}
    got = {r.doc_id: r for r in lines.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values()) and lines.columns == docs.columns
    assert 202 not in got and 207 not in got and got[206].text == rows()[126][1].split("\n")[1]
    copies = cp.one_of_near_copies(spark, lines, folder)
    groups = tj.brute([(i, r.text) for i, r in got.items()])
    assert {r.doc_id for r in copies.collect()} == {i for i, _, c in groups if i == c}
    clean = cp.decontaminate(spark, copies, folder)
    assert {r.doc_id for r in copies.collect()} - {r.doc_id for r in clean.collect()} == {204}
    assert clean.columns == docs.columns
    e = bpe.encoder(tokenizer_path(bpe.RANKS))
    assert {r.doc_id: r.n_tokens for r in cp.encode(spark, clean, folder).collect()} == {r.doc_id: len(e.encode(r.text)) for r in clean.collect()}


def test_run_applies_the_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(tuple, cp.run(spark, folder).collect())) == sorted(map(tuple, docs.collect()))


def test_an_empty_corpus(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
    assert decontamination and jaccard_join and language_id


def test_columns_with_the_operators_own_names_and_nulls_in_any(spark, folder, tmp_path):
    mine = ("n_lines", "n_dropped", "_mark", "_gone", "n", "x", "a", "b", "bits", "part", "token", "component_id", "score", "lang_pred", "item_id", "ids")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id in (1, 3, 204)").withColumn("doc_id", F.lit(None).cast("bigint"))).unionByName(docs.where("doc_id = 9").selectExpr("doc_id", "text", "null lang", "null source", "null n_chars"))
    for c in mine:
        docs = docs.withColumn(c, F.lit("mine"))
    for name, stage in cp.STAGES[:-1]:
        new = stage(spark, docs, folder)
        assert new.columns == docs.columns, name
        new.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        assert rows and all(r[c] == "mine" for r in rows for c in mine), name
    assert not any(ITEM[:40] in (r.text or "") for r in rows)
    assert cp.encode(spark, docs, folder).count() == len(rows)


def test_each_stage_begins_with_a_small_heap(spark, folder):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in cp.STAGES:
        before = full()
        stage(spark, docs, folder)
        assert full() > before, name
