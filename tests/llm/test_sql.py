"""Queries with SQL, over the supplied tables and over some with odd rows."""

import os

import duckdb
import pytest
from docquarry.llm import jaccard_join, warc
from docquarry.llm import queries as q

from .conftest import documents

SF = "/root/testdata/sf0.001"


def rows(r):
    return sorted(map(str, r))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    df, c = q.queries()[name](spark, SF), duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = c.sql(q.oracle_sql()[name])
    assert sorted(r.columns) == sorted(df.columns)
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string"}
    assert {n: kinds[str(t)] for n, t in zip(r.columns, r.types)} == dict(df.dtypes)
    assert rows(r.select(", ".join(df.columns)).fetchall()) == rows(map(tuple, df.collect()))


def test_sql_of_odd_rows(spark):
    line = "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf"
    texts = [(1, line), (2, line.upper()), (3, line + " x"), (4, ""), (5, None), (6, "a b"), (7, "A\tb\x0b"), (8, " \n"), (9, line + " " + line), (10, "a b c")]
    documents_ = documents(spark, texts)
    c = duckdb.connect()
    c.register("documents", documents_.toPandas())
    df = jaccard_join.similar_groups(documents_)
    assert rows(c.sql(jaccard_join.OP8_SQL).select(", ".join(df.columns)).fetchall()) == rows(map(tuple, df.collect()))
    pages = spark.createDataFrame([(3, "http://a.b/x", "<p>ü</p>"), (1, "http://a.b/y", "<p>ü</p>"), (2, None, None), (5, "http://c/", ""), (4, "http://a.b/x", "z" * 5000)], "page_id bigint, url string, html string")
    c.register("pages", pages.toPandas())
    df = warc.archive_round_trip(pages, 0)
    assert df.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = [tuple(r)[:5] for r in df.collect()]
    assert rows(c.sql(warc.OP1_SQL).select("page_id, payload_bytes, payload_digest, record_type, refers_to").fetchall()) == rows(got)
