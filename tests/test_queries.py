"""Every query against its SQL, as the driver compares them."""

import os

import duckdb
import pytest
from docquarry import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: (x is not None, type(x).__name__ if not isinstance(x, int | float) else "n", str(x))
    return sorted(tuple(cell(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float", "HUGEINT": "decimal(38,0)"}


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in q.SQL:
        assert rows
        return
    r = duck.sql(q.SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    types = dict(zip(r.columns, map(str, r.types)))
    assert {c: KINDS.get(t, t) for c, t in types.items()} == dict(df.dtypes)
    want = r.fetchall()
    assert want, "an empty result shows nothing"
    assert normal([tuple(x) for x in rows], df.columns) == normal(want, r.columns)
