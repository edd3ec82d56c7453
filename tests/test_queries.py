"""Every registered query against its SQL."""

import math

import duckdb
import pytest

from talespark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(rows):
    none = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(none(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", [q for q in catalog.QUERIES if q in catalog.ORACLE_SQL])
def test_query_equals_sql(spark, data, duck, name):
    got = catalog.QUERIES[name](spark, data)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    rows = plain(got.select(names).collect())
    assert rows and rows == plain(want.select(*names).fetchall())
