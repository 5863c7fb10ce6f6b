"""Every query against its SQL on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

from plait import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v) if not isinstance(v, dt.date) else v.isoformat()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    a = sorted(tuple(norm(r[c]) for c in cols) for r in got.collect())
    b = sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
