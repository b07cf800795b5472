import math

import duckdb
import pytest

from tidewell.plans import attempts, catalog, records

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalog.QUERIES.items() if f.__module__ in (records.__name__, attempts.__name__) and n in catalog.ORACLES]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_against_its_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, FOLDER), con.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    rows = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == rows and rows
