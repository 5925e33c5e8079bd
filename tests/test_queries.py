"""Every query with SQL gives the SQL's rows on the smallest tables."""

import decimal

import duckdb
import pytest

from larkspur.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    return "" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.sql(SQL[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = lambda cols, data: sorted(tuple(plain(r[cols.index(n)]) for n in names) for r in data)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall() if hasattr(want, "fetchall") else list(want))
