"""Every query that has SQL, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from agora import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def same(a, b):
    return all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    cursor = duck.execute(catalog.oracle_sql()[name])
    found = [c[0] for c in cursor.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert len(got) == len(want)
    assert all(same(a, b) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, str(DATA)).limit(1).count() == 1


def test_entry():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
