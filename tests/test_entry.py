from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from engramic import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return str(x)[:19]


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"query_id", "id", "similarity", "rank"} == set(df.columns)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_against_sql(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((norm([dict(zip(names, r, strict=True))[c] for c in sorted(names)]) for r in rel.fetchall()), key=str)
    got = sorted((norm([r[c] for c in sorted(names)]) for r in rows), key=str)
    assert got == want
