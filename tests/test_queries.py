"""Every query with a SQL counterpart gives the same rows."""

import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def values(rows):
    clean = lambda x: round(float(x), 6) if isinstance(x, int | float | Decimal) and not isinstance(x, bool) else x
    return sorted(tuple(map(clean, r)) for r in rows) if all(None not in r for r in rows) else sorted((tuple(map(clean, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert values([tuple(r) for r in df.select(*names).collect()]) == values(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
