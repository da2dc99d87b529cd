"""Every registered query with SQL gives the rows that DuckDB gives; the others run."""

import decimal
import math

import duckdb
import pytest

from sparkweir.plans import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_matches_sql(spark, duck, name):
    query = REGISTRY[name]
    df = query.run(spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    cursor = duck.execute(query.sql)
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    expected = sorted(tuple(plain(r[found.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == expected


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.sql))
def test_runs(spark, name):
    assert REGISTRY[name].run(spark, SF).count() > 0


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(REGISTRY) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
