"""Every registered query of the library runs; those with SQL equal DuckDB's rows."""

import math

import duckdb
import pytest

from calltriage.plans import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(value(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    res = duck.execute(SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = [tuple(value(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order) for r in res.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
