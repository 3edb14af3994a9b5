"""Every registered query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from compare import TABLES, rows
from quillon import catalogue

NAMES = sorted(catalogue.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, got) == rows(cols, res.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(NAMES)))
def test_runs_without_sql(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
