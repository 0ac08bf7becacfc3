"""Every query with an SQL statement against DuckDB over the smallest tables."""

import duckdb
import pytest

from pagemend import oracles, queries

TABLES = "documents pages benchmark conversations events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_equals_sql(spark, duck, sf, name):
    got = queries.queries()[name](spark, sf)
    names = sorted(got.columns)
    want = duck.execute(oracles.SQL[name])
    assert sorted(d[0] for d in want.description) == names
    order = [[d[0] for d in want.description].index(n) for n in names]
    assert plain(got.select(*names).collect()) == plain([[row[i] for i in order] for row in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(queries.NAMES) - set(oracles.SQL)))
def test_runs(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
