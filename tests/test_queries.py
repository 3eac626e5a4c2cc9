"""Every registered query of the library against its SQL, in DuckDB, on the smallest tables."""

import duckdb
import pytest

from readloom.plans.catalog import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = queries()[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(oracle_sql()[name])
    assert sorted(want.columns) == names
    assert shown(got.select(*names).collect()) == shown(want.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall())
