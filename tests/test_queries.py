"""Every query against its SQL counterpart, over whole small tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from auditloom.plans import oracle, registry
from auditloom.plans.views import TABLES

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
ORACLE = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def shaped(rows, columns):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    fmt = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    return sorted(tuple(fmt(row[i]) for i in at) for row in rows)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert shaped(df.collect(), df.columns) == shaped(result.fetchall(), columns)


def test_flagship(spark):
    assert contract.entry(spark).count() > 0
