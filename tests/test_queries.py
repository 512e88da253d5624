"""Every named query of the library's own operators against its SQL."""

import duckdb
import pytest

import __spark_entry__ as driver
from textwarden.plans import oracle, oracle_variants
from textwarden.plans.queries import REGISTRY

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES, SQL = REGISTRY, oracle.all_sql() | oracle_variants.all_sql()


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


def cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, str):
        return value
    return f"{float(value):.6g}"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, data, name):
    result = QUERIES[name](spark, data)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    got = sorted(tuple(cell(v) for v in row) for row in result.select(*[f"`{c}`" for c in columns]).collect())
    assert got == sorted(tuple(cell(v) for v in row) for row in cursor.fetchall())


def test_every_query_has_sql_except_trained_models():
    assert set(QUERIES) - set(SQL) == {"model_report", "model_cross_validation"}
    assert set(SQL) <= set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


def test_flagship(spark):
    assert driver.entry(spark).count() == 6
