"""Every registered query against its DuckDB SQL on the smallest data folder."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from harness.oracle import ORACLE
from harness.queries import bound_queries
from tests.conftest import SF_TINY

QUERIES, SQL = bound_queries(), ORACLE
DUCKDB_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_TINY):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_TINY}/{file}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df, relation = QUERIES[name](spark, SF_TINY), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert {c: DUCKDB_TYPES[t] for c, t in df.dtypes} == dict(zip(relation.columns, map(str, relation.types), strict=True))
    order = [relation.columns.index(c) for c in columns]
    expected = sorted((tuple(row[i] for i in order) for row in relation.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == expected
    # pmpm tables and checks are never empty, and nothing here should be at this size either.
    assert got or name in ("pc_facility_split", "facility_semi_join")
