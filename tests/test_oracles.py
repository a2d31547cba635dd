"""Every registered query against its SQL, on the smallest test data."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from fixtures.oracles import oracle_sql
from fixtures.queries import queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["events", "customer", "part", "supplier", "conversations"]
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_oracle(spark, duck, name):
    made = queries()[name](spark, SF_DIR)
    columns = sorted(made.columns)
    result = duck.execute(oracle_sql()[name])
    described = {column[0]: str(column[1]) for column in result.description}
    positions = [list(described).index(column) for column in columns]
    expected = _bag([tuple(row[i] for i in positions) for row in result.fetchall()])
    assert sorted(described) == columns
    assert {c: TYPES[kind] for c, kind in made.dtypes} == described
    assert _bag([tuple(row[c] for c in columns) for row in made.collect()]) == expected


def _bag(rows: list[tuple]) -> list[tuple]:
    clean = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row) for row in rows]
    return sorted(clean, key=lambda row: [(v is None, str(v)) for v in row])
