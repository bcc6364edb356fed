"""Every registered query against its SQL, as the driver checks them, at the smallest scale."""

import math
import os

import pytest

import __spark_entry__ as contract
from stintworks.fixtures.registry import QUERIES

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF_DIR):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def comparable(rows, columns, wanted):
    places = [columns.index(c) for c in wanted]

    def cell(v):
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in places) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = contract.queries()[name](spark, SF_DIR)
    rows = frame.collect()
    sql = contract.oracle_sql().get(name)
    assert sql, f"{name} has no SQL"
    expected = duck.execute(sql)
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(frame.columns)
    wanted = sorted(columns)
    assert comparable(rows, frame.columns, wanted) == comparable(expected.fetchall(), columns, wanted)


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
