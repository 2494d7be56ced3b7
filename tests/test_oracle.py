"""Every registered query against its SQL, over whole tables."""

import duckdb
import pytest

from __spark_entry__ import entry
from conftest import DATA
from logloom.plans.oracle import ORACLE
from logloom.plans.queries import registered

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in ["events", "conversations", "labels", "documents"]:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(registered()) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, con, name):
    got = registered()[name](spark, FOLDER)
    want = con.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = got.collect()
    assert rows
    assert sorted_rows(got.columns, rows) == sorted_rows(names, want.fetchall())


def test_entry(spark):
    assert entry(spark).collect()[0]["sessions"] == 396
