"""Every registered query against its SQL, over whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TRAINING_DATA = contract._training_data()[0]  # tested beside their operators
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    return con


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        values = []
        for i in order:
            v = row[i]
            if isinstance(v, float):
                v = None if math.isnan(v) else round(v, 9)
            values.append(v)
        out.append(tuple(values))
    return sorted(out, key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(TRAINING_DATA)))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert _canonical(df.columns, rows) == _canonical(columns, cursor.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
