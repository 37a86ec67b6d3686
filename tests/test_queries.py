"""Every registered query that SQL can express, against DuckDB on the given tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from cytoquill import queries as own

SF = "/root/testdata/sf0.001"
own.load_all()
ORACLES = own.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (str, bool)):
        return value
    return round(float(value), 5) + 0.0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    assert {f.dataType.simpleString() for f in df.schema} <= {"bigint", "double", "string"}
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert expected, "a query that compares nothing proves nothing"
    assert got == expected


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_contract():
    assert set(ORACLES) <= set(driver.queries())
