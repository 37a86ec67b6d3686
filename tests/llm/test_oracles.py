"""Registered queries with SQL, against DuckDB on the given tables."""

import glob
import os

import duckdb
import pytest

from cytoquill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SF)
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=repr) == expected
