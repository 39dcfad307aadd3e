"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import numpy as np
import pytest

from stationflow.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    plain = lambda x: round(float(x), 5) + 0.0 if isinstance(x, (float, np.floating)) else int(x) if isinstance(x, (int, np.integer)) and not isinstance(x, bool) else x
    return sorted((tuple(plain(x) for x in r) for r in frame.values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
