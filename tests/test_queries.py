"""Every registered query of the program views against its DuckDB oracle, on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

from chainloom.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame):
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(str([plain(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_registry():
    import __spark_entry__

    found, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(found) and set(QUERIES) <= set(found)
