"""The operators' queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from spanveil.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return c


def plain(df):
    def value(x):
        return None if x is None or x != x else round(float(x), 6) if isinstance(x, (float, np.floating)) else int(x) if isinstance(x, (int, np.integer, np.bool_)) else str(x)

    return sorted(([value(x) for x in r] for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert plain(got) == plain(want)
