"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from engram.plans import all_oracles, all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.number)):
        return f"{float(x):.5f}"
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_same_rows(name, spark, sf, duck):
    got, want = all_queries()[name](spark, sf).toPandas(), duck.sql(all_oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_runs(name, spark, sf):
    all_queries()[name](spark, sf).collect()
