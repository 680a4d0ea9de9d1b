"""Every query against its SQL on the smallest tables, and that every query runs and has a stable schema."""

import glob
import importlib
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

CORE = {n: q for m in entry._PLANS if importlib.util.find_spec(f"busweave.plans.{m}") for n, q in importlib.import_module(f"busweave.plans.{m}").QUERIES.items()}


def _plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
                cells.append(None)
            elif isinstance(v, (bool, np.bool_)):
                cells.append(bool(v))
            elif isinstance(v, (int, float, np.integer, np.floating)):
                cells.append(round(float(v), 4))
            elif hasattr(v, "year"):
                cells.append(str(pd.Timestamp(v)))
            else:
                cells.append(v)
        out.append(tuple(cells))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        source = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{source}')")
    return con


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sf_dir, duck, name):
    got = CORE[name](spark, sf_dir)
    assert got.columns
    got = got.toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert len(got) == len(want)
        for a, b in zip(_plain(got), _plain(want)):
            assert len(a) == len(b)
            for x, y in zip(a, b):
                assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-3 + 1e-9 * abs(y)), (a, b)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
