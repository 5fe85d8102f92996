"""Every query beside its SQL on the smallest tables, and the driver contract."""

import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from corpusloom.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, list | np.ndarray):
        return tuple(map(plain, x))
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    x = x.item() if hasattr(x, "item") else x
    return round(x, 9) if isinstance(x, float) else x


def rows(pdf: pd.DataFrame) -> list:
    return sorted(repr(tuple(map(plain, r))) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_losslessness_and_order_of_encoders(spark):
    assert QUERIES["pretokenize"](spark, DATA).where("not lossless").count() == 0
    assert QUERIES["decode_roundtrip"](spark, DATA).where("not lossless").count() == 0
    assert QUERIES["pack21"](spark, DATA).where("not reversible").count() == 0
    assert QUERIES["minimal_vs_bounded"](spark, DATA).first()["more"] == 0
