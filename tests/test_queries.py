"""Every query that has an SQL twin gives the twin's rows."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from motifspark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list:
    plain = [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)]
    return sorted(plain, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_twin(spark, duck, sf, name):
    got, want = plans.QUERIES[name](spark, sf).toPandas(), duck.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["sk", "n_steps", "log_lik"]
