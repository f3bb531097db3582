"""Every registered query with SQL agrees with it on whole tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

from .conftest import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def normal(frame: pd.DataFrame):
    names = sorted(frame.columns)
    rows = [
        tuple(None if pd.isna(v) else v if isinstance(v, str) else float(v) for v in row)
        for row in frame[names].astype(object).itertuples(index=False)
    ]
    return names, sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = normal(entry.queries()[name](spark, SMALL).toPandas())
    assert found[1]
    assert found == normal(duck.execute(entry.oracle_sql()[name]).df())


def test_flagship(spark):
    assert entry.entry(spark).count() > 4000
