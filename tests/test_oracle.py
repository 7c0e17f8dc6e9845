"""Every query with SQL is compared with DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from wardspan.catalog.oracle import build
from wardspan.catalog.queries import QUERIES

SQL = build()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in os.listdir(sf):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return connection


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(frame.columns)
    out = pd.DataFrame(index=frame.index)
    for c in columns:
        column = frame[c]
        if pd.api.types.is_bool_dtype(column):
            out[c] = column.astype(str)
        elif pd.api.types.is_numeric_dtype(column):
            out[c] = column.astype("float64")
        elif pd.api.types.is_datetime64_any_dtype(column):
            out[c] = column.astype("datetime64[us]").astype(str)
        else:
            out[c] = column.astype(object).where(column.notna(), None).map(lambda v: v if v is None else str(v))
    return out.sort_values(columns).reset_index(drop=True)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    found, expected = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    found, expected = normal(found), normal(expected)
    assert len(found) > 0
    for column in found.columns:
        if found[column].dtype != expected[column].dtype:  # a column of nulls only
            found[column], expected[column] = found[column].astype("float64"), expected[column].astype("float64")
    pd.testing.assert_frame_equal(found, expected, check_exact=False, rtol=0, atol=1.01e-6)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
