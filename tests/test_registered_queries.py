"""Every registered query against its SQL on the smallest tables."""

import math
import pathlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points

DATA = pathlib.Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return ""
        return repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_equal_to_sql(spark, duck, name):
    ours = entry_points.queries()[name](spark, str(DATA)).toPandas()
    theirs = duck.execute(entry_points.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    for c in theirs.columns:
        if isinstance(theirs[c].dtype, pd.Int64Dtype):  # whole numbers with nulls, which are floats in the other frame
            ours[c] = ours[c].astype("Int64")
    assert rows(ours) == rows(theirs) and len(ours) > 0


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(entry_points.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert entry_points.queries()[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["source_file", "text", "class", "count"] and frame.count() > 0
