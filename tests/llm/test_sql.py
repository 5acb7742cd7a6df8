"""The registered queries against their SQL over a table."""

import os

import duckdb
import pytest

from quillspark.llm import catalog

from .test_operators import got
from .test_pipeline import SF, needs_data


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = tables.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert got(df, *columns) == sorted(rows, key=repr)


@needs_data
def test_some_host_is_condemned(tables):
    """And its documents go that fail the stricter rules alone."""
    gone = tables.execute(f"SELECT count(*) FROM ({catalog.oracle_sql()['quality_by_ending']}) WHERE host_condemned AND NOT kept AND NOT base_failed").fetchone()[0]
    assert gone > 0
