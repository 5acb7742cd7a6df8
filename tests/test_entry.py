"""The entry module, with and without the optional subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from jobs import catalog as job_catalog
from quillspark.plans import catalog

from .conftest import ROOT

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_subpackage(tmp_path):
    """A copy of the repository without the optional parts still imports."""
    code = (
        "import sys, shutil, os\n"
        f"shutil.copytree({ROOT!r} + '/quillspark', 'quillspark', ignore=shutil.ignore_patterns('llm', '__pycache__'))\n"
        f"shutil.copytree({ROOT!r} + '/jobs', 'jobs')\n"
        f"shutil.copy({ROOT!r} + '/__spark_entry__.py', '.')\n"
        "sys.path.insert(0, os.getcwd())\n"
        "import __spark_entry__ as e\n"
        "assert 'topk_cosine' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=env)


@needs_data
def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql() | job_catalog.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    got = (catalog.queries() | job_catalog.queries())[name](spark, SF)
    columns = sorted(got.columns)
    want = tables.execute(f"SELECT {', '.join(columns)} FROM ({(catalog.oracle_sql() | job_catalog.oracle_sql())[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))
