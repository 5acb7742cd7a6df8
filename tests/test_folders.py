"""Tables of a session go when it has ended."""

import os
import subprocess
import sys

from quillspark.sources import folders

from .conftest import ROOT

CODE = """
import os, sys
from pyspark.sql import SparkSession
from quillspark.sources.folders import session_folder

def session():
    return SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()

for label in ("first", "second"):
    spark = session()
    spark.range(3).write.parquet(session_folder(spark, label))
    spark.range(3).write.parquet(session_folder(spark, "kept-" + label, keep=True))
    print("THERE", sorted(x.rpartition("-")[0] for x in os.listdir(sys.argv[1] + "/quillspark")))
    spark.stop()
"""


def test_tables_go_after_their_session(tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    there = [x for x in done.stdout.split("\n") if x.startswith("THERE")]
    assert there == ["THERE ['first', 'kept-first']", "THERE ['kept-first', 'kept-second', 'second']"]
    assert sorted(x.rpartition("-")[0] for x in os.listdir(tmp_path / "quillspark")) == ["kept-first", "kept-second"]


def test_folders_are_new_and_shared(spark):
    a, b = folders.session_folder(spark, "x"), folders.session_folder(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))
