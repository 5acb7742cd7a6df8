"""The jobs: growing input, repeated runs, failures, settings, the command line."""

import json
import os
import subprocess
import sys
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from jobs import answer_questions, catalog, common, ingest_chunks
from quillspark.operators import chunking

from .conftest import ROOT

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string"


def prose(d, n=30):
    return " ".join(f"Sentence {i} of document {d} says that river number {i * d % 17} is {i * 3} miles long." for i in range(n))


def add(spark, rows, path, parts=1):
    spark.createDataFrame(rows, DOCS).repartition(parts).write.mode("append").parquet(path)


def stored(spark, path):
    rows = spark.read.parquet(path)
    return sorted(tuple(r) for r in rows.select(sorted(rows.columns)).collect())


@pytest.fixture
def at(tmp_path):
    return SimpleNamespace(input=str(tmp_path / "in"), output=str(tmp_path / "out"), checkpoint=str(tmp_path / "check"))


def chunks_of(spark, rows):
    """The batch chunker's result, document by document."""
    pages = spark.createDataFrame(rows, DOCS).select("doc_id", F.lit(1).alias("page_number"), "text")
    return {(r["doc_id"], r["chunk_id"], r["content"]) for r in chunking.chunk_pages(pages, "sentences").collect()}


def test_ingest_takes_only_what_is_new(spark, at):
    first = [(1, prose(1), "en"), (2, None, "en"), (3, "", None), (4, prose(4, 200), "en"), (None, prose(5), None)]
    add(spark, first, at.input, 3)
    run = lambda **more: ingest_chunks.run(spark, **vars(at), **more)
    counts = run(max_files=1)
    found = stored(spark, at.output)
    assert counts["documents"] == 5 and counts["chunks"] == len(found) > 10
    assert {(r["doc_id"], r["chunk_id"], r["content"]) for r in spark.read.parquet(at.output).collect()} == chunks_of(spark, first)
    assert run() == {"documents": 0, "chunks": 0, "characters": 0} and stored(spark, at.output) == found

    # New documents, one that is delivered again, and one that has grown.
    grown = prose(1) + " One more sentence about the sea, which is long enough to make a chunk of its own, as it goes on and on and on and on."
    add(spark, [(6, prose(6), "de"), (4, prose(4, 200), "en"), (1, grown, "en")], at.input)
    counts = run()
    assert counts["documents"] == 3
    after = stored(spark, at.output)
    assert set(found) < set(after) and counts["chunks"] == len(after) - len(found)
    added = {(r["doc_id"], r["content"]) for r in spark.read.parquet(at.output).collect()} - {(d, c) for d, _, c in chunks_of(spark, first)}
    assert added == {(d, c) for d, _, c in chunks_of(spark, [(6, prose(6), "de"), (1, grown, "en")])} - {(d, c) for d, _, c in chunks_of(spark, first)}
    assert {d for d, _ in added} == {1, 6}
    assert [p for p in os.listdir(at.output) if p.startswith("language=")] and run()["chunks"] == 0


def test_ingest_goes_on_after_a_failure(spark, at, monkeypatch):
    add(spark, [(1, prose(1), "en")], at.input)
    ingest_chunks.run(spark, **vars(at))
    add(spark, [(2, prose(2), "en")], at.input)
    fail = F.udf(lambda t: 1 // 0, "string")
    whole = chunking.sentence_chunks
    with monkeypatch.context() as broken:
        broken.setitem(chunking.STRATEGIES, "sentences", lambda text, *more: whole(fail(text), *more))
        with pytest.raises(StreamingQueryException):
            ingest_chunks.run(spark, **vars(at))
    assert {r[0] for r in spark.read.parquet(at.output).select("doc_id").collect()} == {1}
    assert ingest_chunks.run(spark, **vars(at))["documents"] == 1
    got = {(r["doc_id"], r["chunk_id"], r["content"]) for r in spark.read.parquet(at.output).collect()}
    assert got == chunks_of(spark, [(1, prose(1), "en"), (2, prose(2), "en")])


def test_ingest_of_an_empty_table_and_of_repeats(spark, at):
    add(spark, [], at.input)
    assert ingest_chunks.run(spark, **vars(at))["chunks"] == 0
    twice = "The same long sentence about nothing in particular, with more than a hundred characters in it, is said again and again here. "
    add(spark, [(1, twice * 12, "en"), (1, twice * 12, "en")], at.input)
    ingest_chunks.run(spark, **vars(at))
    contents = [r[0] for r in spark.read.parquet(at.output).select("content").collect()]
    assert len(contents) == len(set(contents)) > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_both_jobs_on_growing_copies_of_the_tables(spark, tmp_path, at):
    """Two runs, on a part of the documents and then on the rest too; the output
    is then that of the SQL over the whole tables."""
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.where("doc_id % 3 = 0").write.parquet(at.input)
    first = ingest_chunks.run(spark, **vars(at), max_files=2, spread=3)
    docs.where("doc_id % 3 > 0").write.mode("append").parquet(at.input)
    second = ingest_chunks.run(spark, **vars(at), max_files=2, spread=3)
    assert first["documents"] + second["documents"] == docs.count() and min(first["chunks"], second["chunks"]) > 0
    columns = ["doc_id", "chunk_id", "language", "content_type", "char_count", "content"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()['job1_ingest_chunks']})").fetchall()
    assert sorted(tuple(r) for r in spark.read.parquet(at.output).select(*columns).collect()) == sorted(want)

    questions, out = str(tmp_path / "questions"), str(tmp_path / "answers")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet")
    asked.where("item_id % 2 = 0").write.parquet(questions)
    few = answer_questions.run(spark, questions, at.input, out)
    asked.where("item_id % 2 = 1").write.mode("append").parquet(questions)
    all_ = answer_questions.run(spark, questions, at.input, out)
    assert few["answers"] < all_["answers"] == asked.count()
    columns = ["query_id", "question", "answer", "model_used", "confidence", "groundedness", "question_type"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()['job2_answer_questions']})").fetchall()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/answers").select(*columns).collect()) == sorted(want)


def test_settings_are_restored(spark, at):
    key, other = "spark.sql.streaming.numRecentProgressUpdates", "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key, None), spark.conf.get(other, None)
    with pytest.raises(RuntimeError), common.settings(spark, {key: "7", other: "1m"}):
        assert spark.conf.get(key) == "7"
        raise RuntimeError
    assert (spark.conf.get(key, None), spark.conf.get(other, None)) == before




def question_tables(spark, tmp_path):
    texts = ["The red heron nests by the northern river in spring.", "Copper kettles boil quickly over an open fire.", None, ""]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, question string").write.parquet(f"{tmp_path}/documents")
    items = [(3, "How do copper kettles boil?"), (7, "Where does the red heron nest?"), (8, "ØÆÅ"), (9, ""), (10, None), (11, "x" * 1001)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/questions")
    return {"questions": f"{tmp_path}/questions", "documents": f"{tmp_path}/documents", "output": f"{tmp_path}/out"}


def test_answers_again_with_the_same_result(spark, tmp_path):
    paths = question_tables(spark, tmp_path)
    counts = answer_questions.run(spark, **paths)
    assert counts == {"questions": 6, "documents": 4, "answers": 3, "unanswered": 1}
    tables = {t: stored(spark, f"{paths['output']}/{t}") for t in ("answers", "sources", "by_type")}
    rows = {r["query_id"]: r for r in spark.read.parquet(f"{paths['output']}/answers").collect()}
    assert set(rows) == {3, 7, 8} and rows[8]["model_used"] == "none" and rows[8]["n_sources"] == 0
    assert rows[3]["sources"][0]["chunk_id"] == "1" and rows[7]["sources"][0]["content"].startswith("The red heron") and rows[3]["groundedness"] > 0.5
    assert spark.read.parquet(f"{paths['output']}/sources").where("rank = 1").count() == 2
    assert sum(r["n"] for r in spark.read.parquet(f"{paths['output']}/by_type").collect()) == 3
    assert answer_questions.run(spark, **paths) == counts
    assert {t: stored(spark, f"{paths['output']}/{t}") for t in tables} == tables
    # Fewer questions: what a larger run wrote is gone, also under dynamic overwrite.
    spark.createDataFrame([(3, "How do copper kettles boil?")], "item_id bigint, text string").write.mode("overwrite").parquet(paths["questions"])
    with common.settings(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        answer_questions.run(spark, **paths)
    assert [r[0] for r in spark.read.parquet(f"{paths['output']}/answers").select("query_id").collect()] == [3]


@pytest.mark.parametrize("job", ["ingest_chunks", "answer_questions"])
def test_command_line(spark, tmp_path, job):
    paths = question_tables(spark, tmp_path) if job == "answer_questions" else {"input": f"{tmp_path}/in", "output": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/check"}
    if job == "ingest_chunks":
        add(spark, [(1, prose(1), "en")], paths["input"])
    with open(f"{ROOT}/jobs/{job}.json") as f:
        config = json.load(f)
    (tmp_path / "config.json").write_text(json.dumps(config | {k: v for k, v in paths.items() if k != "output"}))
    command = [sys.executable, "-m", f"jobs.{job}", "--config", f"{tmp_path}/config.json", "--output", paths["output"]]
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_SUBMIT_OPTS": f"-Dspark.master=local[2] -Dspark.sql.shuffle.partitions=2 -Dspark.ui.enabled=false -Dspark.sql.warehouse.dir={tmp_path}"}
    done = subprocess.run(command, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 1 documents, wrote" in done.stderr or "read 6 questions and 4 documents, wrote 3 answers" in done.stderr
    assert stored(spark, paths["output"] if job == "ingest_chunks" else f"{paths['output']}/answers")
    (tmp_path / "wrong.json").write_text('{"inputs": 1}')
    wrong = subprocess.run([*command[:4], f"{tmp_path}/wrong.json"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert wrong.returncode == 2 and "unknown keys" in wrong.stderr
