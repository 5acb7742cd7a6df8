"""The pipeline's stages, each against a plain version on its own input."""

import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import catalog, decontaminate, toxicity
from quillspark.llm.common import materialize

from . import brute
from .test_operators import DOCS, frame, toxic_rows

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(1)
    rows, labels = toxic_rows(300)
    items = [(i, " ".join(f"item{i}x{k}" for k in range(25))) for i in range(4)]
    rows = [(d, t + "\nShared line") for d, t in rows]
    rows += [(1000 + i, f"before {t} after") for i, (_, t) in enumerate(items)]
    base = [f"c{k}" for k in range(80)]
    rows += [(2000 + i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(12)]
    rows += [(3000, None), (3001, ""), (3002, "tail " * 3000)]
    rng.shuffle(rows)
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bad = {d for d, y in toxic_rows(300)[1] if y}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, folder).cache()
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == list(corpus_pipeline.COLUMNS) and set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "toxicity":
            assert len(gone & bad) >= 0.9 * len(bad) and not gone - bad
        elif name == "line_dedup":
            assert not gone
            want = {r[0]: r[3] for r in brute.lines(list(before.items()))}
            assert {d: brute.sha(t) for d, t in after.items()} == want
            assert not any("Shared line" in t for t in after.values())
        elif name == "near_dedup":
            assert gone == {d for d, (_, c) in brute.components(list(before.items()), 80).items() if c != d}
            assert gone >= set(range(2001, 2012))
        else:
            assert gone == set(range(1000, 1004))


def test_run_packs_what_is_left(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in out}
    assert {2000, 3000, 3001, 3002} <= ids and not ids & {1000, 2001}
    assert [r["length"] for r in out if r["doc_id"] == 3000] == [1]


def test_a_text_of_many_copies_stays_once(spark):
    """Ten or more exact copies, and near copies with a line of their own."""
    page, story = ("\n".join(f"{name}{k} " + " ".join(f"{name}{k}w{j}" for j in range(12)) for k in range(6)) for name in "ps")
    rows = [(i, f"{page}\n\nShared line") for i in range(12)]
    rows += [(100 + i, f"{story}\nown{i}") for i in range(12)]
    rows += [(200 + i, " ".join(f"d{i}w{k}" for k in range(30)) + "\nShared line") for i in range(12)]
    lines = corpus_pipeline.drop_repeated_lines(spark, frame(spark, rows), "").cache()
    out = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert [out[i] for i in range(12)] == [rows[0][1]] * 12
    assert out[100] == rows[12][1] and [out[100 + i] for i in range(1, 12)] == [f"own{i}" for i in range(1, 12)]
    assert not any("Shared" in out[200 + i] for i in range(12))
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_near_duplicates(spark, lines, "").collect()}
    assert {d: t for d, t in left.items() if d < 100} == {0: rows[0][1]} and left[100] == rows[12][1]


def test_rows_without_id_repeats_and_extra_columns(spark, tmp_path):
    """A row without an id goes for a passage, and as a copy; repeated rows stay
    or go together; further columns change nothing."""
    story, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "st")
    item = " ".join(f"item{k}" for k in range(25))
    rows = [(None, f"x {item} y"), (None, story), (None, story), (5, story), (6, story + " end"), (7, other), (7, other), (None, "alone " * 9), (8, f"z {item}"), (None, None), (None, "")]
    docs = frame(spark, rows).select("*", *(F.lit("clash").alias(c) for c in ("row_key", "node", "band", "component", "sketch", "unit", "item_id")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = materialize(stage(spark, docs, str(tmp_path)), "test")
        docs = left
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr)
    assert kept == sorted([(5, story), (7, other), (7, other), (None, "alone " * 9), (None, ""), (None, "")], key=repr)
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == 6


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id bigint, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_over_whole_tables(spark, name):
    """Registered queries run; where SQL says what they return, it agrees."""
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    if name in catalog.oracle_sql():
        columns = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(map(repr, want))
    elif name.startswith(("op3", "op7")):
        assert len(rows) == len({tuple(r)[:4] for r in rows})
    else:
        assert {r["doc_id"] for r in rows} == {r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()}


@needs_data
@pytest.mark.parametrize("name", ["op2_secret_spans", "op6_fingerprint_runs", "op9_sketch_neardup"])
def test_query_against_brute_force(spark, name):
    """All rows of a whole table, by the plain versions."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall()
    df = catalog.queries()[name](spark, SF)
    if name.startswith("op2"):
        kinds = ("assign", "access", "hex")
        base = {d: brute.secrets(t or "") for d, t in rows}
        want = [(d, *(sum(k == i for _, k, _ in b) for i in range(3)), brute.sha(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in b))) for d, b in base.items()]
        mine = df.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    elif name.startswith("op6"):
        want, mine = brute.substrings(rows), df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    else:
        want = [(d, n, c, d == c) for d, (n, c) in brute.components(rows, 85).items()]
        mine = df.select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, mine)) == sorted(want)


@needs_data
def test_planted_passages_are_found(spark):
    con = duckdb.connect()
    pairs = con.execute(
        f"SELECT doc_id, item_id FROM read_parquet('{SF}/documents.parquet') d, read_parquet('{SF}/benchmark.parquet') b WHERE contains(d.text, b.text)"
    ).fetchall()
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.op7_edit_matches(spark, SF).collect()}
    assert set(pairs) <= found


def test_held_out_fold(spark):
    rows = frame(spark, [(d, "x") for d in range(50)]).select("doc_id", toxicity.held_out().alias("h")).collect()
    assert {r["doc_id"] for r in rows if r["h"]} == {d for d in range(50) if zlib.crc32(str(d).encode()) % 5 == 0}
