"""The engine end to end, memory, sources and the stream."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import memory
from quillspark.plans.engine import Config, Engine
from quillspark.sources import files
from quillspark.streaming.ingest import ingest_pages

PAGES = "doc_id bigint, page_number int, text string"
TEXT = "The river carries cold water down to the sea. " * 6


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, Config(strategy="sentences", threshold=0.0))
    e.build(spark.createDataFrame([(1, 1, TEXT), (2, 1, "Seven foxes ran over the green hill at night. " * 6)], PAGES))
    return e


def test_ask(engine):
    got = engine.ask("where does the river carry water?")
    assert "river" in got["context"] and got["answer"] and 0 < got["confidence"] <= 1
    assert got["query_language"] == "en" and got["model_used"] == "extractive"
    with pytest.raises(ValueError):
        engine.ask("")
    with pytest.raises(ValueError):
        engine.ask("x", max_chunks=21)


def test_nothing_found(engine):
    got = engine.ask("zzz qqq", threshold=1.0)
    assert (got["model_used"], got["confidence"], got["context"]) == ("none", 0.0, "")


def test_conversation(engine):
    got = engine.ask("where does the river carry water?", conv_id=9)
    assert [(r["conv_id"], r["answer"]) for r in engine.history().collect()] == [(9, got["answer"])]
    again = engine.ask("and then?", conv_id=9)
    assert "Human: where does the river" in again["memory"] and got["answer"] in again["prompt"]
    engine.ask("zzz qqq", conv_id=9, threshold=1.0)
    assert engine.history().count() == 2
    engine.clear_memory()


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text('{"chunk_size": 300, "metric": "l2"}')
    monkeypatch.setenv("QUILL_METRIC", "ip")
    monkeypatch.setenv("QUILL_MAX_CHUNKS", "7")
    config = Config.load(str(tmp_path / "c.json"))
    assert (config.chunk_size, config.metric, config.max_chunks, config.threshold) == (300, "ip", 7, 0.3)


def test_memory(engine):
    engine.remember(5, "q1", "a1")
    engine.remember(5, "q2", "a2")
    assert [(r["question"], r["answer"]) for r in engine.history().orderBy("pair").collect()] == [("q1", "a1"), ("q2", "a2")]
    text = memory.recent_memory(engine.turns, 3).first()["memory"]
    assert text == "\n\nRecent conversation:\nAssistant: a1\nHuman: q2\nAssistant: a2"
    assert engine.health()["status"] == "healthy" and engine.history().count() == 2
    engine.clear_memory()
    assert engine.history().count() == 0


def test_save_and_load(spark, engine, tmp_path):
    engine.save(str(tmp_path / "s"))
    other = Engine(spark)
    assert not other.load(str(tmp_path / "none")) and other.stats()["total_vectors"] == 0
    assert other.load(str(tmp_path / "s")) and other.stats()["total_vectors"] == engine.stats()["total_vectors"] > 0


def test_evaluate(spark, engine):
    cases = spark.createDataFrame([("c1", "where does the river go", "to the sea"), ("c2", "what ran", "foxes")], "id string, question string, answer string")
    rows, summary = engine.evaluate(cases)
    assert rows.count() == 2 and summary.first()["total_questions"] == 2
    assert "total_questions: 2" in files.report(summary)


def test_similarity_is_the_cosine_of_an_embedder(spark, engine):
    from quillspark.operators import embedding, evaluation

    rows = spark.createDataFrame([(1, "q", "night owls", "owls at night", "c"), (2, "q", "", "x", "c")], "id int, question string, answer string, truth string, context string")
    got = {r["id"]: r["semantic_similarity"] for r in evaluation.evaluate(rows, embedder=engine.embedder).collect()}
    a, b = embedding.HashingEmbedder().encode(["passage: night owls", "passage: owls at night"])
    assert abs(got[1] - a @ b) < 1e-6 and got[2] == 0
    cases = spark.createDataFrame([("c1", "where does the river go", "to the sea")], "id string, question string, answer string")
    r = engine.evaluate(cases)[0].first()
    a, b = engine.embedder.encode([f"passage: {r['answer']}", f"passage: {r['truth']}"])
    assert abs(r["semantic_similarity"] - a @ b) < 1e-6


class Failing:
    """Fails on batches, and always on one question."""

    name = "failing"

    def generate(self, questions, contexts, prompts):
        if len(questions) > 1 or "foxes" in questions[0]:
            raise RuntimeError("out of memory")
        return ["an answer"]


def test_a_failing_prompt_is_one_error_row(spark, engine):
    other = Engine(spark, engine.config, generator=Failing())
    other.store = engine.store
    asked = spark.createDataFrame([(1, "where is the river"), (2, "what of the foxes"), (3, "when is night")], "query_id bigint, question string").coalesce(1)
    got = {r["query_id"]: (r["answer"], r["model_used"], r["confidence"] > 0) for r in other.ask_batch(asked).collect()}
    assert got[1] == got[3] == ("an answer", "failing", True) and got[2][1:] == ("error", False)
    assert other.ask("what of the foxes", conv_id=3)["model_used"] == "error" and other.history().count() == 0


def test_the_store_is_written_once(spark, engine, tmp_path):
    """Numbers stay with their chunks, whatever is read; the store can be built
    anew, from a bundle, and cleared."""
    plan = engine.store._jdf.queryExecution().toString()
    assert "Python" not in plan and "Generate" not in plan
    assert sorted(r["pos"] for r in engine.store.select("pos").collect()) == list(range(engine.store.count()))
    other = Engine(spark, engine.config)
    bundle = spark.createDataFrame([("one", [1.0] * 64, None), ("two", [2.0] * 64, "own"), ("three", [0.5] * 64, None)], "text string, vector array<double>, chunk_id string").repartition(3)
    rows = other.build_from_bundle(bundle, str(tmp_path / "b")).collect()
    assert {r["chunk_id"] for r in rows} - {f"chunk_{r['pos']}" for r in rows} == {"own"} and len(rows) == 3
    assert Engine(spark, engine.config).load(str(tmp_path / "b"))
    assert other.build_from_bundle(bundle.select("text", "vector")).where("chunk_id = concat('chunk_', pos)").count() == 3
    other.rebuild(spark.createDataFrame([(7, 1, TEXT)], PAGES))
    assert {r["metadata"]["doc_id"] for r in other.store.collect()} == {"7"}
    other.clear()
    assert other.stats()["total_vectors"] == 0 and other.ask("river?")["model_used"] == "none"


def test_an_engine_with_cells(spark, engine, tmp_path):
    pages = spark.createDataFrame([(i, 1, f"Topic {i} of the {w} is told here at some length for all. " * 5) for i, w in enumerate(["river", "forest", "desert", "city"] * 5)], PAGES)
    e = Engine(spark, Config(strategy="sentences", threshold=0.0, index_type="ivf", cells=4, probes=4))
    e.build(pages, str(tmp_path / "s"))
    flat = Engine(spark, Config(strategy="sentences", threshold=0.0))
    flat.build(pages)
    assert e.ask("where is the desert")["context"] == flat.ask("where is the desert")["context"]
    other = Engine(spark, e.config)
    assert other.load(str(tmp_path / "s")) and other.centroids is not None and other.stats()["index_type"] == "ivf"
    assert other.ask("where is the desert")["context"] == flat.ask("where is the desert")["context"]
    with pytest.raises(ValueError):
        Engine(spark, Config(index_type="graph"))


def test_session_figures(spark, engine, monkeypatch):
    from quillspark.plans import engine as engines

    other = Engine(spark, engine.config)
    other.store = engine.store
    got = other.ask("where does the river carry water?")
    assert got["response_time_ms"] > 0 and "T" in got["timestamp"]
    assert {"ask", "build", "evaluate", "rebuild"} <= set(other.info()["calls"]) and other.info()["config"]["metric"] == "cosine"
    stats = other.stats()
    assert stats["status"] == "ready" and stats["conversation_count"] == 1 and stats["uptime_seconds"] > 0
    monkeypatch.setattr(engines, "HELD_TURNS", 4)
    for i in range(5):
        other.remember(1, f"q{i}", f"a{i}")
    assert [r["answer"] for r in other.history().orderBy("pair").collect()] == [f"a{i}" for i in range(5)]
    assert len(other._held) == 2
    other.clear_memory()
    assert other.history().count() == 0 and other.stats()["conversation_count"] == 0


def test_cases_without_id_or_answer(spark, engine):
    cases = spark.createDataFrame([(None, "where does the river go", "to the sea"), ("x", None, "a"), ("y", "q", None), (None, "what ran", "foxes")], "id string, question string, answer string").coalesce(1)
    rows, summary = engine.evaluate(cases)
    assert {r["id"] for r in rows.collect()} == {"test_1", "test_4"} and summary.first()["total_questions"] == 2
    assert engine.evaluate(cases.drop("id"))[0].count() == 2


def test_hooks(spark):
    from quillspark.functions import text as T

    df = spark.createDataFrame([("Rivers carry water to the sea.",), ("Ã© broken letters",)], "t string")
    upper = lambda c: F.when(c.contains("Rivers"), "fr")
    assert [r[0] for r in df.select(T.chunk_language("t", upper)).collect()] == ["fr", "en"]
    assert df.select(T.query_language("t", upper)).first()[0] == "fr"
    repaired = df.select(T.normalize("t", repair=lambda c: F.replace(c, F.lit("Ã©"), F.lit("é")))).collect()
    assert repaired[1][0] == "é broken letters"


def test_a_broken_pdf_goes_to_the_next_reader(spark, tmp_path):
    def layout(data):
        if data.startswith(b"broken"):
            raise OSError("bad cross-reference table")
        return [(1, "a page of the layout reader that is long enough to stay", "pdfplumber", [[["a", None], ["b", "c"]]], [0.0, 0.0, 9.0, 9.0]), (2, "short", "pdfplumber"), (3, " ", "pdfplumber")]

    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    plain = lambda data: [(1, "plain text of the page, which is long enough to stay so", "pypdf2")]
    scanner = lambda data, page: f"scanned text of page {page}, longer than it was"
    got = files.read_pdf_pages(spark, str(tmp_path), (layout, plain), scanner).collect()
    assert sorted((r["path"][-5], r["page_number"], r["extraction_method"]) for r in got) == [("a", 1, "pdfplumber"), ("a", 2, "ocr_fallback"), ("b", 1, "pypdf2")]
    assert {r["tables"]: r["bbox"] for r in got if r["page_number"] == 1} == {"\nTable 1:\na | \nb | c\n\n": [0.0, 0.0, 9.0, 9.0], "": None}
    with pytest.raises(OSError):
        files.first_that_reads(b"broken", (layout,))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_pdf_pages(spark, str(tmp_path / "none"))


def test_sinks(spark, engine, tmp_path):
    from quillspark.operators import chunking

    chunks = chunking.chunk_pages(spark.createDataFrame([(1, 1, TEXT)], PAGES), "sentences")
    files.write_chunks_markdown(chunks, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).first()[0].startswith("## page_1_sent_0 (")
    files.write_pages_text(spark.createDataFrame([("one",)], "text string"), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).first()[0] == "one"
    cases = spark.createDataFrame([("c1", "where does the river go", "to the sea")], "id string, question string, answer string")
    files.write_evaluation(*engine.evaluate(cases), str(tmp_path / "ev"))
    assert spark.read.json(str(tmp_path / "ev/detailed_results")).count() == 1
    assert "evaluated_at" in spark.read.json(str(tmp_path / "ev/summary")).columns


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ftwo")
    pages = files.read_text_pages(spark, str(tmp_path / "in")).orderBy("page_number").collect()
    assert [(r["page_number"], r["text"]) for r in pages] == [(1, "one"), (2, "two")]
    (tmp_path / "in/b.pdf").write_bytes(b"x|y")
    got = files.read_pdf_pages(spark, str(tmp_path / "in"), lambda b: [(i + 1, t, "fake") for i, t in enumerate(b.decode().split("|"))])
    assert {(r["page_number"], r["text"]) for r in got.collect()} == {(1, "x"), (2, "y")}
    html = spark.createDataFrame([(1, "u", "<p>a<script>x</script> <b>b</b></p><!-- c -->")], "page_id bigint, url string, html string")
    assert files.html_pages(html).first()["text"] == "a b"


def test_stream_appends_once(spark, tmp_path):
    source, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    spark.createDataFrame([(1, 1, TEXT)], PAGES).write.parquet(source)
    stream = lambda: spark.readStream.schema(PAGES).parquet(source)
    ingest_pages(stream(), store, check).awaitTermination()
    first = spark.read.parquet(store).count()
    spark.createDataFrame([(1, 2, TEXT), (2, 1, TEXT)], PAGES).write.mode("append").parquet(source)
    ingest_pages(stream(), store, check).awaitTermination()
    assert first > 0 and spark.read.parquet(store).count() == 2 * first


def test_the_query_answers_every_benchmark_item(spark, tmp_path):
    """By its own words, whatever its number; not found without a document."""
    from quillspark.plans import catalog

    texts = ["The red heron nests by the northern river in spring", "Copper kettles boil quickly over an open fire"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(3, texts[1]), (977, texts[0]), (978, "ØÆÅ"), (979, "")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["query_id"]: r for r in catalog.queries()["ask_batch"](spark, str(tmp_path)).collect()}
    assert set(rows) == {3, 977, 978, 979}
    assert rows[3]["answer"] == "Copper kettles" and rows[977]["answer"] == "The red"
    assert all(rows[i]["model_used"] == "none" and rows[i]["confidence"] == 0 for i in (978, 979))
