"""A store that changes on disk: both kinds of parts, against a plain list."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quillspark.operators import embedding
from quillspark.plans.engine import Config, Engine
from quillspark.sources.changing import ChangingStore, by_cell, hashed
from quillspark.sources.store import EmbeddingCache

ROWS = "chunk_id string, text string, metadata map<string,string>, vector array<float>"
CENTROIDS = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])


def row(i, rng):
    angle = rng.random() * 3
    return (f"c{i}", f"text {i}", {"n": str(i)}, [float(np.float32(np.cos(angle))), float(np.float32(np.sin(angle)))])


def contents(store):
    return sorted((r["chunk_id"], r["text"], str(r["metadata"]), tuple(r["vector"])) for r in store.read().collect())


def plain(rows):
    return sorted((c, t, str(m), tuple(v)) for c, t, m, v in rows)


@pytest.mark.parametrize("place", [hashed(4), by_cell(CENTROIDS, "cosine")], ids=["hashed", "by_cell"])
def test_changes(spark, tmp_path, place):
    rng = random.Random(3)
    store = ChangingStore(spark, str(tmp_path / "s"), place)
    rows = [row(i, rng) for i in range(60)]
    store.create(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"pos bigint, {ROWS}"))
    assert contents(store) == plain(rows)
    for step in range(4):
        new = [row(100 * step + 100 + i, rng) for i in range(9)] + [("c3", f"again {step}", None, [0.0, 1.0])]
        store.append(spark.createDataFrame(new, ROWS))
        rows += new
        changed = {f"c{i}": row(i, rng) for i in rng.sample(range(60), 5)}
        kept = {"c5": ("c5", None, None, None)}
        store.update(spark.createDataFrame([*changed.values(), *kept.values(), ("none", "x", None, [1.0, 0.0])], ROWS))
        rows = [changed.get(r[0], r) for r in rows]
        gone = {f"c{i}" for i in rng.sample(range(60), 4)}
        store.delete(spark.createDataFrame([(c,) for c in [*gone, "none"]], "chunk_id string"))
        rows = [r for r in rows if r[0] not in gone]
        assert contents(store) == plain(rows)
        if step == 2:
            store.compact()
            assert contents(store) == plain(rows) and store._raw().where("deleted").count() <= 4
    found = store.read()
    assert found.select("pos").distinct().count() == len(rows)
    again = place(found.drop("part")).select("pos", "part").exceptAll(found.select("pos", "part"))
    assert again.count() == 0
    # A part that loses its last row.
    store.delete(found.where("part = 1"))
    assert store.read().where("part = 1").count() == 0
    store.compact()
    assert store.read().where("part = 1").count() == 0
    store.clear()
    assert store.read().count() == 0 and ChangingStore(spark, store.path, place).read().count() == 0
    store.append(spark.createDataFrame([row(7, rng)], ROWS))
    assert store.read().count() == 1


def test_a_change_that_fails_changes_nothing(spark, tmp_path):
    rng = random.Random(4)
    store = ChangingStore(spark, str(tmp_path / "s"))
    rows = [row(i, rng) for i in range(20)]
    store.create(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"pos bigint, {ROWS}"))
    fail = F.udf(lambda t: 1 // 0, "string")
    bad = spark.createDataFrame(rows[:5], ROWS).withColumn("text", fail("text"))
    for change in (store.append, store.update):
        with pytest.raises(Exception, match="ZeroDivision"):
            change(bad)
        assert contents(store) == plain(rows)


def test_only_touched_parts_are_written(spark, tmp_path):
    rng = random.Random(5)
    store = ChangingStore(spark, str(tmp_path / "s"), hashed(16))
    store.create(spark.createDataFrame([(i, *row(i, rng)) for i in range(200)], f"pos bigint, {ROWS}"))
    files = lambda: {os.path.join(d, x) for d, _, names in os.walk(store.path) for x in names if x.endswith(".parquet")}
    before, part = files(), store.read().where("chunk_id = 'c9'").first()["part"]
    store.delete(spark.createDataFrame([("c9",)], "chunk_id string"))
    assert before ^ files() and all(f"/part={part}/" in f for f in before ^ files())
    plan = store.read().where(F.col("part") == part)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


@pytest.mark.parametrize("index_type", ["flat", "ivf", "lsh"])
def test_engine_changes_its_store(spark, tmp_path, index_type):
    path = str(tmp_path / "s")
    engine = Engine(spark, Config(index_type=index_type, cells=4, probes=4, threshold=0.1))
    texts = [f"the {w} stands by the {v} river" for w in ("mill", "tower", "church", "bridge") for v in ("red", "green", "long", "old", "dry")]
    bundle = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    engine.build_from_bundle(embedding.encode(bundle, engine.embedder, "text", "vector"), path)
    engine.add(spark.createDataFrame([("new", "a purple zebra drinks lemonade", {"page": "9"})], "chunk_id string, text string, metadata map<string,string>"))
    first = engine.search_text("purple zebra lemonade", 3)[0]
    assert first["chunk_id"] == "new" and first["metadata"] == {"page": "9"} and first["rank"] == 1 and 0 < first["score"] <= 1
    engine.update(spark.createDataFrame([("t3", "an orange walrus sings opera")], "chunk_id string, text string"))
    engine.delete(spark.createDataFrame([("t4",)], "chunk_id string"))
    other = Engine(spark, engine.config)
    assert other.load(path) and other.stats()["total_vectors"] == len(texts)
    assert other.search_text("orange walrus opera")[0]["chunk_id"] == "t3"
    asked = spark.createDataFrame([(1, "where does the zebra drink?")], "query_id bigint, question string")
    rows = {r["query_id"]: r for r in other.ask_batch(asked).collect()}
    assert rows[1]["sources"][0]["chunk_id"] == "new" and rows[1]["n_sources"] == len(rows[1]["sources"]) > 0
    assert "sources" not in other.ask_batch(asked, include_sources=False).columns
    engine.compact()
    engine.clear()
    assert engine.stats()["total_vectors"] == 0 and other.load(path) and other.stats()["total_vectors"] == 0
    with pytest.raises(RuntimeError):
        Engine(spark).add(asked)


def test_search_of_many_texts(spark, tmp_path):
    engine = Engine(spark)
    bundle = spark.createDataFrame([("a", "red mill"), ("b", "green tower"), ("c", None)], "chunk_id string, text string")
    engine.build_from_bundle(embedding.encode(bundle, engine.embedder, "text", "vector"))
    found = engine.search(spark.createDataFrame([(1, "red mill"), (2, "green tower"), (3, None)], "query_id bigint, text string"), 1, 0.2)
    assert {(r["query_id"], r["chunk_id"], r["content"]) for r in found.collect()} == {(1, "a", "red mill"), (2, "b", "green tower")}
    assert found.columns == ["query_id", "rank", "score", "chunk_id", "content", "metadata"]


class Broken:
    """Fails on each batch with a poisoned text."""

    name, dimension = "broken", 2

    def encode(self, texts):
        if any("poison" in t for t in texts):
            raise ValueError
        return np.ones((len(texts), 2))


def test_encoder_failures_are_contained(spark, tmp_path):
    texts = [(i, f"text {i}") for i in range(40)] + [(40, "poison one"), (41, ""), (42, None), (43, "the last poison")]
    df = spark.createDataFrame(texts, "i int, text string")
    failed = Observation("failed")
    rows = {r["i"]: list(r["embedding"]) for r in embedding.encode(df, Broken(), failed=failed).collect()}
    assert failed.get == {"failed": 2, "texts": 44}
    assert [i for i, v in rows.items() if v == [0, 0]] == [40, 41, 42, 43]
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    got = {r["i"]: list(r["vector"]) for r in cache.encode(df, Broken()).collect()}
    assert got == rows and cache.load().count() == 41  # with one row of the empty text
    assert len(list(embedding.by_length(["x" * (1 << 18)] * 3))) == 3 and sum(map(len, embedding.by_length(["a"] * 1_000))) == 1_000
    wrong = type("Wrong", (), {"name": "wrong", "dimension": 3, "encode": lambda self, t: np.ones((len(t), 2))})()
    assert embedding.contained(wrong, ["a", "b"]) == [None, None]
