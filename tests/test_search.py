"""Search and store operations against plain numpy."""

import os

import numpy as np
import pytest

from quillspark.operators import embedding, search
from quillspark.sources import changing
from quillspark.sources import store as stores

VECTOR = "vec_id bigint, embedding array<float>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8)).astype(np.float32)
    v[17] = 0
    v[30] = v[31]  # a tie
    return v


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VECTOR)


def brute(v, q, metric, k, threshold=None):
    v, q = v.astype(float), q.astype(float)
    if metric == "l2":
        s = 1 / (1 + ((v - q) ** 2).sum(1))
    else:
        s = v @ q
        if metric == "cosine":
            n = np.linalg.norm(v, axis=1) * np.linalg.norm(q)
            s = np.where(n == 0, 0, s / np.where(n == 0, 1, n))
    s = np.round(s, 6)
    order = sorted(range(len(v)), key=lambda i: (-s[i], i))
    return [(i, s[i]) for i in order if threshold is None or s[i] >= threshold][:k]


@pytest.mark.parametrize("metric", search.METRICS)
@pytest.mark.parametrize("k, threshold", [(5, None), (5, 0.4), (500, None)])
def test_topk(spark, data, metric, k, threshold):
    df = frame(spark, data).repartition(5)
    queries = df.where("vec_id in (0, 17, 30)").selectExpr("vec_id AS query_id", "embedding")
    got = search.topk(df, queries, k, metric, threshold).orderBy("query_id", "rank").collect()
    for q in (0, 17, 30):
        mine = [(r["vec_id"], r["score"]) for r in got if r["query_id"] == q]
        want = brute(data, data[q], metric, k, threshold)
        assert [i for i, _ in mine] == [i for i, _ in want]
        assert np.allclose([s for _, s in mine], [s for _, s in want], atol=1e-6)


def test_shorter_lists_are_prefixes(spark, data):
    df = frame(spark, data)
    queries = df.where("vec_id < 5").selectExpr("vec_id AS query_id", "embedding")
    three, five = ({(r["query_id"], r["rank"]): r["vec_id"] for r in search.topk(df, queries, k).collect()} for k in (3, 5))
    assert all(five[key] == v for key, v in three.items())


def test_nothing_to_search(spark, data):
    df, none = frame(spark, data), frame(spark, data[:0])
    queries = df.selectExpr("vec_id AS query_id", "embedding")
    assert search.topk(none, queries).count() == 0
    assert search.topk(df, queries.limit(0)).count() == 0
    with pytest.raises(ValueError):
        search.topk(df, queries, metric="hamming")


def test_blocks_of_queries(spark, data, monkeypatch):
    df = frame(spark, data)
    queries = df.where("vec_id < 7").selectExpr("vec_id AS query_id", "embedding")
    want = sorted(map(tuple, search.topk(df, queries, 3).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, search.topk(df, queries, 3).collect())) == want


def test_probing_every_cell_is_exact(spark, data):
    df = frame(spark, data).where("vec_id <> 17")
    indexed, centroids = search.build_ivf(df, 6)
    assert indexed.where("cell is null").count() == 0
    queries = df.where("vec_id < 9").selectExpr("vec_id AS query_id", "embedding")
    exact, all_cells = search.topk(df, queries, 4), search.topk(indexed, queries, 4, cells=(centroids, 6))
    assert search.recall(all_cells, exact).first()["recall"] == 1
    assert 0 < search.recall(search.topk(indexed, queries, 4, cells=(centroids, 2)), exact).first()["recall"] <= 1


def clustered(rng, n, d=16, groups=40):
    centres = rng.normal(size=(groups, d)) * 3
    return (centres[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.5).astype(np.float32)


@pytest.mark.parametrize("metric", search.METRICS)
def test_a_few_cells_find_most_neighbours(spark, tmp_path, metric):
    """5 of 32 cells, read from a store by cell; only those are read."""
    df = frame(spark, clustered(np.random.default_rng(4), 3000))
    indexed, centroids = search.build_ivf(df, 32, metric=metric)
    indexed.write.partitionBy("cell").parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    queries = df.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding")
    exact, found = search.topk(df, queries, 10, metric), search.topk(stored, queries, 10, metric, cells=(centroids, 5))
    assert search.recall(found, exact).first()["recall"] >= 0.9
    one = search.topk(stored, queries.where("query_id = 50"), 10, metric, cells=(centroids, 5))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell#") or "cell#" in plan.split("PartitionFilters:")[1][:80]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, found.where("query_id = 50").collect()))


@pytest.mark.parametrize("metric", search.METRICS)
def test_a_few_sides_find_most_neighbours(spark, tmp_path, metric):
    """8 of the 32 cells of 5 hyperplanes, under a third of the rows; saved and
    loaded by an engine's store."""
    df = frame(spark, clustered(np.random.default_rng(4), 3000))
    indexed, cells = search.build_lsh(df, 5, metric=metric)
    stores.save_cells(spark, cells, str(tmp_path))
    loaded = stores.load_cells(spark, str(tmp_path), "lsh")
    assert isinstance(loaded, search.Hyperplanes) and np.array_equal(loaded.planes, cells.planes) and np.array_equal(loaded.center, cells.center)
    queries = df.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding")
    exact, found = search.topk(df, queries, 10, metric), search.topk(indexed, queries, 10, metric, cells=(loaded, 8))
    assert search.recall(found, exact).first()["recall"] >= 0.9
    vectors = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], float)
    own, probed = cells.assign(vectors), cells.probes(vectors[::50], 8)
    assert np.mean([np.isin(own, p).mean() for p in probed]) < 1 / 3
    assert [p[0] for p in probed] == own[::50].tolist()  # its own cell first
    every = search.topk(indexed, queries, 10, metric, cells=(cells, 32))
    assert search.recall(every, exact).first()["recall"] == 1


def test_sides_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], VECTOR)
    indexed, cells = search.build_lsh(df, 5, metric="l2")  # more planes than dimensions
    assert {r["vec_id"]: r["cell"] >= 0 for r in indexed.collect()} == {1: False, 2: True, 3: True, 4: True}
    assert [r["vec_id"] for r in search.topk(indexed, [(7, [1.0, 0.0])], 1, "l2", cells=(cells, 1)).collect()] == [2]
    assert search.build_lsh(df.limit(0))[0].count() == 0


def test_cells_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], VECTOR)
    indexed, centroids = search.build_ivf(df, 2)
    assert {r["vec_id"]: r["cell"] >= 0 for r in indexed.collect()} == {1: False, 2: True, 3: True, 4: True}
    queries = df.where("vec_id = 2").selectExpr("vec_id AS query_id", "embedding")
    assert [r["vec_id"] for r in search.topk(indexed, queries, 1, cells=(centroids, 1)).collect()] == [2]
    assert search.build_ivf(df.limit(0), 2)[0].count() == 0


STORE = "pos bigint, chunk_id string, text string, metadata map<string,string>, vector array<float>"


def test_store_operations(spark, tmp_path):
    rows = [(0, "a", "one", {"k": "1"}, [1.0, 0.0]), (1, "b", "two", {}, [0.0, 1.0]), (2, "a", "three", {}, [1.0, 1.0])]
    store = spark.createDataFrame(rows, STORE)
    assert search.get_by_id(store, "a").first()["text"] == "three"
    assert search.get_by_id(store, "z").count() == 0
    grown = search.append(store, store.where("chunk_id = 'b'"))
    assert search.latest(grown).where("chunk_id = 'b'").first()["pos"] > 2
    changed = search.upsert(store, store.where("pos = 1").selectExpr("chunk_id", "'new' AS text", "metadata", "array(2f, 2f) AS vector"))
    assert [(r["pos"], r["text"], r["vector"]) for r in changed.orderBy("pos").collect()][1] == (1, "new", [2.0, 2.0])
    assert {r["chunk_id"] for r in search.delete(store, store.where("chunk_id = 'a'")).collect()} == {"b"}
    assert search.store_statistics(store.limit(0)).first()["index_size_mb"] == 0
    path = str(tmp_path / "store")
    assert stores.load_store(spark, path) is None
    assert stores.open_or_create(spark, path, STORE, metric="cosine").count() == 0
    stores.save_store(store, path, metric="cosine", dimension=2)
    with pytest.warns(UserWarning, match="metric"):
        assert stores.load_store(spark, path, metric="l2").count() == 3


def test_index_size(spark):
    df = spark.range(251).selectExpr("array_repeat(1f, 384) AS vector")
    assert search.store_statistics(df).first()["index_size_mb"] == 0.39


def test_cached_encoding(spark):
    texts = spark.createDataFrame([(1, "river"), (2, "river"), (3, "sea"), (4, "")], "i int, text string")
    empty = spark.createDataFrame([], "cache_key string, model string, vector array<float>")
    model = embedding.HashingEmbedder(16)
    rows, cache = embedding.encode_cached(texts, model, empty)
    got = {r["i"]: r["vector"] for r in rows.collect()}
    assert got[1] == got[2] != got[3] and set(got[4]) == {0.0}
    assert cache.count() == 3
    assert embedding.cache_misses(texts, cache, model.name).count() == 0


class Counting:
    """Counts its calls in a file, as workers are processes of their own."""

    name, dimension = "counting", 2

    def __init__(self, path):
        self.path = path

    def encode(self, texts):
        with open(self.path, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return np.array([[len(t), 1] for t in texts], float).reshape(-1, 2)


def test_a_cache_in_a_table(spark, tmp_path):
    path, log = str(tmp_path / "cache"), tmp_path / "log"
    model = embedding.LazyEmbedder(lambda: Counting(str(log)), "counting", 2)
    cache = stores.EmbeddingCache(spark, path)
    assert cache.load().count() == 0
    texts = spark.createDataFrame([(1, "river"), (2, "river"), (3, "sea")], "i int, text string")
    first = {r["i"]: r["vector"] for r in cache.encode(texts, model).collect()}
    more = spark.createDataFrame([(3, "sea"), (4, "hill")], "i int, text string")
    second = {r["i"]: r["vector"] for r in stores.EmbeddingCache(spark, path).encode(more, model).collect()}
    assert first[1] == first[2] and first[3] == second[3] and len(second[4]) == 2
    assert sorted(log.read_text().split("\n")[:-1]) == ["passage: hill", "passage: river", "passage: sea"]
    other = embedding.HashingEmbedder(16)
    assert len(cache.encode(texts, other).first()["vector"]) == 16 and cache.load().count() == 5
    cache.clear()
    assert cache.load().count() == 0
    with pytest.raises(ValueError):
        embedding.LazyEmbedder(lambda: Counting(str(log)), "wide", 3).encode(["a"])


def test_a_look_up_leaves_the_cache_where_it_is(spark, tmp_path):
    """No exchange between the cache's scan and the join; files are gathered."""
    names = lambda: {t.name for t in spark.catalog.listTables()}
    path, before = str(tmp_path / "cache"), names()
    cache = stores.EmbeddingCache(spark, path, buckets=3)
    model = embedding.HashingEmbedder(4)
    for step in range(3):
        texts = spark.createDataFrame([(i, f"text {i}") for i in range(20 * step, 20 * step + 40)], "i int, text string")
        cache.encode(texts, model)
    assert cache.load().count() == 80 == cache.load().select("cache_key").distinct().count()
    files = lambda: [x for d, _, names in os.walk(path) for x in names if x.endswith(".parquet") and "model=" in d]
    assert len(files()) > 3
    cache.compact(model.name)
    assert len(files()) == 3 and cache.load().count() == 80
    again = stores.EmbeddingCache(spark, path, buckets=9)  # the stored number holds
    texts = spark.createDataFrame([(1, "text 1"), (2, "text 1"), (3, None)], "i int, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = again.encode(texts, model)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = {r["i"]: list(r["vector"]) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert again.buckets == 3 and "Bucketed: true" in plan and plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert rows[1] == rows[2] and rows[3] == [0, 0, 0, 0] and any(rows[1])
    other = type("Named", (embedding.HashingEmbedder,), {"name": "a/b 'c'"})(4)
    again.encode(texts, other)
    assert {r[0] for r in again.load().select("model").distinct().collect()} == {model.name, other.name}
    cache.close()
    again.close()
    assert names() == before


def test_appended_rows_keep_the_order_of_their_positions(spark, tmp_path):
    """Whatever order their files are read in, the largest first: the latest row of
    an id is the one with the largest position."""
    made = spark.range(400).selectExpr("id AS pos", "concat('c', id % 4) AS chunk_id", "concat('t', id) AS text", "map('k', 'v') AS metadata", "array(1.0f) AS vector")
    for i, part in enumerate((made.where("pos < 10"), made.where("pos >= 10 AND pos < 100"), made.where("pos >= 100"))):
        part.coalesce(1).write.parquet(str(tmp_path / "new" / f"part={i}"))
    new = spark.read.parquet(str(tmp_path / "new" / "part=*"))
    want = [(f"c{i}", f"t{396 + i}") for i in range(4)]
    with_order = new.sort("pos", ascending=False)  # the last come first
    latest = search.latest(search.append(made.where("pos < 4"), with_order)).select("chunk_id", "text")
    assert sorted(map(tuple, latest.collect())) == want
    store = changing.ChangingStore(spark, str(tmp_path / "store"))
    store.create(made.where("pos < 4"))
    store.append(with_order)
    assert sorted(map(tuple, search.latest(store.read()).select("chunk_id", "text").collect())) == want


@pytest.mark.parametrize("cells", [False, True])
def test_scores_are_held_in_tiles(spark, data, monkeypatch, cells):
    """A task scores a batch against so few queries at once that it never holds
    more than a tile, and finds the same."""
    df = frame(spark, data).coalesce(1)
    queries = df.where("vec_id < 40").selectExpr("vec_id AS query_id", "embedding")
    vectors, probed = (df, None) if not cells else search.build_ivf(df, 4)
    of = None if probed is None else (probed, 2)
    want = sorted(map(tuple, search.topk(vectors, queries, 3, cells=of).collect()))
    scores = search._scores

    def watched(metric, q, v):
        assert len(q) * len(v) <= max(search.TILE, len(v))
        return scores(metric, q, v)

    monkeypatch.setattr(search, "TILE", 400)
    monkeypatch.setattr(search, "_scores", watched)


    batch = vectors.toPandas()
    runs = []
    monkeypatch.setattr(type(vectors), "mapInPandas", lambda self, run, schema: runs.append(run) or self.sparkSession.createDataFrame([], schema))
    search.topk(vectors, queries, 3, cells=of)
    found = next(runs[0](iter([batch])))
    assert sorted((r.query_id, r.vec_id, r.score) for r in found.itertuples()) == [w[:3] for w in want]
