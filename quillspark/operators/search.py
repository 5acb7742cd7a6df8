"""Vector store operations and similarity search.

Exact search scores blocks of queries against Arrow batches of vectors by matrix
product and keeps a running top k for each partition, so a partition ships k
rows a query whatever its size; a window ranks what is left.  Queries travel in
blocks of bounded size.  The approximate indexes assign every vector to a cell,
its nearest centroid's or its sides of random hyperplanes, and read and score only
the cells that some query probes; a store that is written by cell is pruned to them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batches
from . import embedding

QUERY_BLOCK = 4_096
TILE = 1 << 20  # scores that a task holds at once
SAMPLE_ROWS = 50_000
METRICS = ("cosine", "ip", "l2")


def _scores(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    if metric == "l2":
        squared = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T
        return 1 / (1 + np.maximum(squared, 0))
    if metric == "cosine":
        q, v = (x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n) for x in (q, v))
    return q @ v.T


class _Top:
    """The k best (rounded score, then least id) of each query so far."""

    def __init__(self, n: int, k: int, threshold: float | None):
        self.best: list[list[tuple[float, int]]] = [[] for _ in range(n)]
        self.k, self.threshold = k, threshold

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.round(scores, 6)
        for i, row in zip(rows.tolist(), scores, strict=True):
            least = np.partition(row, -self.k)[-self.k] if len(row) > self.k else -np.inf
            if self.threshold is not None:
                least = max(least, self.threshold)
            if len(self.best[i]) == self.k:
                least = max(least, -self.best[i][-1][0])
            hit = np.flatnonzero(row >= least)
            if len(hit):
                merged = self.best[i] + [(-s, d) for s, d in zip(row[hit].tolist(), ids[hit].tolist(), strict=True)]
                self.best[i] = sorted(merged)[: self.k]


def topk(
    vectors: DataFrame,
    queries: DataFrame | list[tuple[int, Sequence[float]]],
    k: int = 10,
    metric: str = "cosine",
    threshold: float | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_col: str = "query_id",
    cells: tuple[np.ndarray | Hyperplanes, int] | None = None,
) -> DataFrame:
    """query_id, vec_id, score (6 decimals), rank.  Queries are a table, or a list
    of (id, vector) that is at hand.  ``threshold`` is inclusive;
    it commutes with the ranking, so it is applied below it.  ``cells`` makes
    the search approximate: (centroids or hyperplanes, probes), for vectors with a
    ``cell``."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    sc, out = vectors.sparkSession.sparkContext, None

    batches.bounded(vectors.sparkSession)

    def scan(block: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        sent = sc.broadcast(block)  # at most QUERY_BLOCK queries

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            top = _Top(len(ids), k, threshold)
            probed = None
            if cells is not None:
                order = _probes(metric, q, *cells)
                probed = [np.flatnonzero((order == c).any(axis=1)) for c in range(len(cells[0]))]
                del order
            for pdf in parts:
                pdf = pdf[pdf[vector_col].notna()]
                for part in [pdf] if probed is None else (p for _, p in pdf.groupby("cell")):
                    rows = np.arange(len(ids)) if probed is None else probed[int(part["cell"].iloc[0])]
                    if len(part) and len(rows):
                        v = np.stack(part[vector_col].to_numpy()).astype(np.float64)
                        step = max(1, TILE // len(v))
                        for tile in (rows[i : i + step] for i in range(0, len(rows), step)):
                            top.add(tile, part[id_col].to_numpy(), _scores(metric, q[tile], v))
            flat = [(int(ids[i]), d, -s) for i, best in enumerate(top.best) for s, d in best]
            yield pd.DataFrame(flat, columns=[query_col, id_col, "score"])

        columns, rows = [id_col, vector_col] + ["cell"] * (cells is not None), vectors
        if cells is not None:
            rows = rows.where(F.col("cell").isin(np.unique(_probes(metric, block[1], *cells)).tolist()))
        return rows.select(*columns).mapInPandas(run, f"{query_col} bigint, {id_col} bigint, score double")

    rows = queries if isinstance(queries, list) else queries.where(F.col(vector_col).isNotNull()).select(query_col, vector_col).toLocalIterator()
    ids, vecs = [], []

    def flush() -> None:
        nonlocal out, ids, vecs
        if ids:
            part = scan((np.array(ids, np.int64), np.array(vecs, np.float64)))
            out = part if out is None else out.unionByName(part)
            ids, vecs = [], []

    for row in rows:
        ids.append(row[0])
        vecs.append(row[1])
        if len(ids) == QUERY_BLOCK:
            flush()
    flush()
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"{query_col} bigint, {id_col} bigint, score double, rank int")
    ranked = Window.partitionBy(query_col).orderBy(F.desc("score"), id_col)
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


class Hyperplanes:
    """Cells of a locality-sensitive hash: a bit for each plane, by the side of it
    that a vector is on.  Vectors at a small angle share most bits, so a query
    probes its own cell and then those that it is least far from, by the summed
    distances to the planes between."""

    def __init__(self, center: np.ndarray, planes: np.ndarray):
        self.center, self.planes = center, planes

    def __len__(self) -> int:
        return 1 << len(self.planes)

    def _sides(self, v: np.ndarray) -> np.ndarray:
        return (v - self.center) @ self.planes.T

    def assign(self, v: np.ndarray) -> np.ndarray:
        return (self._sides(v) >= 0) @ (1 << np.arange(len(self.planes)))

    def probes(self, queries: np.ndarray, probes: int) -> np.ndarray:
        sides = self._sides(queries)
        bits = np.arange(len(self))[:, None] >> np.arange(len(self.planes)) & 1
        between = (sides >= 0)[:, None, :] != (bits == 1)[None, :, :]
        return np.argsort((between * np.abs(sides)[:, None, :]).sum(axis=2), axis=1, kind="stable")[:, :probes]

    def matrix(self) -> np.ndarray:
        return np.vstack([self.center, self.planes])


def _probes(metric: str, queries: np.ndarray, cells: np.ndarray | Hyperplanes, probes: int) -> np.ndarray:
    """The cells that each query probes, the nearest by the metric."""
    width = len(cells) * (len(cells.planes) if isinstance(cells, Hyperplanes) else 1)
    step = max(1, TILE // width)

    def nearest(q: np.ndarray) -> np.ndarray:
        if isinstance(cells, Hyperplanes):
            return cells.probes(q, probes)
        return np.argsort(-_scores(metric, q, cells), axis=1, kind="stable")[:, :probes]

    return np.concatenate([nearest(queries[i : i + step]) for i in range(0, max(1, len(queries)), step)])


def assign_cells(vectors: DataFrame, cells: np.ndarray | Hyperplanes, metric: str = "cosine", vector_col: str = "embedding") -> DataFrame:
    """Vectors with their cell: that of the nearest centroid, by angle for cosine
    and by distance otherwise (by inner product one long centroid would take them
    all), or of the hyperplanes."""
    near = "cosine" if metric == "cosine" else "l2"

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        out = np.full(len(v), -1, np.int32)
        some = v.notna().to_numpy()
        if some.any():
            known = np.stack(v[some].to_numpy()).astype(np.float64)
            out[some] = cells.assign(known) if isinstance(cells, Hyperplanes) else _scores(near, known, cells).argmax(axis=1)
        return pd.Series(out)

    return vectors.withColumn("cell", cell(vector_col))


def build_lsh(vectors: DataFrame, bits: int = 5, vector_col: str = "embedding", seed: int = 1, metric: str = "cosine") -> tuple[DataFrame, Hyperplanes]:
    """Vectors with their cell, and the hyperplanes: random and, as far as the
    dimension allows, at right angles, through the vectors' mean (for cosine
    through the origin).  Nothing is fitted but that mean; every row is indexed,
    vectors without a value in cell -1."""
    known = vectors.where(F.col(vector_col).isNotNull())
    first = known.select(F.size(vector_col)).first()
    if first is None:
        return vectors.withColumn("cell", F.lit(-1)), Hyperplanes(np.zeros(1), np.ones((1, 1)))
    center = np.zeros(first[0])
    if metric != "cosine":
        means = known.select(F.posexplode(vector_col)).groupBy("pos").agg(F.avg("col").alias("m")).collect()  # one row a dimension
        for r in means:
            center[r["pos"]] = r["m"]
    drawn = np.random.default_rng(seed).normal(size=(first[0], bits))
    planes = np.linalg.qr(drawn)[0].T if bits <= first[0] else drawn.T
    cells = Hyperplanes(center, planes)
    return assign_cells(vectors, cells, metric, vector_col), cells


def build_ivf(vectors: DataFrame, n_cells: int = 32, vector_col: str = "embedding", seed: int = 1, metric: str = "cosine") -> tuple[DataFrame, np.ndarray]:
    """Vectors with their cell, and the centroids.  The centroids are fitted on
    at most about ``SAMPLE_ROWS`` rows (as unit vectors for cosine); every row is
    indexed.  Vectors without a value are in cell -1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vector = F.col(vector_col).cast("array<double>")
    if metric == "cosine":
        vector = embedding.unit(vector)
    known = vectors.where(F.col(vector_col).isNotNull())
    n = known.count()
    if not n:
        return vectors.withColumn("cell", F.lit(-1)), np.zeros((1, 1))
    sample = known.where(F.rand(seed) < min(1.0, SAMPLE_ROWS / n))
    fitted = KMeans(k=n_cells, seed=seed, maxIter=10).fit(sample.select(array_to_vector(vector).alias("features")))
    centroids = np.array(fitted.clusterCenters())
    return assign_cells(vectors, centroids, metric, vector_col), centroids


def recall(found: DataFrame, exact: DataFrame, on: tuple[str, ...] = ("query_id", "vec_id")) -> DataFrame:
    """Share of the exact neighbours that were found."""
    hits = exact.select(*on).join(found.select(*on).withColumn("hit", F.lit(1)), list(on), "left")
    return hits.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))


def placed_after(new: DataFrame, last: int) -> DataFrame:
    """``new`` rows with positions above ``last``.  Rows that have a ``pos`` keep
    their order by it, however Spark deals the files they are read from to tasks;
    others are placed as they come."""
    if "pos" not in new.columns:
        return new.withColumn("pos", F.monotonically_increasing_id() + F.lit(last + 1))
    least = new.agg(F.coalesce(F.min("pos"), F.lit(0))).first()[0]
    return new.withColumn("pos", F.col("pos") - F.lit(least) + F.lit(last + 1))


def append(store: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows after the store's.  Positions rise from the largest one; they
    give an order and may leave gaps, so no global numbering is needed."""
    last = store.agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
    return store.unionByName(placed_after(new, last))


def latest(store: DataFrame) -> DataFrame:
    """Of rows with one chunk_id, the last."""
    w = Window.partitionBy("chunk_id").orderBy(F.desc("pos"))
    return store.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def get_by_id(store: DataFrame, chunk_id: str) -> DataFrame:
    return latest(store.where(F.col("chunk_id") == chunk_id)).withColumn("score", F.lit(1.0))


def upsert(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Text, metadata and vector of changed ids; others as they were."""
    c = changes.select("chunk_id", *(F.col(x).alias(f"new_{x}") for x in ("text", "metadata", "vector")))
    joined = store.join(c, "chunk_id", "left")
    return joined.select("pos", "chunk_id", *(F.coalesce(f"new_{x}", x).alias(x) for x in ("text", "metadata", "vector")))


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def store_statistics(store: DataFrame, index_type: str = "flat", metric: str = "cosine", vector_col: str = "vector") -> DataFrame:
    n, d = F.count("*"), F.coalesce(F.max(F.size(vector_col)), F.lit(0))
    mb = F.round(d * n * 4 / F.lit(2.0**20) + n * 100 / F.lit(2.0**20), 2)
    return store.agg(n.alias("total_vectors"), d.alias("dimension"), mb.alias("index_size_mb")).withColumns(
        {"index_type": F.lit(index_type), "metric": F.lit(metric), "total_chunks": F.col("total_vectors")}
    )
