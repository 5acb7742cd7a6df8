"""Persisted vector stores and embedding bundles: Parquet tables with a one-row
table of settings beside them."""

from __future__ import annotations

import urllib.parse
import uuid
import warnings

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embedding, search
from .folders import delete_path, session_folder

SETTINGS = ("dimension", "index_type", "metric", "model", "parts")


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table: computed once, whatever reads it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str = "pos", folder: str | None = None) -> DataFrame:
    """Rows numbered 0, 1, 2, ... in their order.  They are written first, so the
    numbers stay, to ``folder`` or one of the session; what reaches the driver is
    a count for each partition."""
    low = (1 << 33) - 1
    rows = written(df.withColumn("_at", F.monotonically_increasing_id()), folder or session_folder(df.sparkSession, "numbered"))
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    bases = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part bigint, _base bigint")
    joined = rows.join(F.broadcast(bases), F.shiftright("_at", 33) == F.col("_part"))  # a row a partition
    return joined.withColumn(column, F.col("_base") + F.col("_at").bitwiseAND(F.lit(low))).drop("_at", "_part", "_base")


def save_cells(spark: SparkSession, cells: np.ndarray | search.Hyperplanes, path: str) -> None:
    """The centroids, or the hyperplanes with their center first."""
    matrix = cells.matrix() if isinstance(cells, search.Hyperplanes) else cells
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(matrix)]
    spark.createDataFrame(rows, "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")


def load_cells(spark: SparkSession, path: str, index_type: str = "ivf") -> np.ndarray | search.Hyperplanes | None:
    """The cells of a store, or None for a store without."""
    try:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    except AnalysisException:
        return None
    matrix = np.array([r["centroid"] for r in rows])
    return search.Hyperplanes(matrix[0], matrix[1:]) if index_type == "lsh" else matrix


def bundle_rows(bundle: DataFrame, folder: str | None = None) -> DataFrame:
    """Rows of a store from embedded texts (text, vector, and where there are:
    chunk_id, metadata).  Rows without an id are chunk_0, chunk_1, ... by place."""
    rows = numbered(bundle, folder=folder)
    given = F.col("chunk_id").cast("string") if "chunk_id" in bundle.columns else F.lit(None).cast("string")
    metadata = F.col("metadata") if "metadata" in bundle.columns else F.create_map().cast("map<string,string>")
    named = F.coalesce(given, F.concat(F.lit("chunk_"), "pos"))
    return rows.select(named.alias("chunk_id"), "text", metadata.alias("metadata"), F.col("vector").cast("array<float>").alias("vector"), "pos")


class EmbeddingCache:
    """Embeddings by text and model in a folder, which a run adds to.

    Each model has a table of its own, bucketed by key.  What is looked up is
    dealt to the same buckets, so a look-up reads the cache where it lies and
    moves the keys alone.  Every run adds at most a file a bucket; ``compact``
    makes one of them.  The number of buckets is that of the first run."""

    SCHEMA = "cache_key string, vector array<float>, model string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets
        self._tables: dict[str, str] = {}

    def load(self) -> DataFrame:
        """All rows; none before the first is saved."""
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def _stored_buckets(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/_settings").first()["buckets"]
        except AnalysisException:
            self.spark.createDataFrame([(self.buckets,)], "buckets int").write.parquet(f"{self.path}/_settings")
            return self.buckets

    def table(self, model: str) -> str:
        """The name of a model's table in this session's catalog."""
        if model not in self._tables:
            self.buckets = self._stored_buckets()
            name = f"quillspark_cache_{uuid.uuid4().hex}"
            at = f"{self.path}/model={urllib.parse.quote(model, safe='')}".replace("'", "%27")
            self.spark.sql(
                f"CREATE TABLE {name} (cache_key string, vector array<float>) USING parquet "
                f"CLUSTERED BY (cache_key) SORTED BY (cache_key) INTO {self.buckets} BUCKETS LOCATION '{at}'"
            )
            self._tables[model] = name
        return self._tables[model]

    def rows(self, model: str) -> DataFrame:
        """A model's rows, in the buckets that ``dealt`` deals to."""
        return self.spark.table(self.table(model)).withColumn("model", F.lit(model))

    def dealt(self, keyed: DataFrame) -> DataFrame:
        return keyed.repartition(self.buckets, "cache_key")

    def encode(self, df: DataFrame, embedder: embedding.Embedder, text_col: str = "text") -> DataFrame:
        """Embedded rows.  Texts that the table lacks are encoded, once, and added."""
        new = embedding.encode_missing(df, embedder, self.rows(embedder.name), text_col, self.dealt)
        new.select("cache_key", "vector").write.insertInto(self.table(embedder.name))
        return embedding.with_cached(df, embedder, self.rows(embedder.name), text_col, self.dealt)

    def compact(self, model: str) -> None:
        """One file a bucket.  A failure while it writes costs cached rows, which
        the next run makes anew."""
        name = self.table(model)
        held = written(self.spark.table(name), session_folder(self.spark, "cache"))
        self.dealt(held).sortWithinPartitions("cache_key").write.insertInto(name, overwrite=True)

    def close(self) -> None:
        """Let go of the session's tables; the files stay."""
        for name in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables = {}

    def clear(self) -> None:
        self.close()
        delete_path(self.spark, self.path)


def save_settings(spark: SparkSession, path: str, **settings) -> None:
    unknown = set(settings) - set(SETTINGS)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    row = [tuple(str(settings[k]) if k in settings else None for k in SETTINGS)]
    spark.createDataFrame(row, ", ".join(f"{k} string" for k in SETTINGS)).write.mode("overwrite").parquet(f"{path}/settings")


def load_settings(spark: SparkSession, path: str, **expected) -> dict | None:
    """The settings of the store at ``path``, or None where there is none.
    Others than expected only warn."""
    try:
        found = spark.read.parquet(f"{path}/settings").first()
    except AnalysisException:
        return None
    settings = dict.fromkeys(SETTINGS) | found.asDict()
    for k, v in expected.items():
        if settings[k] is not None and settings[k] != str(v):
            warnings.warn(f"store has {k} {settings[k]}, not {v}", stacklevel=3)
    return settings


def save_store(store: DataFrame, path: str, partition_by: str | None = None, **settings) -> None:
    """A store that stays as it is; see ``changing`` for one that doesn't."""
    writer = store.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/vectors")
    save_settings(store.sparkSession, path, **settings)


def load_store(spark: SparkSession, path: str, **expected) -> DataFrame | None:
    """The store, or None where there is none."""
    if load_settings(spark, path, **expected) is None:
        return None
    try:
        return spark.read.parquet(f"{path}/vectors")
    except AnalysisException:
        return None


def open_or_create(spark: SparkSession, path: str, schema, **settings) -> DataFrame:
    found = load_store(spark, path, **settings)
    if found is not None:
        return found
    empty = spark.createDataFrame([], schema)
    save_store(empty, path, **settings)
    return empty
