"""Embedding: protocol, a deterministic stand-in, the cache, similarity."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import batches
from ..functions import text as T
from ..functions.trigrams import spelled, trigrams


class Embedder(Protocol):
    """Encodes texts to rows of a float matrix; must be picklable."""

    name: str
    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


@functools.lru_cache(maxsize=1 << 16)
def _hash(gram: str) -> tuple[int, int]:
    """A number and a sign, of a digest that SQL has too."""
    h = hashlib.md5(gram.encode()).hexdigest()
    return int(h[:8], 16), 1 if h[8] >= "8" else -1


class HashingEmbedder:
    """A stand-in without a model: signed hashed character trigrams, unit norm.
    Its results are no measure of retrieval quality."""

    name = "hashing"

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        codes, of = trigrams(texts)
        distinct, at = np.unique(codes, return_inverse=True)
        hashed = np.array([_hash(spelled(c)) for c in distinct.tolist()], np.int64).reshape(-1, 2)
        # Whole numbers add up the same in any order.
        out = np.bincount(of * self.dimension + (hashed[:, 0] % self.dimension)[at], hashed[:, 1][at], len(texts) * self.dimension)
        out = out.reshape(len(texts), self.dimension)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


_loaded: dict[str, Embedder] = {}


class LazyEmbedder:
    """An embedder whose model is loaded by ``factory`` in each worker, once, when
    it first encodes; only the factory travels.  ``name`` tells models apart."""

    def __init__(self, factory: Callable[[], Embedder], name: str, dimension: int):
        self.factory, self.name, self.dimension = factory, name, dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        if self.name not in _loaded:
            _loaded[self.name] = self.factory()
        got = np.asarray(_loaded[self.name].encode(texts))
        if got.shape != (len(texts), self.dimension):
            raise ValueError(f"{self.name} gave {got.shape}, not {(len(texts), self.dimension)}")
        return got


#: Texts of similar length are encoded together, so many and of so many characters.
BATCH_TEXTS, BATCH_CHARACTERS = 256, 1 << 18


def contained(embedder: Embedder, texts: list[str]) -> list[np.ndarray | None]:
    """Embeddings of a batch; None for a text that the encoder fails on.  A batch
    that fails is halved down to the text at fault, so the others lose nothing."""
    if not texts:
        return []
    try:
        got = np.asarray(embedder.encode(texts), np.float32)
        if got.shape != (len(texts), embedder.dimension):
            raise ValueError(f"{embedder.name} gave {got.shape}")
        return list(got)
    except Exception:  # whatever a plugged-in model raises
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return contained(embedder, texts[:half]) + contained(embedder, texts[half:])


def by_length(texts: list[str]) -> Iterator[list[int]]:
    """Places of the texts in batches, the shortest texts first."""
    batch, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if batch and (len(batch) == BATCH_TEXTS or size + len(texts[i]) > BATCH_CHARACTERS):
            yield batch
            batch, size = [], 0
        batch.append(i)
        size += len(texts[i])
    if batch:
        yield batch


def encode_or_null(df: DataFrame, embedder: Embedder, text_col: str, out: str, prefix: bool = True) -> DataFrame:
    """Adds the embedding of each text: the zero vector for an empty one, null
    where the encoder failed."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in parts:
            texts = column.tolist()
            found: list[np.ndarray | None] = [np.zeros(embedder.dimension, np.float32)] * len(texts)
            some = [i for i, t in enumerate(texts) if t != ""]
            for batch in by_length([texts[i] for i in some]):
                places = [some[i] for i in batch]
                for i, vector in zip(places, contained(embedder, [texts[i] for i in places]), strict=True):
                    found[i] = vector
            yield pd.Series(found, dtype=object)

    batches.bounded(df.sparkSession)
    # So declared, it isn't run once more for a filter on its result.
    once = run.asNondeterministic()
    return df.withColumn(out, once(T.embed_input(text_col) if prefix else T.text_of(text_col)))


def _zeros(embedder: Embedder) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), embedder.dimension)


def encode(df: DataFrame, embedder: Embedder, text_col: str = "text", out: str = "embedding", prefix: bool = True, failed: Observation | None = None) -> DataFrame:
    """Adds the embedding of each text; empty texts, and those that the encoder
    fails on, get the zero vector.  ``failed`` counts the latter."""
    rows = encode_or_null(df, embedder, text_col, out, prefix)
    if failed is not None:
        rows = rows.observe(failed, F.count_if(F.col(out).isNull()).alias("failed"), F.count(F.lit(1)).alias("texts"))
    return rows.withColumn(out, F.coalesce(out, _zeros(embedder)))


def _as_is(keyed: DataFrame) -> DataFrame:
    return keyed


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, text_col: str = "text", dealt: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """Distinct texts that the cache (cache_key, model, vector) lacks.  ``dealt``
    deals rows by key as the cache is, where it is dealt."""
    keyed = texts.select(T.cache_key(text_col).alias("cache_key"), T.text_of(text_col).alias(text_col))
    keyed = dealt(keyed).dropDuplicates(["cache_key"])
    return keyed.join(cache.where(F.col("model") == model).select("cache_key"), "cache_key", "left_anti")


def with_cached(df: DataFrame, embedder: Embedder, cache: DataFrame, text_col: str = "text", dealt: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """Rows with their key and their vector, zeros where the cache has none."""
    keyed = dealt(df.withColumn("cache_key", T.cache_key(text_col)))
    of_model = cache.where(F.col("model") == embedder.name).select("cache_key", "vector")
    return keyed.join(of_model, "cache_key", "left").withColumn("vector", F.coalesce("vector", _zeros(embedder)))


def encode_cached(df: DataFrame, embedder: Embedder, cache: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Embedded rows and the grown cache: only missing texts are encoded, once."""
    grown = cache.unionByName(encode_missing(df, embedder, cache, text_col))
    return with_cached(df, embedder, grown, text_col), grown


def encode_missing(df: DataFrame, embedder: Embedder, cache: DataFrame, text_col: str = "text", dealt: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """Cache rows of the distinct texts that the cache lacks.  Texts that the
    encoder fails on get no row, and so are tried again by the next run."""
    missing = encode_or_null(cache_misses(df, cache, embedder.name, text_col, dealt), embedder, text_col, "vector")
    return missing.where("vector IS NOT NULL").select("cache_key", F.lit(embedder.name).alias("model"), "vector")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))[0]


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)
