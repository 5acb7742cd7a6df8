"""Toxicity scores (operator 5).

FTRL-proximal logistic regression over hashed word unigrams, bigrams and
skip-bigrams (one word left out), and over each word's first four and five bytes, crude
stems that join inflected forms: each coordinate has its own rate, and the L1
term keeps most weights at zero, so the model that is broadcast is a short list
of (index, weight), at most ``2 ** BITS`` long.

Fitting uses a bounded sample of labelled rows: at most about ``SAMPLE_ROWS``,
chosen by a hash of the id, divided into groups of about ``SHARD_ROWS``, or of
fewer where those would have over ``SHARD_BYTES`` of text, each trained in a
task of its own; the groups' weights are averaged.  Scoring covers every whole
text.

Edge cases: null and empty texts have no features and get the score of the bias
alone; unlabelled rows are only scored; null labels are ignored; an id labelled
twice takes the larger label; without a positive and a negative example the
model is empty and every score is 0; repeated rows are scored each; extra
columns are ignored unless carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, in_parts, inside, map_batches, ngrams, slices, table, text_bytes

BITS = 20
SAMPLE_ROWS = 20_000
SHARD_ROWS = 2_500
SHARD_BYTES = 64 << 20
STEMS = (4, 5)
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
HELD_OUT_MOD = 5  # fixed by the contract
_PUNCTUATION = bytes.maketrans(b".,;:!?\"'()[]{}", b" " * 14)


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature index) of every feature occurrence in the texts.
    Punctuation separates words here, so that a word is itself at a line's end."""
    texts = [t.translate(_PUNCTUATION) for t in texts]
    hashes, counts = hashed_words(texts, lower=True)
    of = np.repeat(np.arange(len(texts)), counts)
    found = [(of, hashes)]
    for stem in STEMS:
        found.append((of, hashed_words(texts, lower=True, prefix=stem)[0] * np.uint64(0x9FB21C651E98DF25 + 2 * stem)))
    pairs = ngrams(hashes, 2)
    ok = inside(counts, 2)
    found.append((of[: len(pairs)][ok], pairs[ok]))
    if len(hashes) > 2:
        ok = inside(counts, 3)
        skips = hashes[:-2] * np.uint64(0xA0761D6478BD642F) + hashes[2:] * np.uint64(0xE7037ED1A0B428DB)
        found.append((of[: len(skips)][ok], skips[ok]))
    shift = np.uint64(64 - bits)
    return np.concatenate([o for o, _ in found]), (np.concatenate([h for _, h in found]) >> shift).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias, which has
    no L1 term."""

    def __init__(self, size: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        active = np.abs(z) > l1
        return np.where(active, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[bytes], labels: list[int], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(index, weight) of the nonzero weights; index ``2 ** bits`` is the bias."""
    size = 1 << bits
    model = Ftrl(size)
    rows = []
    for begin, end in slices(texts):
        of, index = features(texts[begin:end], bits)
        rows += [np.append(np.unique(index[of == i]), size).astype(np.int32) for i in range(end - begin)]
    for _ in range(epochs):
        for at, label in zip(rows, labels, strict=True):
            model.learn(at, label)
    used = np.flatnonzero(model.n)
    w = model.weights(used)
    return used[w != 0], w[w != 0]


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, limit: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """A sample of at most about ``limit`` labelled documents, and about how many
    it has.  It is drawn from the labels alone, so it is small before it meets
    the texts."""
    known = labels.where(usable & F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col(id_col)), F.lit(1 << 30))
    known = known.where(draw < F.lit(int((1 << 30) * min(1.0, limit / max(1, n)))))
    known = known.select(F.col(id_col).alias("labelled_id"), "toxic")
    # Broadcast: at most about ``limit`` rows, as just counted.
    texts = docs.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(known), F.col("text_id") == F.col("labelled_id"))
    return rows.select("labelled_id", "text", "toxic"), min(n, limit)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    rows, n = training_rows(docs, labels, usable, limit, id_col, text_col)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, round(n / SHARD_ROWS), -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "labelled_id"), F.lit(shards)).cast("int")

    def train_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort([zlib.crc32(str(i).encode()) for i in pdf["labelled_id"]], kind="stable")]
        labels = [int(y) for y in pdf["toxic"]]
        index, weight = (np.empty(0, np.int64), np.empty(0))
        if len(set(labels)) == 2:
            index, weight = train([(t or "").encode() for t in pdf["text"]], labels)
        return pd.DataFrame({"i": index.astype(np.int64), "w": weight})

    parts = rows.withColumn("shard", shard).groupBy("shard").applyInPandas(train_shard, "i bigint, w double")
    bias = 1 << BITS
    got = parts.groupBy("i").agg(F.sum("w").alias("w"), F.count("*").alias("n")).toPandas()
    # Each trained group has a bias: their number is the divisor.
    trained = int(got.loc[got["i"] == bias, "n"].sum())
    return got["i"].to_numpy(np.int64), got["w"].to_numpy() / max(1, trained)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the ``carry`` columns and the score of each document."""
    sc = docs.sparkSession.sparkContext
    size = 1 << BITS
    sent = sc.broadcast(model)  # at most 2 ** BITS + 1 pairs
    fields = docs.select(F.col(id_col).alias("doc_id"), *carry).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight = sent.value
        dense = np.zeros(size + 1)
        dense[index] = weight
        bias = dense[size]
        for batch in in_parts(batches, 1 + len(carry)):
            texts = text_bytes(batch.column(1 + len(carry)))
            out = np.zeros(len(texts))
            for begin, end in slices(texts):
                of, at = features(texts[begin:end])
                hit = np.flatnonzero(dense[at])
                once = np.unique(of[hit] * np.int64(size) + at[hit])
                out[begin:end] = np.bincount(once // size, dense[once % size], end - begin)
            scores = _sigmoid(out + bias) if len(index) else out
            columns = [batch.column(i) for i in range(1 + len(carry))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], ["doc_id", *carry, "score"])

    return map_batches(docs.select(id_col, *carry, F.col(text_col).alias("_text_")), run, f"{ddl}, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_MOD == 0


def op5_toxicity_scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
