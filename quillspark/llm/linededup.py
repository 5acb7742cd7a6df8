"""Line dedup (operator 1).

Pass one builds two blocked Bloom filters over line hashes, one for hashes seen
in a document and one for hashes seen in two.  Each task fills a pair for its
own documents; pairs merge by segment (twice = twice | twice' | once & once'),
so a hash that occurs in two documents is always in the merged "twice" filter.
They merge in a tree: a task holds ``FAN_IN`` segments of a pair, however many
tasks filled one.  A sketch of the number of distinct lines sizes the filters,
at ``BITS_PER_LINE`` each, up to ``MAX_FILTER_WORDS``: that bounds what is
broadcast, and what a task holds.
Pass two sends only suspected lines through a shuffle, pre-aggregated per
batch, where their exact keys (SHA-256) are counted over all documents and the
first occurrence is chosen.  Pass three rewrites the documents.  A filter that
fills up at scale only makes more lines suspects; results stay exact.

The confirmed keys are broadcast while they number at most
``max_broadcast_keys``; beyond, they are joined to the documents through the
suspects of each distinct text.

Edge cases: a null or empty text is one empty line and stays empty; keys
shorter than ``min_chars`` are never dropped; rows that repeat (also with the
same doc_id) count as documents of their own; ties for the first occurrence go
to the smallest (doc_id, line), null ids first; extra columns are ignored
unless carried; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, map_batches, materialize, table, text_bytes

MIN_DOCS = 10  # fixed by the contract
MIN_CHARS = 1
MIN_FILTER_WORDS, MAX_FILTER_WORDS = 1 << 16, 1 << 23  # 64-bit words: at most 64 MB a filter
BITS_PER_LINE = 16
SEGMENT_WORDS = 1 << 17  # 1 MB
FAN_IN = 32
MAX_BROADCAST_KEYS = 200_000


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Lines, and their keys: stripped of ASCII white space, A-Z lower-cased."""
    return text.split(b"\n"), [x.strip() for x in text.lower().split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


class Filter:
    """Blocked Bloom filter: four bits in one 64-bit word."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def place(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.zeros(len(hashes), np.uint64)
        for shift in (0, 6, 12, 18):
            mask |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
        return ((hashes >> np.uint64(24)) % np.uint64(words)).astype(np.int64), mask

    def add(self, hashes: np.ndarray) -> None:
        at, mask = self.place(hashes, len(self.bits))
        np.bitwise_or.at(self.bits, at, mask)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at, mask = self.place(hashes, len(self.bits))
        return (self.bits[at] & mask) == mask


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def filter_size(docs: DataFrame, text_col: str) -> int:
    """Words of a filter, a power of two, by the distinct lines (within 5 %)."""
    lines = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    n = lines.agg(F.approx_count_distinct("line", 0.05)).first()[0]
    wanted = max(1, n * BITS_PER_LINE // 64)
    return min(max(1 << (wanted - 1).bit_length(), MIN_FILTER_WORDS), MAX_FILTER_WORDS)


def twice_filter(docs: DataFrame, text_col: str, min_chars: int, words: int) -> np.ndarray:
    """The merged filter of line hashes that occur in two documents or more."""
    size = min(words, SEGMENT_WORDS)
    segments = words // size

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Filter(np.zeros(words, np.uint64)), Filter(np.zeros(words, np.uint64))
        some = False
        for batch in in_parts(batches, 0):
            some = True
            per_doc = [_hashes({k for k in line_keys(t)[1] if long_enough(k, min_chars)}) for t in text_bytes(batch.column(0))]
            hashes, n = np.unique(np.concatenate([np.empty(0, np.uint64), *per_doc]), return_counts=True)
            twice.add(hashes[(n > 1) | once.has(hashes)])
            once.add(hashes)
        if some:
            packed = [
                [zlib.compress(f.bits[s * size : (s + 1) * size].tobytes(), 1) for s in range(segments)] for f in (once, twice)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(segments), pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["segment", "once", "twice"]
            )

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        for o, t in zip(parts["once"], parts["twice"], strict=True):
            o, t = (np.frombuffer(zlib.decompress(x), np.uint64) for x in (o, t))
            twice |= t | (once & o)
            once |= o
        row = [parts["segment"].iloc[0], parts["part"].iloc[0], *(zlib.compress(x.tobytes(), 1) for x in (once, twice))]
        return pd.DataFrame([row], columns=["segment", "part", "once", "twice"])

    # A task makes a pair of filters, so there are as many tasks as cores can
    # use, not one for each split of the input.
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    built = map_batches(docs.select(text_col).coalesce(tasks), build, "segment int, once binary, twice binary")
    built = built.withColumn("part", F.spark_partition_id())
    for level in itertools.count():
        if level and tasks == 1:
            break
        tasks = -(-tasks // FAN_IN)
        built = built.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("segment", "part")
        built = built.applyInPandas(merge, "segment int, part int, once binary, twice binary")
    # At most MAX_FILTER_WORDS reach the driver, which broadcasts them.
    merged = built.select("segment", "twice").collect()
    out = np.zeros(words, np.uint64)
    for r in merged:
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(zlib.decompress(r["twice"]), np.uint64)
    return out


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, seen) -> DataFrame:
    """Exact keys in at least ``min_docs`` documents, with their count and first
    occurrence.  ``seen`` is the broadcast "twice" filter."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Filter(seen.value)
        for batch in in_parts(batches, 1):
            # Of each part one row a key goes on: its documents and first place.
            found: dict[bytes, list] = {}
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, text_bytes(batch.column(1)), strict=True):
                first: dict[bytes, int] = {}
                for i, key in enumerate(line_keys(text)[1]):
                    if long_enough(key, min_chars):
                        first.setdefault(key, i)
                keys = list(first)
                for k in np.flatnonzero(twice.has(_hashes(keys))):
                    place = (doc_id is not None, doc_id, first[keys[k]])
                    entry = found.setdefault(keys[k], [0, place])
                    entry[0] += 1
                    entry[1] = min(entry[1], place)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(k).digest() for k in found], pa.binary()),
                    pa.array([n for n, _ in found.values()], pa.int64()),
                    pa.array([p[1] for _, p in found.values()], batch.schema.field(0).type),
                    pa.array([p[2] for _, p in found.values()], pa.int64()),
                ],
                ["key", "n", "first_id", "first_line"],
            )

    got = map_batches(docs.select(id_col, text_col), suspects, f"key binary, n bigint, first_id {id_type}, first_line bigint")
    return (
        got.groupBy("key")
        .agg(F.sum("n").alias("n_docs"), F.min(F.struct("first_id", "first_line")).alias("first"))
        .where(F.col("n_docs") >= min_docs)
        .select("key", "n_docs", "first.first_id", "first.first_line")
    )


def _rewrite(docs: DataFrame, id_col: str, text_col: str, carry: list[str], min_chars: int, keep_first: bool, keep_copies: bool, seen, known) -> DataFrame:
    """Drop lines.  The repeated keys come from ``known`` (a broadcast dict), or
    else from the documents' own column ``repeated``."""
    schema = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carry).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Filter(seen.value)
        for batch in in_parts(batches, 1):
            texts, n_lines, n_dropped = [], [], []
            ids = batch.column(0).to_pylist()
            rows = [None] * len(ids) if known is not None else batch.column(batch.num_columns - 1).to_pylist()
            for doc_id, text, own in zip(ids, text_bytes(batch.column(1)), rows, strict=True):
                lines, keys = line_keys(text)
                listed = known.value if known is not None else {r["key"]: (r["first_id"], r["first_line"]) for r in own or []}
                keep, here = np.ones(len(lines), bool), np.zeros(len(lines), bool)
                if listed:
                    for i in np.flatnonzero(twice.has(_hashes(keys))):
                        if long_enough(keys[i], min_chars):
                            first = listed.get(hashlib.sha256(keys[i]).digest())
                            here[i] = first == (doc_id, int(i))
                            keep[i] = first is None or (keep_first and here[i])
                if keep_copies and not keep.all():
                    if not any(k for k, stays in zip(keys, keep, strict=True) if stays):
                        keep[:] = True
                    elif 2 * sum(len(x) for x, stays in zip(lines, keep, strict=True) if not stays) > sum(map(len, lines)):
                        keep |= here
                texts.append(text if keep.all() else b"\n".join(x for x, k in zip(lines, keep, strict=True) if k))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - int(keep.sum()))
            arrays = [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), *(batch.column(2 + i) for i in range(len(carry)))]
            arrays += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", *carry, "n_lines", "n_dropped"])

    columns = [id_col, text_col, *carry] + ([] if known is not None else ["repeated"])
    return map_batches(docs.select(columns), rewrite, f"{fields}, n_lines bigint, n_dropped bigint")


def _with_repeated(docs: DataFrame, text_col: str, repeated: DataFrame, min_chars: int, seen) -> DataFrame:
    """The other way than broadcasting: each distinct text's suspected keys are
    joined to the repeated keys and collected per text (never over its lines)."""

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Filter(seen.value)
        for batch in in_parts(batches, 0):
            of, keys = [], []
            for text in set(text_bytes(batch.column(0))):
                own = list({k for k in line_keys(text)[1] if long_enough(k, min_chars)})
                hit = [hashlib.sha256(own[i]).digest() for i in np.flatnonzero(twice.has(_hashes(own)))]
                of += [hashlib.sha256(text).hexdigest()] * len(hit)
                keys += hit
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(keys, pa.binary())], ["of_text", "key"])

    pairs = map_batches(docs.select(text_col), suspects, "of_text string, key binary").distinct()
    per_text = pairs.join(repeated, "key").groupBy("of_text").agg(F.collect_list(F.struct("key", "first_id", "first_line")).alias("repeated"))
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    return docs.join(per_text, digest == F.col("of_text"), "left")


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 2,
    min_chars: int = MIN_CHARS,
    keep_first: bool = True,
    carry: tuple[str, ...] = (),
    filter_words: int | None = None,
    max_broadcast_keys: int = MAX_BROADCAST_KEYS,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_copies: bool = False,
) -> DataFrame:
    """Documents without the lines whose key is in ``min_docs`` documents.

    With ``keep_first`` the first occurrence of such a line stays.  With
    ``keep_copies`` a text of nothing but such lines stays whole, and one that
    would lose more than half of its bytes keeps the lines that occur first in
    it: they are copies of texts, which is not for a line count to decide.
    ``filter_words`` sets the size of a filter, a power of two.  Returns doc_id,
    text (what is left), the ``carry`` columns, n_lines, n_dropped.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select(id_col, text_col, *carry)
    seen = sc.broadcast(twice_filter(docs, text_col, min_chars, filter_words or filter_size(docs, text_col)))
    repeated = materialize(repeated_lines(docs, id_col, text_col, min_docs, min_chars, seen), "repeated-lines")
    known = None
    if repeated.limit(max_broadcast_keys + 1).count() <= max_broadcast_keys:
        rows = repeated.select("key", "first_id", "first_line").collect()
        known = sc.broadcast({bytes(r["key"]): (r["first_id"], r["first_line"]) for r in rows})
    else:
        docs = _with_repeated(docs, text_col, repeated, min_chars, seen)
    return _rewrite(docs, id_col, text_col, list(carry), min_chars, keep_first, keep_copies, seen, known)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    got = dedup_lines(table(spark, sf_dir, "documents"), MIN_DOCS, MIN_CHARS, keep_first=False)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT rid, doc_id, i, x, translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (
    SELECT rid, doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS x
    FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
  )
), r AS (
  SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(r.k) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (r.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN r USING (k) GROUP BY rid
"""
