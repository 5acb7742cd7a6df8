"""What the operators share: reading, durable intermediate tables, word hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import delete_path, file_system, session_folder

# The white space that separates words, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"

_NEWLINE = 10
_SLICE_BYTES = 1 << 19
PART_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the folder that all executors share; what is written
    there goes when the session has ended."""
    return session_folder(spark, label)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    files, target = file_system(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(target)) if files.exists(target) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete or not there: written aside and renamed."""
    files, aside = file_system(spark, f"{path}.part")
    out = files.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(aside, file_system(spark, path)[1]):
        raise OSError(f"can't rename to {path}")


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that wasn't there; False if it was.  Of several that try at
    once, one succeeds."""
    files, target = file_system(spark, path)
    try:
        out = files.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
            raise
        return False
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    files, target = file_system(spark, path)
    stream = files.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that
    survives lost executors.  The table is deleted once the session has ended."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_bounded(left: DataFrame, right: DataFrame, on, how: str, max_rows: int) -> DataFrame:
    """Broadcast ``right`` only once its counted size is at most ``max_rows``;
    above that Spark shuffles both sides (adaptive execution splits hot keys).
    ``right`` should be materialized, as it is counted first."""
    if right.limit(max_rows + 1).count() <= max_rows:
        right = F.broadcast(right)
    return left.join(right, on, how)


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes: the executor's JVM holds a
    batch outside its heap, and ten thousand long texts would be a large one.
    It is a setting of the session, made only where that still has Spark's
    default (67108864b)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, str(PART_BYTES))
    return df.mapInArrow(function, schema)


def in_parts(batches: Iterable[pa.RecordBatch], column: int, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``limit`` bytes of text (a longer text is a
    part of its own), so that a worker's Python objects stay few."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.flatnonzero(np.diff(np.cumsum(sizes) // limit, prepend=-1, append=-1))
        for begin, end in zip(edges.tolist(), edges.tolist()[1:], strict=False):
            yield batch.slice(begin, end - begin)
        pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# --- vectorized word hashing -------------------------------------------------
# A word's hash is sum(T[byte] * R[position]) over its bytes, mod 2**64, with
# random odd R, then mixed: no Python object per word.

_rng = np.random.Generator(np.random.PCG64(20240229))
_T = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_T_LOWER = _T.copy()
_T_LOWER[65:91] = _T[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_R = np.empty(0, np.uint64)
_STEP = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    global _R
    if len(_R) < n:
        grown = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, max(64, 2 * n), dtype=np.uint64)
        _R = grown * np.uint64(2) + np.uint64(1)
    return _R


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift and odd multiplications)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD1B54A32D192ED03)
    return h ^ (h >> np.uint64(32))


def word_spans(buf: np.ndarray, lower: bool = False, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word in a byte buffer.  With ``prefix`` the
    hash covers a word's first so many bytes."""
    space = np.empty(len(buf) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _IS_SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    letters = buf[~space[1:-1]]
    hashed = lengths
    if prefix is not None:
        head = within < prefix
        letters, within, hashed = letters[head], within[head], np.minimum(lengths, prefix)
        first = np.cumsum(hashed) - hashed
    terms = (_T_LOWER if lower else _T)[letters] * _powers(int(hashed.max()))[within]
    return mix(np.add.reduceat(terms, first) + hashed.astype(np.uint64)), starts, ends


def slices(texts: list[bytes], limit: int = _SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes, so that the
    arrays made per slice stay small whatever the batch size."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def hashed_words(texts: list[bytes], lower: bool = False, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, one after another, and each text's word count."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    hashes, starts, _ = word_spans(joined, lower, prefix)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends_of_text), prepend=0)
    return hashes, counts


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; shorter input has none."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out += hashes[j : j + size] * _STEP[j]
    return mix(out)


def inside(counts: np.ndarray, n: int) -> np.ndarray:
    """Of the n-grams over concatenated texts, which lie within one text."""
    total = int(counts.sum())
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return (left >= n)[: max(0, total - n + 1)]
