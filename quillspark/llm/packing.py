"""Best-fit packing by minimum bin slack (operator 8).

Documents are tokenized, followed by a separator id, and cut into pieces of at
most ``capacity`` ids.  Bins are then planned on the histogram of piece lengths:
the longest length left is placed, and subset-sum dynamic programming over the
lengths available, on bitsets, finds the combination that fills the bin most.
That combination is removed, as often as the counts left allow it.

The histogram has at most ``capacity`` rows, and each combination uses up at
least one length, so planning costs the same for any corpus; it runs on the
driver.  Pieces are then placed by rank within their length: ranks come from
counts per (length, bucket) and a window within each bucket, so a length that a
third of all pieces share is spread over all buckets.

Edge cases: a null or empty text is the separator alone, one piece of length 1;
pieces of equal length are interchangeable and placed by (doc_id, piece);
repeated rows are packed each; a text above the capacity is cut, nothing is
dropped; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_parts, map_batches, materialize, table, text_bytes

CAPACITY = 4096
SEPARATOR = 1
BUCKET_ROWS = 20_000
_MARK = "<|endoftext|>"
_CACHE_WORDS = 150_000


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other
    bytes for the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class Encoder:
    """Whole-text ids from the ids of parts.

    The vocabulary's splitting never joins text across white space, nor a letter
    or digit with punctuation, so a text's ids are those of its parts in order.
    Parts are kept with their ids.  An unknown part that is one Latin-1 word in
    small letters is already normalized and a single unit, so the vocabulary's
    model takes it as it is; other unknown parts go through the whole tokenizer
    together, separated by a special token.  A text that contains the special
    token's opening is encoded whole.
    """

    _PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
    _POINT = re.compile(rb"[.,;:!?](?=[ \t\n\r\f\v]|\Z)(?:(?<=[a-z0-9].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))")

    def __init__(self, path: str):
        # A task has one core; a pool of threads would only hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.mark = self.tokenizer.token_to_id(_MARK)
        self.chars = _byte_chars()
        self.known: dict[bytes, int] = {}
        self.start = np.zeros(1, np.int64)  # ids of part k: flat[start[k] : start[k + 1]]
        self.flat = np.zeros(0, np.uint32)
        self.used = np.zeros(0, np.int64)

    def _learn(self, parts: list[bytes]) -> None:
        first = len(self.known)
        plain, other = [], []
        for part in parts:
            word = part.decode()
            (plain if self._PLAIN.fullmatch(word) else other).append(word)
        lengths, ids = [], []
        for word in plain:
            text = word if word.isascii() else word.encode().decode("latin-1").translate(self.chars)
            tokens = self.model.tokenize(text)
            lengths.append(len(tokens))
            ids += [t.id for t in tokens]
        texts = [_MARK.join(other[i : i + 256]) for i in range(0, len(other), 256)]
        for run in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            at = -1
            for i in [i for i, x in enumerate(run.ids) if x == self.mark] + [len(run.ids)]:
                lengths.append(i - at - 1)
                at = i
            ids += [x for x in run.ids if x != self.mark]
        for k, word in enumerate(plain + other):
            self.known[word.encode()] = first + k
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.array(lengths, np.int64))])
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
        self.used = np.concatenate([self.used, np.zeros(len(lengths), np.int64)])

    def _forget(self) -> None:
        """Keep the parts that were used most."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: _CACHE_WORDS // 2])
        size = np.diff(self.start)[keep]
        self.flat = self.flat[_spread(self.start[keep], size)]
        self.start = np.append(0, np.cumsum(size))
        names = list(self.known)
        self.known = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.used = self.used[keep] // 2

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > _CACHE_WORDS:
            self._forget()
        whole = [b"<|" in t for t in texts]
        parts = [[] if w else self._POINT.sub(rb" \g<0>", t.lower()).split() for t, w in zip(texts, whole, strict=True)]
        counts = np.array([len(p) for p in parts])
        flat = list(itertools.chain.from_iterable(parts))
        k = np.fromiter(map(self.known.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        if len(new := np.flatnonzero(k < 0)):
            self._learn(list({flat[i] for i in new.tolist()}))
            k[new] = [self.known[flat[i]] for i in new.tolist()]
        self.used += np.bincount(k, minlength=len(self.used))
        size = self.start[k + 1] - self.start[k]
        ids = self.flat[_spread(self.start[k], size)]
        ends = np.append(0, np.cumsum(size))[np.cumsum(counts)]
        out = np.split(ids, ends[:-1]) if len(texts) else []
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].decode(), add_special_tokens=False).ids, np.uint32)
        return out


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of size[0], then of the next."""
    shift = np.repeat(begin - (np.cumsum(size) - size), size)
    return shift + np.arange(len(shift))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process; its cache serves one task after another."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of each piece."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in in_parts(batches, 1):
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                of, number, start, length, crc, ids_of = [], [], [], [], [], []
                for i, ids in enumerate(encode(text_bytes(part.column(1)))):
                    ids = np.append(ids, np.uint32(SEPARATOR)).astype("<u4")
                    for n, at in enumerate(range(0, len(ids), capacity)):
                        piece = ids[at : at + capacity]
                        of.append(i)
                        number.append(n)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        if with_ids:
                            ids_of.append(piece.astype(np.int32))
                columns = [
                    part.column(0).take(pa.array(of, pa.int64())),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return map_batches(docs.select(id_col, text_col), cut, schema)


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, copies) of the combination of available lengths that fills
    ``room`` most, by bitset subset-sum with bounded copies."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    lengths = np.flatnonzero(counts[: room + 1])[::-1]
    for length in lengths.tolist():
        left, take = min(int(counts[length]), room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, copies), ...]) of each combination, in order."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = []
    while len(left := np.flatnonzero(counts)):
        longest = int(left[-1])
        counts[longest] -= 1
        used = dict(fullest(counts, capacity - longest))
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        bins = min(int(counts[length]) // copies for length, copies in used.items())
        for length, copies in used.items():
            counts[length] -= bins * copies
        plan.append((bins, sorted(used.items(), reverse=True)))
    return plan


def placements(plan: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """For each combination and length: the ranks it takes (first, until), its
    copies per bin, its first bin and the offset of the first copy."""
    taken: dict[int, int] = {}
    rows, first_bin = [], 0
    for bins, used in plan:
        offset = 0
        for length, copies in used:
            first = taken.get(length, 0)
            taken[length] = first + bins * copies
            rows.append((length, first, taken[length], copies, first_bin, offset))
            offset += length * copies
        first_bin += bins
    return pd.DataFrame(rows, columns=["length", "first", "until", "copies", "bin", "base"]).sort_values(["length", "first"])


def place(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to each piece.  ``pieces_`` is materialized."""
    histogram = pieces_.groupBy("length").count().collect()  # at most ``capacity`` rows
    at = placements(plan_bins({r["length"]: r["count"] for r in histogram}, capacity))
    length, first = at["length"].to_numpy(np.int64), at["first"].to_numpy(np.int64)
    copies, first_bin, base = (at[c].to_numpy(np.int64) for c in ("copies", "bin", "base"))
    # Sorted by (length, first): one key, for a binary search.
    wide = np.int64(1) << np.int64(48)
    keys = length * wide + first

    @F.pandas_udf("sequence_id long, offset long")
    def placed(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        k = np.searchsorted(keys, size * wide + rank, "right") - 1
        within = rank - first[k]
        return pd.DataFrame({"sequence_id": first_bin[k] + within // copies[k], "offset": base[k] + within % copies[k] * size})

    n = sum(r["count"] for r in histogram)
    buckets = max(1, n // BUCKET_ROWS, min(n, 4 * pieces_.sparkSession.sparkContext.defaultParallelism))
    rows = pieces_.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    # Ranks before a bucket: at most ``capacity`` lengths of each bucket.
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(sizes, ["bucket", "length"])
    return ranked.withColumn("place", placed("length", (F.col("before") + F.col("rank")).cast("long"))).select(
        *pieces_.columns, "place.sequence_id", "place.offset"
    )


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document, with its sequence and its place there."""
    return place(materialize(pieces(docs, vocabulary, capacity, id_col, text_col, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, of a result ``with_ids``.  A
    sequence holds at most ``capacity`` ids, so each group is small."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def op8_bin_slack_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
