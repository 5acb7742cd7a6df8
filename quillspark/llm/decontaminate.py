"""Benchmark decontamination by pigeonhole edit matching (operator 7).

A test item of m words (A-Z lower-cased, white space and edge punctuation
ignored) may differ from a passage by up to k = floor(``error_rate`` * m) word
edits.  Cut into k + 1 pieces, at least one piece of it then occurs unchanged
in the passage.  The first words of each piece are looked up in every document;
each hit that continues as the whole piece names a stretch of the document, and
there Myers' bit-parallel distance decides, with one bit a word.

The items are sent to the executors in blocks of at most ``BLOCK_ITEMS``, each a
pass over the documents, so the broadcast is bounded whatever the benchmark's
size.  Documents are never shuffled; the work per document is vectorized up to
the hits.

Edge cases: null or empty items and texts match nothing; items under
``MIN_WORDS`` words must occur unchanged; several passages of one item in one
document give one row, the best (least distance, then first); equal items match
each; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, in_parts, inside, map_batches, ngrams, slices, table, text_bytes

ERROR_RATE = 0.15
MIN_WORDS = 8
ANCHOR = 4  # words of a piece that are looked up
BLOCK_ITEMS = 20_000
_EDGE = bytes.maketrans(b".,;:!?\"'()[]{}*_`", b" " * 17)


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's count.  Punctuation is white space."""
    return hashed_words([t.translate(_EDGE) for t in texts], lower=True)


def pieces_of(m: int, k: int) -> list[tuple[int, int]]:
    """(start, end) of k + 1 pieces of nearly equal length."""
    cuts = [i * m // (k + 1) for i in range(k + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def budget(m: int, error_rate: float) -> int:
    return int(error_rate * m) if m >= MIN_WORDS else 0


def myers(pattern: list[int], text: list[int]) -> list[int]:
    """Least edits between ``pattern`` and any stretch of ``text`` that ends
    after each position (Myers 1999, with Python's integers as bit vectors)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    plus, minus, score, out = full, 0, m, []
    for w in text:
        eq = where.get(w, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        h_plus = (minus | ~(d0 | plus)) & full
        h_minus = plus & d0
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1) & full
        h_minus = (h_minus << 1) & full
        plus = (h_minus | ~(d0 | h_plus)) & full
        minus = h_plus & d0
        out.append(score)
    return out


def best_match(pattern: list[int], text: list[int], k: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best stretch within k edits, else None."""
    ends = myers(pattern, text)
    if not ends or min(ends) > k:
        return None
    distance = min(ends)
    end = ends.index(distance) + 1
    # Backwards from there, the nearest start with that distance.
    back = myers(pattern[::-1], text[end - 1 :: -1] if end else [])
    return distance, end - 1 - back.index(distance), end


class Items:
    """A block of items with an index of their pieces' first words."""

    def __init__(self, ids: list, texts: list[bytes], error_rate: float):
        codes, counts = word_codes(texts)
        self.ids, self.words, self.k = ids, np.split(codes, np.cumsum(counts)[:-1]) if len(texts) else [], []
        entries: dict[int, list[tuple[int, int, int, int]]] = {}
        for item, words in enumerate(self.words):
            k = budget(len(words), error_rate)
            self.k.append(k)
            if len(words):
                for start, end in pieces_of(len(words), k):
                    q = min(ANCHOR, end - start)
                    key = int(ngrams(words[start : start + q], q)[0])
                    entries.setdefault(q, []).append((key, item, start, end))
        self.by_length = {}
        for q, rows in entries.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            small = np.zeros(1 << 20, bool)  # a first look by 20 bits
            small[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[q] = keys, np.array([r[1:] for r in rows], np.int64), small

    def matches(self, codes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text number, item, distance, start, end), the best of each pair."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        ends = np.cumsum(counts)
        tried = set()
        for q, (keys, rows, small) in self.by_length.items():
            grams = ngrams(codes, q)
            at = np.flatnonzero(small[(grams >> np.uint64(44)).astype(np.int64)])
            at = at[inside(counts, q)[at]]
            low, high = np.searchsorted(keys, grams[at], "left"), np.searchsorted(keys, grams[at], "right")
            for p, lo, hi in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                doc = int(np.searchsorted(ends, p, "right"))
                begin, end = int(ends[doc] - counts[doc]), int(ends[doc])
                for item, start, stop in rows[lo:hi].tolist():
                    words, k = self.words[item], self.k[item]
                    if p + stop - start > end or not np.array_equal(codes[p : p + stop - start], words[start:stop]):
                        continue
                    left, right = max(begin, p - start - k), min(end, p - start + len(words) + k)
                    if (item, left, right) in tried:
                        continue
                    tried.add((item, left, right))
                    if got := best_match(words.tolist(), codes[left:right].tolist(), k):
                        place = (got[0], left + got[1] - begin, left + got[2] - begin)
                        found[doc, item] = min(found.get((doc, item), place), place)
        return [(doc, item, *place) for (doc, item), place in found.items()]


def match_items(
    docs: DataFrame,
    benchmark: DataFrame,
    error_rate: float = ERROR_RATE,
    block_items: int = BLOCK_ITEMS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, distance, start_word, end_word of each contaminated pair."""
    sc = docs.sparkSession.sparkContext
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    item_arrow = pa.from_numpy_dtype("int64") if item_type.simpleString() in ("bigint", "int") else pa.string()
    schema = f"doc_id {id_type}, item_id {item_type.simpleString()}, distance int, start_word bigint, end_word bigint"

    def scan(block) -> DataFrame:
        sent = sc.broadcast(block)  # at most ``block_items`` items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(*sent.value, error_rate)
            for batch in in_parts(batches, 1):
                texts, rows = text_bytes(batch.column(1)), []
                for begin, end in slices(texts):
                    rows += [(begin + d, *rest) for d, *rest in items.matches(*word_codes(texts[begin:end]))]
                of, item, distance, start, stop = zip(*rows, strict=True) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(of, pa.int64())),
                        pa.array([items.ids[i] for i in item], item_arrow).cast(pa.int32() if item_type.simpleString() == "int" else item_arrow),
                        pa.array(distance, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(stop, pa.int64()),
                    ],
                    ["doc_id", "item_id", "distance", "start_word", "end_word"],
                )

        return map_batches(docs.select(id_col, text_col), run, schema)

    out, ids, texts = None, [], []
    rows = benchmark.select(item_col, F.coalesce(F.col(item_text_col), F.lit("")).alias("t")).toLocalIterator()
    for row in itertools.chain(rows, [None]):
        if row is not None:
            ids.append(row[0])
            texts.append(row[1].encode())
        if ids and (row is None or len(ids) == block_items):
            part = scan((ids, texts))
            out, ids, texts = part if out is None else out.unionByName(part), [], []
    return out if out is not None else scan(([], []))


def op7_edit_matches(spark, sf_dir: str) -> DataFrame:
    """Contaminated pairs of ``documents`` and ``benchmark``."""
    return match_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
