"""SimHash near-duplicates by anchor-point covering (operator 11).

A fingerprint has 64 bits; bit i is 1 if it is set in over half of the hashes
(XXH64, seed 42) of the text's word shingles, repeats included.  Fingerprints at
``THRESHOLD`` = 3 or fewer differing bits are linked.

Anchors are the words of a covering code over 46 of the bits: two binary Golay
codes of 23 bits side by side, 2^24 words.  The Golay code is perfect: every
23-bit word is within radius 3 of exactly one code word, its home.  So each
fingerprint has one home anchor, and it also visits every anchor within the
covering radius plus the threshold, counted by block: an anchor's excess in a
block is its distance there beyond 3, and the two excesses add up to 3 at most.
If x and y differ in three bits or fewer, each block's distance from y to x's
home is at most 3 plus their difference there, so y visits the home of x: every
link is found at an anchor, where homes are compared with visitors by all 64
bits.  A fingerprint has 301 anchors on average, whatever the corpus.

1. Equal fingerprints are one class; its least doc_id stands for it.
2. The anchors that are someone's home are marked in 2^24 bits (2 MB, whatever
   the corpus); visits to others are not sent.
3. Visits are packed by cell, some hundred thousand to a task.  An anchor that is
   home to more than ``BLOCK`` fingerprints is hot: its homes are divided into
   blocks and its visitors too, and each pair of blocks meets in a unit of its
   own.  Hot anchors are ``MAX_HOT`` at most.
4. A cell's links leave it as a forest, at most one edge a fingerprint.
5. Components over the classes, joined back to all documents.

Edge cases: null, empty and wordless texts have fingerprint zero and are linked
like any other; with fewer words than a shingle the whole sequence is one; rows
of one doc_id hang together through it; a row without doc_id takes the least id
of its component, null if that has none; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, join_bounded, map_batches, materialize, mix, table, text_bytes
from .components import connected_components

SHINGLE = 3
SEED = 42
THRESHOLD = 3
# Fixed values of the binary Golay code: length, dimension, covering radius, and
# the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
LENGTH, DIMENSION, RADIUS, GENERATOR = 23, 12, 3, 0b110001110101
ANCHORS = 1 << (2 * DIMENSION)
COPIES = 302  # a fingerprint's visits on average, and its stay at home
BLOCK = 2_000  # homes of an anchor that a unit takes
VISITOR_BLOCKS = 8  # of a hot anchor, for each block of its homes
MAX_HOT = ANCHORS // 64
CELL = 400_000  # visits a task
STEP = 2_000  # fingerprints expanded at once
PAIRS = 1 << 20  # compared at once
MAX_BROADCAST_ROWS = 1_000_000
_HASHES = 1 << 16  # shingles hashed at once


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    words = text.lower().split()  # of bytes: A-Z alone, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(n, len(words))
    begins = np.concatenate([[0], ends[: len(words) - width] + 1]).tolist()
    stops = ends[width - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begins), _HASHES):
        found = [digest(joined[a:b], SEED) for a, b in zip(begins[at : at + _HASHES], stops[at : at + _HASHES], strict=True)]
        bits = np.unpackbits(np.array(found, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begins), bitorder="little").view(np.uint64)[0])


# --- the covering code ----------------------------------------------------------


def _remainder(words: np.ndarray) -> np.ndarray:
    """Words of 23 bits modulo the generator: 11 bits, the same for all words of
    a coset of the code."""
    out = words.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - (LENGTH - DIMENSION))), out)
    return out


@functools.lru_cache(maxsize=1)
def _cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The patterns of up to RADIUS + THRESHOLD bits, ordered by coset and excess,
    and the first place and number of each (coset, excess)."""
    patterns = np.array([sum(1 << b for b in c) for k in range(RADIUS + THRESHOLD + 1) for c in itertools.combinations(range(LENGTH), k)], np.int64)
    excess = np.maximum(np.bitwise_count(patterns).astype(np.int64) - RADIUS, 0)
    key = _remainder(patterns) * (THRESHOLD + 1) + excess
    order = np.argsort(key, kind="stable")
    count = np.bincount(key, minlength=(THRESHOLD + 1) << (LENGTH - DIMENSION))
    first = np.cumsum(count) - count
    return patterns[order], first.reshape(-1, THRESHOLD + 1), count.reshape(-1, THRESHOLD + 1)


def _blocks(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << LENGTH) - 1)
    return (fps & mask).astype(np.int64), (fps >> np.uint64(LENGTH) & mask).astype(np.int64)


def homes(fps: np.ndarray) -> np.ndarray:
    """The home anchor of each fingerprint.  A code word is told by its upper 12 bits."""
    patterns, first, _ = _cosets()
    a, b = (w ^ patterns[first[_remainder(w), 0]] for w in _blocks(fps))
    return a >> (LENGTH - DIMENSION) << DIMENSION | b >> (LENGTH - DIMENSION)


def visits(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the fingerprint, anchor) of all anchors that fingerprints visit."""
    patterns, first, count = _cosets()
    one, two = _blocks(fps)
    s, t = _remainder(one), _remainder(two)
    rows, anchors = [], []
    for e in range(THRESHOLD + 1):
        for f in range(THRESHOLD + 1 - e):
            n = count[s, e] * count[t, f]
            row = np.repeat(np.arange(len(fps)), n)
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            width = count[t, f][row]
            a = one[row] ^ patterns[first[s, e][row] + within // np.maximum(width, 1)]
            b = two[row] ^ patterns[first[t, f][row] + within % np.maximum(width, 1)]
            rows.append(row)
            anchors.append(a >> (LENGTH - DIMENSION) << DIMENSION | b >> (LENGTH - DIMENSION))
    return np.concatenate(rows), np.concatenate(anchors)


# --- the search -------------------------------------------------------------------


def fingerprints(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number), home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            fps = np.array([fingerprint(t, n) for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), pa.array(homes(fps).astype(np.int32))], ["doc_id", "fp", "home"])

    return map_batches(docs.select(id_col, text_col), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint, home int")


def units(fps: np.ndarray, occupied: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, fingerprint) of all meetings; a unit's lowest bit is 1 for homes.
    ``hot`` anchors, ordered, have ``parts`` blocks of homes each."""
    row, anchor = visits(fps)
    ok = occupied[anchor >> 3] >> (anchor & 7) & 1 > 0
    row, anchor = row[ok], anchor[ok]
    at_home = np.concatenate([np.zeros(len(row), bool), np.ones(len(fps), bool)])
    row, anchor = np.concatenate([row, np.arange(len(fps))]), np.concatenate([anchor, homes(fps)])
    own = fps[row]
    if not len(hot):
        return anchor.astype(np.uint64) << np.uint64(1) | at_home, own
    place = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
    p = np.where(hot[place] == anchor, parts[place], 0)
    cold = p == 0
    out, who = [anchor[cold].astype(np.uint64) << np.uint64(1) | at_home[cold]], [own[cold]]
    drawn = (mix(own) >> np.uint64(8)).astype(np.int64)
    for home in (False, True):
        # A home meets every block of visitors, a visitor every block of homes.
        some = np.flatnonzero(~cold & (at_home == home))
        times = p[some] * VISITOR_BLOCKS if home else p[some]
        mine = drawn[some] % p[some] if home else drawn[some] % (p[some] * VISITOR_BLOCKS)
        each = np.repeat(np.arange(len(some)), times)
        other = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        i, j = (mine[each], other) if home else (other, mine[each])
        key = mix(anchor[some][each].astype(np.uint64) << np.uint64(32) ^ (i * (1 << 16) + j).astype(np.uint64)) | np.uint64(1 << 63)
        out.append(key & ~np.uint64(1) | np.uint64(home))
        who.append(own[some][each])
    return np.concatenate(out), np.concatenate(who)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as stars: each node but the least of its component, and that."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    apart = root != np.arange(len(nodes))
    return nodes[apart], nodes[root[apart]]


def near_pairs(unit: np.ndarray, fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The links of one task's units, as a forest; homes meet the visitors."""
    order = np.argsort(unit, kind="stable")
    unit, fps = unit[order], fps[order]
    edges = np.flatnonzero(np.diff(unit >> np.uint64(1), prepend=~(unit[:1] >> np.uint64(1)), append=~(unit[-1:] >> np.uint64(1))))
    begin, end = edges[:-1], edges[1:]
    middle = end - np.add.reduceat((unit & np.uint64(1)).astype(np.int64), begin) if len(begin) else begin
    found = [(np.empty(0, np.uint64), np.empty(0, np.uint64))]
    # A stretch of a unit is one of its homes and all its visitors.
    home = np.concatenate([np.arange(m, e) for m, e in zip(middle.tolist(), end.tolist(), strict=True)] or [begin])
    of = np.repeat(np.arange(len(begin)), end - middle)
    low, n = begin[of], (middle - begin)[of]
    cut = np.cumsum(n) // PAIRS
    for part in np.split(np.arange(len(home)), np.flatnonzero(np.diff(cut)) + 1) if len(home) else []:
        for at in range(0, int(n[part].max(initial=0)), PAIRS):  # one home's visitors may be many
            some = np.clip(n[part] - at, 0, PAIRS)
            x = np.repeat(home[part], some)
            y = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[part] + at, some)
            near = (np.bitwise_count(fps[x] ^ fps[y]) <= threshold) & (fps[x] != fps[y])
            found.append(forest(fps[x[near]], fps[y[near]]))
    return forest(*(np.concatenate(z) for z in zip(*found, strict=True)))


def _hot(per_home: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors with too many homes for a unit, and into how many blocks they are
    divided.  At most ``MAX_HOT``, as each has more than n / MAX_HOT homes."""
    block = max(BLOCK, -(-n // MAX_HOT))
    found = sorted((r["home"], -(-r["n"] // block)) for r in per_home.where(F.col("n") > block).collect())
    return np.array([h for h, _ in found], np.int64), np.array([p for _, p in found], np.int64)


def links(classes: DataFrame) -> DataFrame:
    """a, b: a forest over the linked fingerprints of classes (fp, home)."""
    spark, n = classes.sparkSession, classes.count()
    per_home = materialize(classes.groupBy("home").agg(F.count("*").alias("n")), "sim-homes")
    marks = per_home.groupBy(F.shiftright("home", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, home & 31)")).alias("bits"))
    occupied = np.zeros(ANCHORS // 32, np.uint32)
    for r in marks.toLocalIterator():  # at most ANCHORS / 32 rows, 2 MB of bits
        occupied[r["word"]] = r["bits"]
    occupied = occupied.view(np.uint8)
    hot, parts = _hot(per_home, n)
    # Visits are spread evenly over anchors; hot ones add their blocks.
    share = int(np.bitwise_count(occupied).sum()) / ANCHORS
    cells = max(1, int(n * (1 + COPIES * share) + (parts**2 * VISITOR_BLOCKS * BLOCK).sum()) // CELL)
    sent = spark.sparkContext.broadcast((occupied, hot, parts))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), STEP):
                unit, own = units(fps[at : at + STEP], *sent.value)
                cell = (mix(unit >> np.uint64(1)) % np.uint64(cells)).astype(np.int64)
                order = np.argsort(cell, kind="stable")
                unit, own, cell = unit[order], own[order], cell[order]
                edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
                rows = [(int(cell[b]), unit[b:e].tobytes(), own[b:e].tobytes()) for b, e in itertools.pairwise(edges.tolist())]
                if rows:
                    kinds = pa.int64(), pa.binary(), pa.binary()
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["cell", "unit", "fp"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        unit, fps = (np.frombuffer(b"".join(pdf[c]), np.uint64) for c in ("unit", "fp"))
        a, b = near_pairs(unit, fps)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    met = map_batches(classes.select("fp"), meet, "cell bigint, unit binary, fp binary")
    return materialize(met.groupBy("cell").applyInPandas(compare, "a bigint, b bigint"), "sim-links")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of each document."""
    seen = materialize(fingerprints(docs, n, id_col, text_col), "sim-fingerprints")
    classes = materialize(seen.groupBy("fp", "home").agg(F.min("doc_id").alias("rep")), "sim-classes")
    # Rows of one doc_id with different texts hang together through the id.
    same_id = seen.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")
    same_id = seen.join(same_id, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b"))
    at = connected_components(links(classes).unionByName(same_id)).withColumnRenamed("node", "fp")
    reps = classes.join(at, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    reps = materialize(reps.select("fp", "rep", "component"), "sim-components")
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    reps = materialize(reps.join(least, "component").select("fp", "component_id"), "sim-least")
    joined = join_bounded(seen.select("doc_id", "fp"), reps, "fp", "inner", MAX_BROADCAST_ROWS)
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_anchor_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
