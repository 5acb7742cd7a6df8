"""Phrase collocations by contiguous pattern growth (operator 12).

Phrases are 2 to 4 words within a piece of text, counted per language with all
their occurrences.  As in PrefixSpan, a frequent prefix is projected to the
pointers of its occurrences, here what follows each of them, and is extended to
the right depth first; what isn't frequent is never extended.

1. Words are counted.  A word is known by a 64-bit hash of it and its language;
   should two words share one, the hashes are drawn anew.
2. Pairs of frequent words are counted by hash.  The frequent ones go into a
   Bloom filter of bounded size: a pair that is in it by chance costs a few rows.
3. Of each place whose pair may be frequent, the pair and the up to two words
   that follow by pairs that may be frequent travel to the task of the first
   word, pre-aggregated.  That task has the whole projection of the word, and
   grows it.  Prefixes are read one after another from sorted rows, so a task
   holds some hundred thousand rows whatever its share.
4. A word with more than ``HOT`` occurrences is split into its pairs, each whole
   in one task; such a pair is dealt by all four words, and the counts of its
   parts are summed.
5. Cuts, containment and ranks are joins, aggregations and windows over the
   frequent phrases.  The rank first takes each language in parts.

Edge cases: a null or empty text has no words; a null language is ``und``; rows
that repeat count each; an empty table, or one without a phrase frequent enough,
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_parts, join_bounded, map_batches, materialize, mix, table, text_bytes
from .linededup import Filter

MIN_COUNT, LONGEST, TOP = 30, 4, 2_000  # fixed by the contract
SCALE, CONTAINED = 2_000_000, (100, 80)
HOT, MOST_HOT = 50_000, 200_000
FLUSH = 1_500_000  # places a task gathers before it aggregates them
CHUNK = 500_000  # rows of whole prefixes that are grown together
PARTITION_WORDS, MAX_PARTITIONS = 4_000_000, 20_000
MIN_FILTER_WORDS, MAX_FILTER_WORDS, SEGMENT_WORDS = 1 << 10, 1 << 23, 1 << 17  # 64-bit words: at most 64 MB
MAX_BROADCAST_ROWS = 500_000
RANK_PARTS, RANK_ROWS = 64, 1_000_000
_SPACE, _BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"  # fixed by the contract
_KIND = np.zeros(256, np.uint8)
_KIND[list(_SPACE)], _KIND[list(_BREAK)] = 1, 2
_STEP = np.random.Generator(np.random.PCG64(12)).integers(0, 2**63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
W = [f"w{i + 1}" for i in range(LONGEST)]


# --- words of a batch of texts ----------------------------------------------------


@functools.lru_cache(maxsize=8)
def _multipliers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    letters = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return letters, rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(texts: list[bytes], langs: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of all words: id (odd, by word and language), whether the next word is in
    the same piece, text number, start, end; and the bytes they lie in."""
    joined = b"\n".join(texts).lower() + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    kind = _KIND[buf]
    edge = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        empty = np.empty(0, np.int64)
        return empty.astype(np.uint64), empty.astype(bool), empty, starts, ends, joined
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    letters, places = _multipliers(seed, max(64, 1 << int(lengths.max()).bit_length()))
    hashes = np.add.reduceat(letters[buf[kind == 0]] * places[within], first) + lengths.astype(np.uint64)
    breaks = np.concatenate([[0], np.cumsum(kind == 2)])
    follows = np.append(breaks[ends[:-1]] == breaks[starts[1:]], False)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    tongue = np.array([xxhash.xxh3_64_intdigest(x, seed) for x in langs], np.uint64)
    return mix(mix(hashes) ^ tongue[text]) | np.uint64(1), follows, text, starts, ends, joined


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    for batch in in_parts(batches, 1):
        yield text_bytes(batch.column(1)), text_bytes(batch.column(0))


def gram(ids: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(ids[0]), np.uint64)
    for step, own in zip(_STEP, ids, strict=False):
        out += mix(own) * step
    return mix(out)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """id, lang, word, n of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _batches(batches):
            ids, _, text, starts, ends, joined = words(texts, langs, seed)
            found, at, n = np.unique(ids, return_index=True, return_counts=True)
            spelled = [joined[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            columns = [pa.array(found.view(np.int64)), pa.array([langs[t].decode() for t in text[at].tolist()], pa.string()), pa.array(spelled, pa.string()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "word", "n"])

    got = map_batches(docs, run, "id bigint, lang string, word string, n bigint")
    return got.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


# --- pairs, and the filter of the frequent ones -------------------------------------


def bloom(keys: DataFrame, column: str) -> Filter:
    """A filter of the keys (64-bit hashes), built by the executors in segments.
    Rows of words, then of segments, reach the driver: 64 MB at most."""
    wanted = max(1, keys.count() * 16 // 64)
    size = min(max(1 << (wanted - 1).bit_length(), MIN_FILTER_WORDS), MAX_FILTER_WORDS)
    bits = " | ".join(f"shiftleft(1L, int(shiftrightunsigned({column}, {s}) & 63))" for s in (0, 6, 12, 18))
    placed = keys.select(F.expr(f"shiftrightunsigned({column}, 24) % {size}").alias("at"), F.expr(bits).alias("bits"))
    placed = placed.groupBy("at").agg(F.bit_or("bits").alias("bits")).withColumn("segment", F.expr(f"at div {SEGMENT_WORDS}"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(min(size, SEGMENT_WORDS), np.int64)
        own[pdf["at"] % SEGMENT_WORDS] = pdf["bits"]
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "packed": [own.tobytes()]})

    out = np.zeros(size, np.uint64)
    for r in placed.groupBy("segment").applyInPandas(pack, "segment bigint, packed binary").collect():
        own = np.frombuffer(r["packed"], np.uint64)
        out[r["segment"] * SEGMENT_WORDS :][: len(own)] = own
    return Filter(out)


def pair_counts(docs: DataFrame, seed: int, frequent) -> DataFrame:
    """h, n of the pairs of words that the (broadcast) filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Filter(frequent.value), [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        for texts, langs in _batches(batches):
            ids, follows, *_ = words(texts, langs, seed)
            ok = known.has(ids)
            at = np.flatnonzero(follows[:-1] & ok[:-1] & ok[1:])
            held.append(gram([ids[at], ids[at + 1]]))
            size += len(at)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return map_batches(docs, run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


# --- projection and growth ----------------------------------------------------------


def project(docs: DataFrame, seed: int, pairs, hot_words, hot_pairs) -> DataFrame:
    """w1 to w4 (0: none), n, of all places whose pair may be frequent, with the
    key by which they are dealt and whether that only takes a part of the pair."""

    def packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        ids = [np.concatenate(x) for x in zip(*held, strict=True)]
        whole = gram(ids)
        _, at, n = np.unique(whole, return_index=True, return_counts=True)
        ids, whole = [x[at] for x in ids], whole[at]
        pair = gram(ids[:2])
        split = np.isin(pair, hot_pairs.value)
        key = np.where(split, whole, np.where(np.isin(ids[0], hot_words.value), pair, ids[0]))
        columns = [*(x.view(np.int64) for x in ids), n, key.view(np.int64), split]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [*W, "n", "key", "split"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Filter(pairs.value), [], 0
        for texts, langs in _batches(batches):
            ids, follows, *_ = words(texts, langs, seed)
            # goes[i]: the pair of words i and i + 1 may be frequent.
            goes = np.zeros(len(ids) + 2, bool)
            goes[: max(0, len(ids) - 1)] = follows[:-1]
            at = np.flatnonzero(goes)
            goes[at] = known.has(gram([ids[at], ids[at + 1]]))
            at = np.flatnonzero(goes)
            ids = np.concatenate([ids, np.zeros(2, np.uint64)])
            third = goes[at + 1]
            fourth = third & goes[at + 2]
            held.append([ids[at], ids[at + 1], np.where(third, ids[at + 2], np.uint64(0)), np.where(fourth, ids[np.minimum(at + 3, len(ids) - 1)], np.uint64(0))])
            size += len(at)
            if size > FLUSH:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return map_batches(docs, run, ", ".join(f"{w} bigint" for w in W) + ", n bigint, key bigint, split boolean")


def _runs(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys; first place, end and total of each equal run of it."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order], prepend=~keys[order][:1], append=~keys[order][-1:]))
    return order, edges[:-1], edges[1:], np.add.reduceat(n[order], edges[:-1]) if len(keys) else n


def grow(ids: list[np.ndarray], n: np.ndarray, least: int) -> list[tuple]:
    """(w1, ..., wk, 0..., count) of the frequent phrases of two words or more
    that start at the given places, by extending prefixes depth first."""
    out: list[tuple] = []

    def extend(prefix: tuple, rows: np.ndarray) -> None:
        depth = len(prefix)
        keys, own = ids[depth][rows], n[rows]
        order, first, end, total = _runs(keys, own)
        for a, b, count in zip(first.tolist(), end.tolist(), total.tolist(), strict=True):
            if count < least:
                continue
            longer = (*prefix, int(keys[order[a]]))
            if depth:
                out.append((*longer, *[0] * (LONGEST - len(longer)), count))
            if depth + 1 < LONGEST:
                projected = rows[order[a:b]]
                projected = projected[ids[depth + 1][projected] != 0]
                if int(n[projected].sum()) >= least:
                    extend(longer, projected)

    extend((), np.arange(len(n)))
    return out


def parts_of_hot(ids: list[np.ndarray], n: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Counts of all phrases at the given places, of two words, three and four."""
    for depth in range(2, LONGEST + 1):
        some = np.flatnonzero(ids[depth - 1] != 0)
        order, first, _, total = _runs(gram([x[some].view(np.uint64) for x in ids[:depth]]), n[some])
        at = some[order[first]]
        yield [x[at] if k < depth else np.zeros(len(at), np.int64) for k, x in enumerate(ids)], total


def phrase_counts(places: DataFrame, least: int, partitions: int) -> DataFrame:
    """w1 to w4, f of the frequent phrases of two words and more."""

    def work(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        split = rows["split"].to_numpy()
        whole = rows[~split]
        found = np.array(grow([whole[w].to_numpy() for w in W], whole["n"].to_numpy(), least), np.int64).reshape(-1, LONGEST + 1)
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in found.T), pa.array(np.zeros(len(found), bool))], [*W, "f", "split"])
        hot = rows[split]
        for ids, total in parts_of_hot([hot[w].to_numpy() for w in W], hot["n"].to_numpy()):
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in ids), pa.array(total), pa.array(np.ones(len(total), bool))], [*W, "f", "split"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.to_pandas())
            size += len(batch)
            if size >= CHUNK:
                rows = pd.concat(held)
                # The last key may go on in the next batch.
                last = int((rows["key"] != rows["key"].iloc[-1]).sum())
                if last:
                    yield from work(rows.iloc[:last])
                held, size = [rows.iloc[last:]], len(rows) - last
        if held:
            yield from work(pd.concat(held))

    dealt = places.repartition(partitions, "key").sortWithinPartitions("key")
    found = materialize(dealt.mapInArrow(run, ", ".join(f"{w} bigint" for w in W) + ", f bigint, split boolean"), "phrase-found")
    summed = found.where("split").groupBy(*W).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return materialize(found.where("NOT split").select(*W, "f").unionByName(summed), "phrase-counts")


# --- scores, containment, ranks -----------------------------------------------------


def _slices(cuts: list[tuple]) -> F.Column:
    """Array of structs (name, from, to) of words, as columns padded with 0."""
    zero = F.lit(0).cast("bigint")
    made = []
    for size, k, spans in cuts:
        fields = [F.lit(k).alias("k")]
        for name, low, high in spans:
            fields += [(F.col(W[low + i]) if low + i < high else zero).alias(f"{name}{i + 1}") for i in range(LONGEST)]
        made.append(F.when(F.col("size") == size, F.struct(*fields)))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def best_cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates with l, r and score of their lowest-scoring cut."""
    cuts = [(size, k, [("a", 0, k), ("b", k, size)]) for size in range(2, LONGEST + 1) for k in range(1, size)]
    rows = candidates.select(*W, F.col("f").alias("a"), F.explode(_slices(cuts)).alias("cut")).select(*W, "a", "cut.*")
    for side, name in (("a", "l"), ("b", "r")):
        of = counts.select(*(F.col(w).alias(f"{side}{i + 1}") for i, w in enumerate(W)), F.col("f").alias(name))
        rows = join_bounded(rows, of, [f"{side}{i + 1}" for i in range(LONGEST)], "inner", MAX_BROADCAST_ROWS)
    wide = F.col("a").cast("decimal(19,0)") * F.lit(SCALE)
    score = F.call_function("div", wide, F.col("l").cast("decimal(19,0)") + F.col("r"))
    best = rows.withColumn("score", score).groupBy(*W).agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select(*W, "a", "best.score", "best.l", "best.r")


def not_contained(candidates: DataFrame) -> DataFrame:
    """Candidates without a longer one around them that is nearly as frequent."""
    inner = [(size, low, [("s", low, high)]) for size in range(3, LONGEST + 1) for low in range(size) for high in range(low + 2, size + 1) if high - low < size]
    rows = candidates.where("size > 2").select("f", F.explode(_slices(inner)).alias("x"))
    around = rows.groupBy(*(F.col(f"x.s{i + 1}").alias(w) for i, w in enumerate(W))).agg(F.max("f").alias("around"))
    wide = [F.col(c).cast("decimal(19,0)") * F.lit(x) for c, x in (("around", CONTAINED[0]), ("f", CONTAINED[1]))]
    kept = candidates.join(around, W, "left").where(F.col("around").isNull() | (wide[0] < wide[1]))
    return kept.select(*candidates.columns)


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), text_col)
    for seed in range(1, 100):
        every = materialize(word_counts(docs, seed), "phrase-words")
        if every.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    of_lang = materialize(every.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-langs")
    total = of_lang.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = materialize(every.where(F.col("n") >= least), "phrase-frequent-words")
    send = spark.sparkContext.broadcast
    pairs = materialize(pair_counts(docs, seed, send(bloom(frequent, "id").bits)).where(F.col("n") >= least), "phrase-pairs")
    # Each has more than total / MOST_HOT occurrences, so there are at most MOST_HOT.
    hot = max(HOT, total // MOST_HOT)
    hot_words, hot_pairs = (np.array([r[0] for r in df.where(F.col("n") > hot).select(c).collect()], np.int64).view(np.uint64) for df, c in ((frequent, "id"), (pairs, "h")))
    places = project(docs, seed, send(bloom(pairs, "h").bits), send(hot_words), send(hot_pairs))
    candidates = phrase_counts(places, least, min(MAX_PARTITIONS, 1 + total // PARTITION_WORDS))
    zero = F.lit(0).cast("bigint")
    counts = materialize(candidates.unionByName(frequent.select(F.col("id").alias("w1"), *(zero.alias(w) for w in W[1:]), F.col("n").alias("f"))), "phrase-all-counts")
    sized = candidates.withColumn("size", sum((F.col(w) != 0).cast("int") for w in W))
    kept = not_contained(sized)
    scored = materialize(best_cuts(kept, counts), "phrase-scored")
    spelled = scored
    for i, w in enumerate(W):
        of = frequent.select(F.col("id").alias(w), F.col("word").alias(f"s{i + 1}"), *([F.col("lang")] if i == 0 else []))
        spelled = join_bounded(spelled, of, w, "left", MAX_BROADCAST_ROWS)
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", *(f"s{i + 1}" for i in range(LONGEST))))
    spelled = spelled.select("lang", "phrase", "a", "l", "r", "score")
    parts = max(RANK_PARTS, scored.count() // RANK_ROWS)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    in_part = Window.partitionBy("lang", "part").orderBy(*order)
    first = spelled.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return join_bounded(ranked, of_lang, "lang", "inner", MAX_BROADCAST_ROWS).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_growth(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, size, phrase, count(*)::BIGINT AS f FROM (
  SELECT lang, size, unnest(list_transform(range(1, greatest(len(w) - size + 2, 1)), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM w, range(1, 5) AS s(size)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE size > 1 AND f >= 30),
around AS (SELECT lang, inside, max(a) AS most FROM (
  SELECT c.lang, c.a, array_to_string(ws[low:high], ' ') AS inside FROM c, range(1, 4) AS x(low), range(2, 5) AS y(high) WHERE high > low AND high <= size AND high - low + 1 < size) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN around ON around.lang = c.lang AND inside = phrase WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
cut AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM kept, range(1, 4) AS x(k) WHERE k < size),
scored AS (SELECT cut.lang, cut.phrase, cut.a, h.f AS l, t.f AS r, ((2000000::HUGEINT * a) // (h.f::HUGEINT + t.f))::BIGINT AS score, k
  FROM cut JOIN g h ON h.lang = cut.lang AND h.phrase = head JOIN g t ON t.lang = cut.lang AND t.phrase = tail
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored JOIN n USING (lang) QUALIFY rank <= 2000
"""
