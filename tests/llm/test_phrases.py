"""Operator 12 against a plain version and its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import phrases

from .brute import lower
from .test_operators import DOCS, EMPTY, frame, got
from .test_pipeline import SF, needs_data

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, top=2_000):
    """rows: (text, lang)."""
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            own = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for size in range(1, 5):
                f["und" if lang is None else lang].update(tuple(own[i : i + size]) for i in range(len(own) - size + 1))
    out = []
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        frequent = {p: c for p, c in count.items() if len(p) > 1 and c >= least}
        around = Counter()
        for p, c in frequent.items():
            for inner in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                around[inner] = max(around[inner], c)
        found = []
        for p, a in frequent.items():
            if not around[p] or 100 * around[p] < 80 * a:
                score, _, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out, key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(12)]
    fixed = ["New York City Hall", "in the end", "the end of", "a b", "é ü ß"]
    rows = [(None, None), ("", "en"), (" \t\n ", "en"), ("one", None), ("x  y\tx y x y.x y!x", "en"), ("a a a a a a", "fr")]
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(common) + rng.choice((" ", "  ", "\t", ", ", ".", "\r\n")) for _ in range(rng.randrange(1, 120))]
        rows.append((" ".join(parts), rng.choice(("en", "en", "de", "", None))))
    return rows + [rows[-1]] * 3


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, g, None, None) for i, (t, g) in enumerate(rows)], DOCS)
    df = df.withColumns({c: F.lit(1) for c in ("word", "n", "id", "w1", "f", "key", "split")})
    return got(phrases.collocations(df, **options), *COLUMNS)


@pytest.mark.parametrize("hot", [500_000, 40])
def test_collocations(spark, monkeypatch, hot):
    """With few occurrences making a word hot, most are split; tasks gather and
    grow few rows at once."""
    monkeypatch.setattr(phrases, "HOT", hot)
    if hot < 100:
        monkeypatch.setattr(phrases, "FLUSH", 500)
        monkeypatch.setattr(phrases, "CHUNK", 200)
        monkeypatch.setattr(phrases, "PARTITION_WORDS", 2_000)
        monkeypatch.setattr(phrases, "MAX_BROADCAST_ROWS", 3)
    rows = texts(5, 300)
    want = plain(rows, 5)
    assert len(want) > 100 and {len(p[2].split(" ")) for p in want} == {2, 3, 4}
    assert run(spark, rows, least=5) == want
    assert run(spark, rows, least=5, top=7) == plain(rows, 5, 7)


def test_without_phrases(spark):
    assert phrases.collocations(frame(spark, EMPTY)).count() == 0
    assert run(spark, texts(6, 3), least=10_000) == []


def test_long_text(spark):
    rows = [("ab cd ef " * 200_000, "en"), ("z" * 300_000 + " q", "en")]
    assert run(spark, rows) == plain(rows, 30)


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    """Under the first seed all words of one length share a hash."""
    true = phrases._multipliers

    def weak(seed, size):
        letters, places = true(seed, size)
        return (np.ones_like(letters), places) if seed == 1 else (letters, places)

    rows = texts(7, 40)
    monkeypatch.setattr(phrases, "_multipliers", weak)
    seeds = []
    count = phrases.word_counts
    # Workers import the module anew, so the driver's counts stand for theirs.
    monkeypatch.setattr(phrases, "word_counts", lambda docs, seed: seeds.append(seed) or (count(docs, seed) if seed > 1 else count(docs, seed).withColumn("id", F.lit(1).cast("bigint"))))
    assert run(spark, rows, least=5) == plain(rows, 5) and seeds == [1, 2]


@needs_data
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({phrases.OP12_SQL})").fetchall()
    assert len(want) > 30
    assert got(phrases.op12_phrase_growth(spark, SF), *COLUMNS) == sorted(want, key=repr)
