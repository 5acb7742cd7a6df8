"""Learnt sentence boundaries: abbreviations, starters, edges, the gain."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import boundaries, chunking
from quillspark.plans import catalog

SHORT = ["Dr.", "vol.", "e.g.", "Prof.", "no.", "etc."]


def corpus(seed, n=60):
    """Texts of true sentences with made-up abbreviations in the middle of them."""
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("ven", "lor", "mit", "sak", "dru")]
    out = []
    for _ in range(n):
        sentences = []
        for _ in range(rng.randrange(4, 20)):
            own = [rng.choice(words) for _ in range(rng.randrange(4, 14))]
            own[0] = rng.choice(["The", "There", "However", "It", own[0].capitalize()])
            for _ in range(rng.randrange(3)):
                at = rng.randrange(1, len(own))
                own.insert(at, rng.choice(SHORT))
                if rng.random() < 0.5:
                    own.insert(at + 1, rng.choice(words).capitalize())
            if own[-1] in SHORT:
                own.append(rng.choice(words))
            sentences.append(" ".join(own) + rng.choice([".", ".", ".", "!", "?", '."']))
        out.append(sentences)
    return out


def learnt(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumns({c: F.lit(1) for c in ("type", "dotted", "a", "p", "w", "core")})
    types = boundaries.word_types(df)
    short = boundaries.abbreviations(types)
    return boundaries.Boundaries(short, boundaries.starters(df, types, short))


@pytest.fixture(scope="module")
def model(spark):
    return learnt(spark, [" ".join(s) for s in corpus(1, 120)])


def test_what_is_learnt(model):
    assert {t.removesuffix(".").lower() for t in SHORT} - {"etc"} <= model.abbreviations
    assert {"the", "there", "however", "it"} <= model.starters
    assert not [t for t in model.abbreviations if len(t) > 4]


def f_score(found, true):
    def cuts(sentences):
        ends, at = set(), 0
        for s in sentences[:-1]:
            at += len(s.split(" "))
            ends.add(at)
        return ends

    hit = sum(len(cuts(a) & cuts(b)) for a, b in zip(found, true, strict=True))
    return 2 * hit / (sum(len(cuts(a)) for a in found) + sum(len(cuts(b)) for b in true))


def test_gain_over_the_pattern(spark, model):
    """On texts that weren't learnt from."""
    true = corpus(2, 40)
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(true)], "i int, text string")
    rows = df.select("i", model("text").alias("own"), chunking.sentences(F.col("text"), F.lit("en")).alias("pattern")).orderBy("i").collect()
    own, pattern = f_score([r["own"] for r in rows], true), f_score([r["pattern"] for r in rows], true)
    assert own > 0.97 and pattern < 0.85, (own, pattern)


def test_edges(spark, model):
    texts = [None, "", " \n\t ", "one", "Dr. No lives here. The end.", "A. Smith came! Did he? Yes.", "vol. The end (e.g. this one.) It is so.", "wait... what", "x. " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = [r[0] for r in df.orderBy("i").select(model("text")).collect()]
    assert rows[:4] == [[], [], [], ["one"]]
    assert rows[4] == ["Dr. No lives here.", "The end."]
    assert rows[5] == ["A. Smith came!", "Did he?", "Yes."]
    assert rows[6] == ["vol.", "The end (e.g. this one.)", "It is so."]
    assert rows[7] == ["wait...", "what"] and rows[8] == [" ".join(["x."] * 30_000)]


def test_without_a_model(spark):
    bare = learnt(spark, [])
    assert not bare.abbreviations and not bare.starters
    assert spark.createDataFrame([("Dr. No is here. He is.",)], "text string").select(bare("text")).first()[0] == ["Dr.", "No is here.", "He is."]


def test_chunks_take_learnt_sentences(spark, model):
    text = " ".join(" ".join(s) for s in corpus(3, 6))
    df = spark.createDataFrame([(text,), ("নদী কোথায় যায়। কে জানে? " * 30,)], "text string").select(T.clean_text("text").alias("text"))
    own = chunking.sentence_chunks(F.col("text"), F.lit(1), english=model)
    rows = df.select(own.alias("own"), chunking.sentence_chunks(F.col("text"), F.lit(1)).alias("plain"), model("text").alias("s")).collect()
    assert rows[1]["own"] == rows[1]["plain"] and rows[0]["own"] != rows[0]["plain"]
    starts = {s.split(" ")[0] for s in rows[0]["s"]}
    assert all(c["content"].split(" ")[0] in starts for c in rows[0]["own"])


@pytest.mark.parametrize("head", [0, 1, 3])
def test_types_beyond_the_broadcast_ones_are_joined(spark, head):
    texts = [" ".join(s) for s in corpus(4, 120)] + [None, "", "Dr. No", "A. Smith came! Did he? Yes.", "A. Smith came! Did he? Yes."]
    df = spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    types = boundaries.word_types(df)
    short = boundaries.abbreviations(types, kept=None)
    begins = boundaries.starters(df, types, short, kept=None)
    assert short.count() > 3 and begins.count() > 3
    want = df.select("doc_id", F.posexplode(boundaries.Boundaries(short, begins)("text")).alias("n", "sentence"))
    got = boundaries.sentences(df, short, begins, head=head)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_no_abbreviation_is_too_many(spark, tmp_path):
    """Above ``KEPT`` abbreviations of one score none ends a sentence, and the rows are
    those of the query's SQL."""
    letters = "abcdefghijklmnopqrstuvwxyzàéîõ"
    short = [f"{a}.{b}.{c}." for a in letters for b in letters for c in letters]
    assert len(short) > boundaries.KEPT
    texts = [" ".join(f"{w} one two three four" for w in short[i : i + 100]) for i in range(0, len(short), 100)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.queries()["sentence_boundaries"](spark, str(tmp_path)).collect()))
    assert got == [(i, 0, t) for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(catalog.oracle_sql()["sentence_boundaries"]).fetchall())
