"""The language detector: against a plain version, at the edges, on held-out text."""

import math
import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import language
from quillspark.plans import catalog

SF = "/root/testdata/sf0.01"
TEXTS = [
    ("en", "The river runs through the northern valley, and the mill stands where the road crosses it."),
    ("en", "Whether they went there with the others is something that nobody knows."),
    ("de", "Der Fluss fließt durch das nördliche Tal, und die Mühle steht dort, wo die Straße ihn kreuzt."),
    ("de", "Ob sie mit den anderen dorthin gegangen sind, weiß niemand."),
    ("fr", "La rivière traverse la vallée du nord, et le moulin se trouve où la route la franchit."),
    (None, "Nobody has said what this is"),
    ("fr", None),
    ("de", ""),
]


def grams(text):
    t = " " + re.sub(r"[^a-zà-ÿß]+", " ", (text or "").lower()).strip() + " "
    return [t[i : i + 3] for i in range(len(t) - 2)]


def plain(train, texts, most):
    counts = {}
    for lang, text in train:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    known = {g for c in counts.values() for g in sorted(c, key=lambda g: (-c[g], g))[:most]}
    weight = {}
    for lang, c in counts.items():
        total = sum(c[g] for g in known)
        weight[lang] = {g: round(1000 * math.log((c[g] + 1) / (total + len(known)))) for g in known}
    out = []
    for text in texts:
        own = [g for g in grams(text) if g in known]
        out.append(min(weight, key=lambda lang: (-sum(weight[lang][g] for g in own), lang)) if own else None)
    return out


def fitted(spark, rows, **options):
    return language.fit(language.gram_counts(spark.createDataFrame(rows, "lang string, text string")), **options)


@pytest.mark.parametrize("most", [5, 50, 2_000])
def test_detector(spark, most):
    detector = language.Detector(fitted(spark, TEXTS, grams=most))
    asked = ["where the river is", "wo der Fluss ist", "où est la rivière", "", None, "12 + 4", "ж", "x" * 100_000, "straße 😀 nördlich"]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, text string").withColumn("lang", F.lit(1))
    assert [r[0] for r in df.orderBy("i").select(detector("text")).collect()] == plain(TEXTS, asked, most)


def test_without_labels(spark):
    detector = language.Detector(fitted(spark, [(None, "some text")]))
    assert spark.createDataFrame([("some text",)], "text string").select(detector("text")).first()[0] is None


def test_largest_languages(spark):
    found = fitted(spark, TEXTS, languages=2)
    assert {r[0] for r in found.select("lang").distinct().collect()} == {"en", "de"}
    assert found.count() == 2 * found.select("gram").distinct().count()


def test_rules_ask_the_detector(spark):
    detector = language.Detector(fitted(spark, TEXTS))
    df = spark.createDataFrame([("wo der Fluss ist, weiß niemand",), ("নদী কোথায় যায় কে জানে",), ("123 456 789 0",), ("where is it",), (None,)], "text string")
    rows = df.select(T.chunk_language("text", detector), T.query_language("text", detector), T.chunk_language("text"), T.query_language("text")).collect()
    assert [tuple(r) for r in rows] == [("de", "de", "en", "en"), ("bn", "bn", "bn", "bn"), ("unknown", "en", "unknown", "en"), ("en", "en", "en", "en"), ("unknown", "en", "unknown", "en")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_documents():
    """By the SQL, which gives the query's rows: nearly all are found."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    n, accuracy = con.execute(catalog.oracle_sql()["language_accuracy"]).fetchone()
    assert n > 100 and accuracy > 0.97, (n, accuracy)


def test_counts_hold_few_texts_at_once(spark, monkeypatch):
    """Numbers of trigrams take many times their text's bytes, so a batch is
    counted in slices; a text of more than a slice is one of its own."""
    from quillspark.functions import trigrams

    texts = ["ab" * 30, "c" * 500, "", "de", "f" * 90, "g" * 20]
    monkeypatch.setattr(trigrams, "SLICE", 100)
    got = list(trigrams.sliced(texts))
    assert [t for run in got for t in run] == texts
    assert all(sum(map(len, run)) <= 100 or len(run) == 1 for run in got)


def whole(spark, rows, asked, head, grams=None):
    counts = language.gram_counts(spark.createDataFrame(rows, "lang string, text string"))
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string")
    found = dict(language.detected(df, language.entries(counts, grams), head=head).collect())
    return [found.get(i) for i in range(len(asked))]


@pytest.mark.parametrize("head", [0, 1, 40, 100_000])
@pytest.mark.parametrize("grams", [None, 5])
def test_trigrams_beyond_the_broadcast_ones_are_joined(spark, head, grams):
    asked = ["where the river is", "wo der Fluss ist", "où est la rivière", "", None, "12 + 4", "ж", "x" * 5_000, "straße 😀 nördlich", "nobody knows"]
    assert whole(spark, TEXTS, asked, head, grams) == plain(TEXTS, asked, grams or 1_000_000)


def test_no_trigram_is_too_rare(spark):
    """Of more than ``GRAMS`` trigrams in a language, the last counts too."""
    letters = "abcdefghijklmnopqrst"
    many = " ".join(f"{a}{b}{c}" for a in letters for b in letters for c in letters)
    rows = [("aa", many), ("aa", many), ("bb", many), ("bb", "zyx"), ("cc", many), ("cc", "uvw")]
    asked = ["zyxzyx", "uvwuvw"]
    assert [whole(spark, rows, asked, head) for head in (100, 100_000)] == [["bb", "cc"]] * 2


@pytest.mark.parametrize("head", [100, 100_000])
def test_no_language_is_too_small(spark, head):
    """All of more than ``LANGUAGES`` languages are told apart."""
    names = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqr"]
    rows = [(n, f"{n}{n}{n}" + (" word" * (i < 70))) for i, n in enumerate(names)]
    assert whole(spark, rows, [f"{n}{n}" for n in names], head) == names


def test_all_trigrams_and_languages_by_the_queries(spark, tmp_path):
    names = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqr"]
    rows = [(i, f"{n}{n}{n} {'word ' * (i % 7)}" + " ".join(f"{n}{c}{c}" for c in "stuvwxyz"), n if i % 11 else None) for i, n in enumerate(names * 6)]
    spark.createDataFrame([*rows, (None, "no id", "ak")], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("language_accuracy", "detect_language"):
        query, sql = catalog.queries()[name], catalog.oracle_sql()[name]
        got = sorted(map(tuple, query(spark, str(tmp_path)).collect()), key=repr)
        assert got == sorted(con.execute(sql).fetchall(), key=repr), name


def test_long_text_is_counted_in_slices(monkeypatch):
    from quillspark.functions import trigrams

    text = "abcab" * 50 + "xyz"
    monkeypatch.setattr(trigrams, "SLICE", 7)
    codes, n = trigrams.counted(text)
    assert dict(zip(map(trigrams.spelled, codes.tolist()), n.tolist(), strict=True)) == Counter(text[i : i + 3] for i in range(len(text) - 2))
    assert all(len(trigrams.counted(t)[0]) == 0 for t in ("", "a", "ab"))
