"""Repair of broken encodings: broken texts come back, clean ones stay."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import encoding
from quillspark.functions import text as T

SF = "/root/testdata/sf0.01"
CLEAN = [
    "Où est la rivière ? À côté, déjà vu : œuvre, Noël, ça, « Âge »",
    "Größe, Straße, „Ü“ und „Ä“ – überall…",
    "NÃO, São João, mañana, ¿qué?, Ångström, Øresund, Þór, ðæt",
    "নদী কোথায় যায়? ২৭ বছর।",
    "Ελλάδα, Россия, 日本語, 😀 done",
    "Ã", "Â£5", "£5 ± 2 °C", "á", "",
]


def broken(text, table, times=1):
    for _ in range(times):
        # As readers do: what Windows-1252 lacks stays a control character.
        text = "".join(bytes([b]).decode(table, "ignore") or chr(b) for b in text.encode())
    return text


def repaired(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[0] for r in df.orderBy("i").select(encoding.repair_encoding("text")).collect()]


def test_clean_texts_stay(spark):
    assert repaired(spark, [c for c in CLEAN if c != "Â£5"]) == [c for c in CLEAN if c != "Â£5"]
    assert repaired(spark, [None, "Â£5", "x" * 300_000]) == ["", "£5", "x" * 300_000]


@pytest.mark.parametrize("table", ["cp1252", "latin-1"])
@pytest.mark.parametrize("times", [1, 2])
def test_broken_texts_come_back(spark, table, times):
    texts = [c for c in CLEAN if c not in ("Ã", "Â£5")]
    assert repaired(spark, [broken(t, table, times) for t in texts]) == texts
    mixed = [f"নদী and {broken(t, table)} and é" for t in texts]
    assert repaired(spark, mixed) == [f"নদী and {t} and é" for t in texts]


@pytest.mark.parametrize("times", [1, 2])
def test_runs_of_any_length(spark, times):
    texts = ["नदी" * 20_000, "日本語" * 20_000, "é" * 60_000, "y\né" * 20_000 + "\n", "\n" + "éà\u0085" * 20_000]
    assert repaired(spark, [broken(t, "latin-1", times) for t in texts]) == texts


def test_clean_text_costs_less_than_one_search(spark):
    # Three rounds of trying each alternative at each letter took three times that search.
    df = spark.range(0, 100, 1, 4).select(F.repeat(F.lit("Où est la rivière près de là, and how long is it? "), 4_000).alias("text")).cache()
    assert df.count() == 100

    def took(c):
        began = time.perf_counter()
        df.select(F.sum(F.length(c.cast("string")))).collect()
        return time.perf_counter() - began

    mended = encoding.repair_encoding("text")
    took(mended)
    assert min(took(mended) for _ in range(2)) < min(took(F.col("text").rlike(encoding.BROKEN)) for _ in range(2))
    df.unpersist()


def test_normalize_takes_it(spark):
    df = spark.createDataFrame([("cafÃ©   ২abc",)], "text string")
    got = df.select(T.normalize("text", repair=encoding.repair_encoding), T.normalize("text")).first()
    assert got[0] == "café ২ abc" and got[1].startswith("cafÃ©")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_documents_stay_and_come_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(T.text_of("text").alias("text"))
    assert docs.where(encoding.repair_encoding("text") != F.col("text")).count() == 0
    read = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    assert docs.where(~F.col("text").rlike("[^\\x00-\\x7f]")).count() < docs.count()
    assert docs.where(encoding.repair_encoding(read) != F.col("text")).count() == 0
