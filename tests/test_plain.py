"""The rules on Python strings against the same ones in Spark's columns."""

import random

from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions import plain
from quillspark.functions import text as T
from quillspark.operators import chunking

PIECES = [
    "a", "Bd", "öü", "zz", "নদী", "জল", "ক)", "d)", "(", ")", "।।", "??", "!!", ".", ",", ";", ":", "|", " ", "  ", "\n", "\t", " ", "　", " ", "​", "\x85",
    "উত্তর", "Answer", "ans:", "Question :", "১.২", "1.2", "٣.٤", "•", "-", "*", "=", "×", "definition", "অর্থ", "İ", "Σ", "12", "\U0001f600",
]


def made(n, most, seed=7):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(PIECES) + rng.choice(("", " ", "")) for _ in range(rng.randint(0, most)))) for i in range(n)]


def test_rules_agree(spark):
    df = spark.createDataFrame(made(1_500, 12) + made(300, 150, 8), "i int, t string")
    language = T.chunk_language("t")
    columns = {"clean": T.rewrite(F.col("t"), P.CLEAN), "own": T.clean_text("t"), "language": language, "kind": T.content_type("t"), "parts": chunking.sentences(F.col("t"), language), "strip": T.rewrite(F.col("t"), P.TRIM), "trim": T.strip(F.col("t"))}
    kinds = set()
    for r in df.select("t", *(c.alias(n) for n, c in columns.items())).collect():
        t = r["t"]
        assert plain.clean(t) == r["clean"] == r["own"], t
        assert (plain.language(t), plain.content_type(t)) == (r["language"], r["kind"]), t
        assert plain.sentences(t, r["language"]) == r["parts"], t
        assert r["strip"] == r["trim"] == t.strip(), t
        kinds.add((r["language"], r["kind"]))
    assert {k for _, k in kinds} == {"answer_table", "mcq", "table", "heading", "list", "equation", "definition", "paragraph"} and {k for k, _ in kinds} == {"unknown", "bn", "mixed", "en"}


def test_chunks_of_null_texts_and_pages(spark):
    df = spark.createDataFrame([(None, 1), ("", 1), ("öü " * 60, None)], "t string, p int")
    got = [r["c"] for r in df.select(chunking.sentence_chunks(F.col("t"), F.col("p")).alias("c")).collect()]
    assert got[:2] == [[], []] and [c["chunk_id"] for c in got[2]] == ["page_sent_0"]
