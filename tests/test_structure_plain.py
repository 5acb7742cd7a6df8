"""Chunkers without SQL against a plain version over random sections."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunking

SIZE, LEAST = 120, 20
PIECES = [
    "öü" * 14, "öü" * 9 + "!", "নদী জল" * 5, "ßß definition ßß " + "ü" * 12, "Question: " + "ö" * 25, "ö|ü|ö|ü" + "ä" * 20, "• " + "ü" * 30,
    "১.২ " + "ö" * 20, "ö" * 10, "ü! ö! " * 30, "ß = ä" + "ö" * 20, "নদী! " * 40,
]


def split(text, language):
    """Sentences of a text in one language, by its terminators."""
    clean = lambda parts: [p.strip() for p in parts if p.strip()]
    own = {"bn": [r"[।!?]+\s*"], "mixed": [r"[।!?]+\s*", r"[.!?]+\s+"], "en": [r"[.!?]+\s+"]}.get(language, [])
    return [s for p in own for s in clean(re.split(p, text))] or clean(re.split(r"[।.!?]+", text))


def parts_of(text, language):
    out, cur = [], ""
    for s in split(text, language):
        if cur and len(cur) + 1 + len(s) > SIZE:
            out.append(cur)
            cur = s
        else:
            cur = f"{cur} {s}" if cur else s
    return [*out, cur] if len(cur.strip()) >= LEAST else out


class Plain:
    """Sections in, chunks (content, id, index, type) out."""

    def __init__(self, facts, observed):
        self.facts, self.observed, self.out, self.number = facts, observed, [], 0

    def emit(self, content, kind, language):
        if len(content.strip()) < LEAST:
            return
        if len(content) > SIZE:
            parts = parts_of(content, language)
            made = [(p.strip(), f"page_1_para_{self.number}_sub_{k}", self.number * 100 + k, kind) for k, p in enumerate(parts)]
            made = made[:1] if self.observed else made
        else:
            made = [(content.strip(), f"page_1_{kind}_{self.number}", self.number, kind)]
        self.out += made
        self.number += bool(made)

    def run(self, sections, language_of):
        held, held_kind = "", "paragraph"
        for s in sections:
            kind, language = self.facts[s]
            prose = kind in ("paragraph", "definition")
            if held and (kind in ("mcq", "answer_table") or prose and kind != held_kind):
                self.emit(held, held_kind, language)
                held = ""
            if prose:
                held, held_kind = f"{held}\n\n{s}" if held else s, kind
            elif kind == "table" and held and held_kind in ("paragraph", "definition"):
                held += "\n\nTable:\n" + s
            else:
                self.emit(s, kind, language)
        if held:
            self.emit(held, held_kind, language_of(held))
        return self.out


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    return [(i, "\n\n".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9)))) for i in range(80)]


def facts_of(spark, sections):
    df = spark.createDataFrame([(s,) for s in sorted(sections)], "t string")
    return {r[0]: (r[1], r[2]) for r in df.select("t", T.content_type("t"), T.chunk_language("t")).collect()}


@pytest.mark.parametrize("semantics", ["observed", "intended"])
def test_structure(spark, texts, semantics):
    facts = facts_of(spark, {p.strip() for p in PIECES})
    made = chunking.structure_chunks(F.col("t"), F.lit(1), SIZE, LEAST, semantics=semantics)
    got = {r["i"]: [(c["content"], c["chunk_id"], c["chunk_index"], c["content_type"]) for c in r["c"]] for r in spark.createDataFrame(texts, "i int, t string").select("i", made.alias("c")).collect()}
    languages = lambda held: facts_of(spark, {held})[held][1]
    for i, text in texts:
        sections = [s.strip() for s in re.split(r"\n\s*\n+", text) if len(s.strip()) >= LEAST]
        assert got[i] == Plain(facts, semantics == "observed").run(sections, languages), text
    assert {c[3] for chunks in got.values() for c in chunks} >= {"paragraph", "definition", "mcq", "table", "list"}


def test_paragraphs(spark, texts):
    facts = facts_of(spark, {p.strip() for p in PIECES})
    made = chunking.paragraph_chunks(F.col("t"), F.lit(1), SIZE, LEAST)
    got = {r["i"]: [(c["content"], c["chunk_id"], c["chunk_index"]) for c in r["c"]] for r in spark.createDataFrame(texts, "i int, t string").select("i", made.alias("c")).collect()}
    for i, text in texts:
        want = []
        for k, s in enumerate(re.split(r"\n\s*\n+", text)):
            s = s.strip()
            if len(s) > SIZE:
                want += [(p.strip(), f"page_1_para_{k}_sub_{j}", k * 100 + j) for j, p in enumerate(parts_of(s, facts[s][1]))]
            elif len(s) >= LEAST:
                want.append((s, f"page_1_para_{k}", k))
        assert got[i] == want, text


def test_mixed_strategy_chooses_by_document(spark):
    prose = "öü" * 60
    rows = [(1, 1, f"a) {prose}"), (1, 2, f"{prose}. {prose}"), (2, 1, f"{prose}. {prose}"), (3, 1, f"MCQ {prose}")]
    got = chunking.chunk_pages(spark.createDataFrame(rows, "doc_id bigint, page_number int, text string"), "mixed").collect()
    kinds = {(r["doc_id"], r["source_page"]): r["chunk_id"].split("_")[2] for r in got}
    assert kinds == {(1, 1): "para", (1, 2): "para", (2, 1): "sent", (3, 1): "para"}
