"""Normalization, cleaning and classification as Column functions.

Null is taken as the empty text throughout.  ``semantics="observed"`` keeps the
known oddities of the behaviour to match; ``"intended"`` mends them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import patterns as P
from . import plain


def text_of(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def rewrite(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def strip(c: Column) -> Column:
    """``patterns.TRIM``, from the ends inward alone."""
    return F.trim(c, F.lit(P.SPACES))


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, f"{P.SPACE}+"), lambda w: w != "")


def let(values: list[Column], body) -> Column:
    """body(*values) with each value computed once, however often it is used,
    also per element of an array."""
    packed = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.transform(F.array(packed), lambda s: body(*(s[f"v{i}"] for i in range(len(values)))))[0]


def contains_any(c: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(c, F.lit(needle))
    return found


def count_contained(c: Column, needles: list[str]) -> Column:
    return sum((F.contains(c, F.lit(n)).cast("int") for n in needles), F.lit(0))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t))


def nfc(c: str | Column) -> Column:
    """Unicode composition, in an Arrow batch: Spark has no such function."""
    return _nfc(text_of(c))


def strip_artifacts(c: str | Column) -> Column:
    return F.translate(text_of(c), P.WIDE_SPACES + P.ZERO_WIDTH, " " * len(P.WIDE_SPACES))


def rejoin_marks(c: str | Column, semantics: str = "intended") -> Column:
    return rewrite(text_of(c), P.REJOIN_OBSERVED if semantics == "observed" else P.REJOIN_INTENDED)


def script_boundary_spacing(c: str | Column) -> Column:
    return rewrite(text_of(c), P.SCRIPT_BOUNDARY)


def normalize_whitespace(c: str | Column) -> Column:
    return rewrite(text_of(c), P.WHITESPACE)


def normalize(c: str | Column, semantics: str = "intended", compose: bool = True, repair: Callable[[Column], Column] | None = None) -> Column:
    """Composition, artifacts, marks, script boundaries, white space.  ``repair``
    maps the composed text first, where a repair of broken encodings is at hand."""
    text = nfc(c) if compose else text_of(c)
    text = text_of(repair(text)) if repair is not None else text
    return normalize_whitespace(script_boundary_spacing(rejoin_marks(strip_artifacts(text), semantics)))


def clean_ocr(c: str | Column, semantics: str = "intended") -> Column:
    return rewrite(normalize(c, semantics), P.OCR)


@F.arrow_udf(StringType())
def _clean(texts: pa.Array) -> pa.Array:
    return pa.array((plain.clean(t.as_py()) for t in texts), pa.string())


def clean_text(c: str | Column) -> Column:
    return _clean(text_of(c))


def text_issues(c: str | Column) -> dict[str, Column]:
    text = text_of(c)
    found = {name: text.rlike(pattern) for name, pattern in P.ISSUES.items()}
    return found | {"character_count": F.length(text), "normalized_count": F.length(nfc(text))}


def content_flags(c: str | Column) -> dict[str, Column]:
    text = text_of(c)
    return {name: text.rlike(pattern) for name, pattern in P.FLAGS.items()}


def _letters(text: Column) -> list[Column]:
    """Bengali letters, and all letters that count for the share."""
    return [F.regexp_count(text, F.lit(f"[{letters}{P.BENGALI}]")) for letters in ("", "a-zA-Z")]


def _rest(c: Column, detector: Callable[[Column], Column] | None) -> Column:
    """The language of what is neither Bengali nor mixed.  It stands outside the
    rules' lambdas, where Spark allows no Python function."""
    return F.lit("en") if detector is None else F.coalesce(detector(c), F.lit("en"))


def chunk_language(c: str | Column, detector: Callable[[Column], Column] | None = None) -> Column:
    """By the share of Bengali letters.  ``detector`` names the language of texts
    that are neither Bengali nor mixed (``operators.language.Detector`` is one);
    without one they count as English."""
    def rule(text: Column, rest: Column, bengali: Column, letters: Column) -> Column:
        return (
            F.when((F.length(strip(text)) < 10) | (letters == 0), "unknown")
            .when(bengali / letters > 0.7, "bn")
            .when(bengali / letters > 0.3, "mixed")
            .otherwise(rest)
        )

    text = text_of(c)
    return let([text, _rest(text, detector)], lambda text, rest: let([text, rest, *_letters(text)], rule))


def query_language(c: str | Column, detector: Callable[[Column], Column] | None = None) -> Column:
    def rule(text: Column, rest: Column, lowered: Column, bengali: Column, letters: Column) -> Column:
        keyed = count_contained(lowered, P.QUERY_BENGALI) > count_contained(lowered, P.QUERY_ENGLISH)
        return (
            F.when((F.length(strip(text)) < 3) | (letters == 0), "en")
            .when((bengali / letters > 0.5) | keyed, "bn")
            .when(bengali / letters > 0.2, "mixed")
            .otherwise(rest)
        )

    text = text_of(c)
    return let([text, _rest(text, detector)], lambda text, rest: let([text, rest, F.lower(text), *_letters(text)], rule))


def content_type(c: str | Column) -> Column:
    def rule(text: Column, lowered: Column, lines: Column) -> Column:
        wordy = F.forall(F.slice(lines, 1, 3), lambda x: F.size(words(x)) > 2)
        bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
        return (
            F.when(contains_any(lowered, P.ANSWER_WORDS) & (F.size(lines) > 3), "answer_table")
            .when(text.rlike(P.MCQ), "mcq")
            .when((bars > 2) | ((F.size(lines) > 2) & wordy), "table")
            .when((F.length(strip(text)) < 150) & text.rlike(P.HEADING), "heading")
            .when(text.rlike(P.LIST), "list")
            .when(text.rlike(P.EQUATION) & (F.length(text) < 200), "equation")
            .when(contains_any(lowered, P.DEFINITION_WORDS) & (F.length(text) < 300), "definition")
            .otherwise("paragraph")
        )

    return let([text_of(c)], lambda text: let([text, F.lower(text), F.split(text, "\n")], rule))


def question_type(c: str | Column) -> Column:
    def rule(lowered: Column) -> Column:
        out = None
        for name, needles in P.QUESTION_TYPES:
            test = contains_any(lowered, needles)
            out = F.when(test, name) if out is None else out.when(test, name)
        return out.otherwise("other_questions")

    return let([F.lower(text_of(c))], rule)


def score_bin(c: str | Column) -> Column:
    score = F.col(c) if isinstance(c, str) else c
    return F.when(score >= 0.7, "good").when(score >= 0.4, "fair").otherwise("poor")


def embed_input(c: str | Column) -> Column:
    """Text for a passage embedding: single spaces and a prefix, given once."""
    def rule(text: Column) -> Column:
        has = text.startswith("query:") | text.startswith("passage:")
        return F.when((text == "") | has, text).otherwise(F.concat(F.lit("passage: "), text))

    return let([F.array_join(words(text_of(c)), " ")], rule)


def query_input(c: str | Column) -> Column:
    return F.concat(F.lit("query: "), strip(text_of(c)))


def cache_key(c: str | Column) -> Column:
    return F.md5(text_of(c).cast("binary"))


def strip_tags(c: str | Column) -> Column:
    """Visible text of an HTML page: no scripts, styles, comments or tags."""
    hidden = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
    text = F.regexp_replace(F.regexp_replace(text_of(c), hidden, " "), r"(?s)<[^>]*>", " ")
    return strip(F.regexp_replace(text, f"{P.SPACE}+", " "))


# --- the same rules as SQL, for comparison ------------------------------------


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_rewrite(expr: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        replacement = re.sub(r"\$(\d)", r"\\\1", replacement)
        expr = f"regexp_replace({expr}, {sql_text(pattern)}, {sql_text(replacement)}, 'g')"
    return expr


def sql_match(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {sql_text(pattern)})"


def sql_any(expr: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {sql_text(n)})" for n in needles) + ")"


def sql_count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {sql_text(pattern)}))"


def sql_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {sql_text(P.SPACE + '+')}), lambda w: w <> '')"
