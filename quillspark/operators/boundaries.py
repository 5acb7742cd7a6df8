"""Sentence boundaries learnt from the corpus, without labels (Kiss & Strunk 2006).

A word that nearly always has a period after it, is short, or has periods within
is an abbreviation: its log-likelihood ratio against a chance period, weighted by
length, inner periods and its occurrences without a period, reaches
``ABBREVIATION``.  After one, and after an initial, a period ends a sentence only
where a capitalized frequent sentence starter follows: a word that occurs after
sure boundaries far more often than by chance (log-likelihood at least
``STARTER``).  Every other ``.``, ``!`` or ``?`` before white space ends one.

Both statistics are aggregations over all words of all texts.  ``sentences`` takes
all types, however many: at most ``KEPT`` of each kind, the ones with the highest
scores, are broadcast and applied in the row; of the others each text gets by joins
those that it asks for.  ``Boundaries`` is for use within a row, without a join, by a
model of at most ``KEPT`` types of each kind.  Sentences keep their terminators and have
single spaces; a text without words has none, and a text without a terminator is
one.  Under a model without rows every terminator ends a sentence but after an
initial.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches
from ..functions import text as T

ABBREVIATION, STARTER, KEPT = 0.3, 30.0, 20_000
CERTAIN = 0.99  # the chance of a period after an abbreviation
LEAST = 1e-9  # probabilities stay away from 0 and 1 by so much
OPENING, CLOSING = "(\\[\"'«“‘", ")\\]\"'»”’"
CORE = f"^[{OPENING}]+|[{CLOSING},;:]+$"
DOTTED, PLAIN = r"^[\p{L}.]*\p{L}\.$", r"^[\p{L}.]*\p{L}$"
ENDS, SURE = f"[.!?][{CLOSING}]*$", f"[!?][{CLOSING}]*$"
INITIAL = r"^\p{L}$"


def _core(word: Column) -> Column:
    return F.regexp_replace(word, CORE, "")


def _type(core: Column) -> Column:
    """The word without its period, null for what isn't one of letters."""
    return F.when(core.rlike(DOTTED) | core.rlike(PLAIN), F.lower(F.regexp_replace(core, r"\.$", "")))


def _clamp(p: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.least(F.lit(1 - LEAST), p))


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """Of k successes in n, at chance p (but for a constant)."""
    return k * F.log(p) + (n - k) * F.log(1 - p)


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """word, following, n: how often each word occurs, by the word that follows where
    it may end a sentence (null for a text's last word, and where it can't end one).
    All patterns but one are then applied to distinct words alone."""
    words = texts.select(T.words(T.text_of(text_col)).alias("w"))
    pairs = words.select(F.inline(F.arrays_zip(F.col("w").alias("word"), F.slice("w", F.lit(2), F.size("w")).alias("following"))))
    pairs = pairs.select("word", F.when(F.col("word").rlike(ENDS), F.col("following")).alias("following"))
    return pairs.groupBy("word", "following").agg(F.count("*").alias("n"))


def word_types(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """type, dotted, plain: how often each word has a period after it, and not.
    The null type counts all that isn't a word of letters."""
    return types_of(word_counts(texts, text_col))


def types_of(counts: DataFrame) -> DataFrame:
    """``word_types`` of ``word_counts``."""
    words = counts.groupBy("word").agg(F.sum("n").alias("n")).select(_core(F.col("word")).alias("core"), "n")
    words = words.select(_type(F.col("core")).alias("type"), F.when(F.col("core").endswith("."), F.col("n")).otherwise(0).alias("dotted"), "n")
    return words.groupBy("type").agg(F.sum("dotted").alias("dotted"), F.sum(F.col("n") - F.col("dotted")).alias("plain"))


def abbreviations(types: DataFrame, threshold: float = ABBREVIATION, kept: int | None = KEPT) -> DataFrame:
    """type, score of the abbreviations among word types: all or the first ``kept``."""
    totals = types.agg(F.sum("dotted").alias("periods"), F.sum(F.col("dotted") + F.col("plain")).alias("words"))
    rows = types.where("type IS NOT NULL AND dotted > 0").crossJoin(F.broadcast(totals))  # one row
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    n = F.col("dotted") + F.col("plain")
    ratio = 2 * (_log_likelihood(F.col("dotted"), n, F.lit(CERTAIN)) - _log_likelihood(F.col("dotted"), n, _clamp(F.col("periods") / F.col("words"))))
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("plain"))
    rows = rows.select("type", F.round(score, 6).alias("score")).where(F.col("score") >= threshold)
    return _first(rows, kept)


def _first(rows: DataFrame, kept: int | None) -> DataFrame:
    return rows if kept is None else rows.orderBy(F.desc("score"), "type").limit(kept)


def starters(texts: DataFrame, types: DataFrame, abbreviated: DataFrame, text_col: str = "text", threshold: float = STARTER, kept: int | None = KEPT) -> DataFrame:
    """type, score of the words that often begin a sentence: all or the first ``kept``."""
    return starters_of(breaks_of(word_counts(texts, text_col), abbreviated), types, threshold, kept)


def breaks_of(counts: DataFrame, abbreviated: DataFrame) -> DataFrame:
    """type, ab: by ``word_counts``, how often each word follows a sure boundary."""
    rows = counts.where("following IS NOT NULL").select(F.col("word").rlike(SURE).alias("sure"), _type(_core(F.col("word"))).alias("before"), _type(_core(F.col("following"))).alias("type"), "n")
    # Only a word that may be an abbreviation is looked up.
    rows = rows.where(F.col("sure") | ~F.coalesce(F.col("before").rlike(INITIAL), F.lit(False)))
    rows = rows.groupBy(F.when(~F.col("sure"), F.col("before")).alias("before"), "type").agg(F.sum("n").alias("n"))
    rows = rows.join(abbreviated.select(F.col("type").alias("before")), "before", "left_anti")
    return rows.groupBy("type").agg(F.sum("n").alias("ab"))


def starters_of(at_break: DataFrame, types: DataFrame, threshold: float = STARTER, kept: int | None = KEPT) -> DataFrame:
    """``starters`` by ``breaks_of``, which is read twice."""
    breaks = at_break.agg(F.sum("ab").alias("a"))
    totals = types.agg(F.sum(F.col("dotted") + F.col("plain")).alias("n"))
    own = types.select("type", (F.col("dotted") + F.col("plain")).alias("b"))
    found = at_break.where("type IS NOT NULL").join(own, "type").crossJoin(F.broadcast(breaks)).crossJoin(F.broadcast(totals))  # one row each
    a, b, ab, n = (F.col(c) for c in ("a", "b", "ab", "n"))
    p, inside, outside = _clamp(b / n), _clamp(ab / a), _clamp((b - ab) / F.greatest(n - a, F.lit(1)))
    ratio = 2 * (_log_likelihood(ab, a, inside) + _log_likelihood(b - ab, n - a, outside) - _log_likelihood(ab, a, p) - _log_likelihood(b - ab, n - a, p))
    rows = found.where(n / a > b / ab).select("type", F.round(ratio, 6).alias("score")).where(F.col("score") >= threshold)
    return _first(rows, kept)


# The same patterns for the row's own loop; ``isalpha`` is \p{L} there.
_CORE, _ENDS, _SURE = (re.compile(p) for p in (CORE, ENDS, SURE))


def _word_type(word: str) -> str | None:
    core = _CORE.sub("", word)
    core = core.removesuffix(".")
    return core.lower() if core[-1:].isalpha() and core.replace(".", "").isalpha() else None


def split_words(words: list[str], abbreviated: Container[str], begins: Container[str]) -> list[str]:
    """Sentences of a text's words."""
    out, first = [], 0
    for i, word in enumerate(words[:-1]):
        if not _ENDS.search(word):
            continue
        if not _SURE.search(word):
            kind = _word_type(word)
            if kind is not None and (len(kind) == 1 or kind in abbreviated):
                following = _CORE.sub("", words[i + 1])
                if not (following[:1].isupper() and _word_type(words[i + 1]) in begins):
                    continue
        out.append(" ".join(words[first : i + 1]))
        first = i + 1
    return [*out, " ".join(words[first:])] if words else []


class _Noted:
    """A set that also notes what it is asked for and doesn't hold, and says yes to it."""

    def __init__(self, held: set[str]):
        self.held, self.asked = held, set()

    def __contains__(self, kind: str | None) -> bool:
        if kind is not None and kind not in self.held:
            self.asked.add(kind)
        return True


class _Either:
    def __init__(self, held: set[str], own: Iterable[str]):
        self.held, self.own = held, frozenset(own)

    def __contains__(self, kind: str | None) -> bool:
        return kind in self.held or kind in self.own


class Boundaries:
    """A learnt model, ready for rows: ``sentence_chunks(..., english=...)``."""

    def __init__(self, abbreviated: DataFrame, begins: DataFrame):
        # At most KEPT rows each.
        self.abbreviations, self.starters = ({r["type"] for r in df.select("type").collect()} for df in (abbreviated, begins))
        batches.bounded(abbreviated.sparkSession)
        self._sent = abbreviated.sparkSession.sparkContext.broadcast((self.abbreviations, self.starters))

    def __call__(self, c: str | Column) -> Column:
        sent = self._sent

        @F.pandas_udf("array<string>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = sent.value
            for column in parts:
                # Python splits at the same white space as ``text.words``, one text at a time.
                yield pd.Series([split_words(text.split(), *known) for text in column], dtype=object)

        return run(T.text_of(c))

    def asked(self, c: str | Column) -> Column:
        """The types that a text asks for beyond the model's, after ``a`` where they
        may be abbreviations and ``s`` where they may be starters."""
        sent = self._sent

        @F.pandas_udf("array<string>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for column in parts:
                out = []
                for text in column:
                    noted = [_Noted(held) for held in sent.value]
                    split_words(text.split(), *noted)
                    out.append([role + kind for role, own in zip("as", noted, strict=True) for kind in own.asked])
                yield pd.Series(out, dtype=object)

        return run(T.text_of(c))

    def with_own(self, c: str | Column, own: str | Column) -> Column:
        """Sentences where a text brings further types, as ``asked`` writes them."""
        sent = self._sent

        @F.pandas_udf("array<string>")
        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for column, further in parts:
                out = []
                for text, kinds in zip(column, further, strict=True):
                    known = [_Either(held, (k[1:] for k in kinds if k[0] == role)) for role, held in zip("as", sent.value, strict=True)]
                    out.append(split_words(text.split(), *known))
                yield pd.Series(out, dtype=object)

        return run(T.text_of(c), own)


def sentences(texts: DataFrame, abbreviated: DataFrame, begins: DataFrame, key: str = "doc_id", text_col: str = "text", head: int = KEPT) -> DataFrame:
    """key, n, sentence of every text, by all types of the model, whose tables are
    read several times."""
    model = Boundaries(_first(abbreviated, head), _first(begins, head))
    if max(abbreviated.count(), begins.count()) <= head:
        return texts.select(key, F.posexplode(model(text_col)).alias("n", "sentence"))
    kinds = [df.select(F.concat(F.lit(role), "type").alias("kind")) for role, df in (("a", abbreviated), ("s", begins))]
    # What two texts of one digest are given is true of both.
    digest = F.xxhash64(key, text_col).alias("_digest")
    asked = texts.select(digest, F.explode(model.asked(text_col)).alias("kind")).join(kinds[0].unionByName(kinds[1]), "kind", "left_semi")
    own = asked.groupBy("_digest").agg(F.collect_set("kind").alias("_own"))
    rows = texts.select(key, text_col, digest).join(own, "_digest", "left")
    given = F.coalesce("_own", F.array().cast("array<string>"))
    return rows.select(key, F.posexplode(model.with_own(text_col, given)).alias("n", "sentence"))
