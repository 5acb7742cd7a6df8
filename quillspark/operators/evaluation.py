"""Evaluation metrics of answers, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from . import embedding


def _literals(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _content_words(c: Column, drop: list[str]) -> Column:
    return F.array_except(T.words(F.lower(c)), _literals(drop))


def _found(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


def groundedness(answer: str | Column, context: str | Column) -> Column:
    """Share of the answer's words in the context, with bonuses for a quoted
    stretch and for numbers that all recur."""
    a, c = T.text_of(answer), T.text_of(context)

    def score(aw: Column, cw: Column, low: Column, parts: Column, an: Column, cn: Column) -> Column:
        quoted = F.exists(parts, lambda p: (F.length(p) > 10) & F.contains(low, p))
        bonus = F.when(quoted, 0.2).otherwise(0.0) + F.when((F.size(an) > 0) & (F.size(F.array_except(an, cn)) == 0), 0.1).otherwise(0.0)
        return F.when(F.size(aw) == 0, 0.0).otherwise(F.least(F.size(F.array_intersect(aw, cw)) / F.size(aw) + bonus, F.lit(1.0)))

    numbers = "\\p{Nd}+"
    parts = F.split(F.lower(a), "\\.")
    value = T.let([_content_words(a, P.STOP_WORDS), _content_words(c, P.STOP_WORDS), F.lower(c), parts, _found(a, numbers), _found(c, numbers)], score)
    return F.when((a == "") | (c == ""), 0.0).otherwise(value)


def relevance(question: str | Column, context: str | Column) -> Column:
    """Share of the question's words in the context, with bonuses for an answer
    mark, any match, and shared Bengali words."""
    q, c = T.text_of(question), T.text_of(context)

    def score(qw: Column, cw: Column, low: Column, qe: Column, ce: Column) -> Column:
        both = F.size(F.array_intersect(qw, cw))
        entities = F.size(F.filter(qe, lambda e: (F.length(e) > 2) & F.array_contains(ce, e)))
        bonus = (
            F.when(T.contains_any(low, P.ANSWER_MARKS), 0.1).otherwise(0.0)
            + F.when(both >= 1, 0.2).otherwise(0.0)
            + F.least(F.lit(0.3), entities * 0.1)
        )
        return F.when(F.size(qw) == 0, 0.5).otherwise(F.least(both / F.size(qw) + bonus, F.lit(1.0)))

    entity = f"[{P.ENTITY}]+"
    context_words = F.array_distinct(T.words(F.lower(c)))
    value = T.let([_content_words(q, P.QUESTION_WORDS), context_words, F.lower(c), _found(q, entity), _found(c, entity)], score)
    return F.when((q == "") | (c == ""), 0.0).otherwise(value)


def lexical_similarity(answer: str | Column, truth: str | Column) -> Column:
    """Jaccard similarity of words, with bonuses for a shared number and shared
    Bengali words; without words of either, 0.8 if one contains the other."""
    a, t = T.text_of(answer), T.text_of(truth)

    def score(aw: Column, tw: Column, al: Column, tl: Column, an: Column, tn: Column, ae: Column, te: Column) -> Column:
        jaccard = F.size(F.array_intersect(aw, tw)) / F.size(F.array_union(aw, tw))
        numbers = F.when(F.exists(an, lambda n: F.array_contains(tn, n)), 0.3).otherwise(0.0)
        entities = F.least(F.lit(0.2), F.size(F.filter(te, lambda e: F.array_contains(ae, e))) * 0.1)
        contained = F.contains(al, tl) | F.contains(tl, al)
        empty = (F.size(aw) == 0) | (F.size(tw) == 0)
        return F.when(empty, F.when(contained, 0.8).otherwise(0.0)).otherwise(F.least(jaccard + numbers + entities, F.lit(1.0)))

    al, tl, entity = F.lower(a), F.lower(t), f"[{P.ENTITY}]{{3,}}"
    values = [_content_words(a, P.COMMON_WORDS), _content_words(t, P.COMMON_WORDS), al, tl]
    values += [_found(al, P.NUMBER_WORDS), _found(tl, P.NUMBER_WORDS), _found(a, entity), _found(t, entity)]
    return F.when((a == "") | (t == ""), 0.0).otherwise(T.let(values, score))


def context_utilization(answer: str | Column, context: str | Column) -> Column:
    a, c = T.text_of(answer), T.text_of(context)
    aw, cw = F.size(T.words(a)), F.size(T.words(c))
    density = F.least(aw / F.greatest(cw * 0.1, F.lit(1.0)), F.lit(1.0))
    return (
        F.when((a == "") | (c == ""), 0.0)
        .when(T.contains_any(F.lower(a), P.GENERIC_PHRASES), 0.1)
        .when((cw > 50) & (aw < 5), 0.2)
        .otherwise(F.least(groundedness(a, c) * 0.7 + density * 0.3, F.lit(1.0)))
    )


def evaluate(rows: DataFrame, digits: int | None = None, embedder: embedding.Embedder | None = None) -> DataFrame:
    """Rows (question, answer, truth, context) with their metrics.  With an
    embedder the semantic similarity is the cosine of answer and truth as
    passages, 0 if one is empty; without, it is lexical."""

    def kept(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    similarity, columns = lexical_similarity("answer", "truth"), rows.columns
    if embedder is not None:
        rows = embedding.encode(embedding.encode(rows, embedder, "answer", "_answer"), embedder, "truth", "_truth")
        empty = (T.text_of("answer") == "") | (T.text_of("truth") == "")
        similarity = F.when(empty, 0.0).otherwise(embedding.cosine(F.col("_answer"), F.col("_truth")))
    return rows.withColumns(
        {
            "groundedness": kept(groundedness("answer", "context")),
            "relevance": kept(relevance("question", "context")),
            "semantic_similarity": kept(similarity),
            "context_utilization": kept(context_utilization("answer", "context")),
            "question_type": T.question_type("question"),
            "answer_length": F.size(T.words(T.text_of("answer"))),
            "context_length": F.size(T.words(T.text_of("context"))),
        }
    ).drop(*({"_answer", "_truth"} - set(columns)))


def summary(evaluated: DataFrame) -> DataFrame:
    """One row: means and counts by bin; zeros for an empty input."""

    def mean(c: str) -> Column:
        return F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"avg_{c}")

    bins = [
        F.count_if((T.score_bin(c) == b) & F.col(c).isNotNull()).alias(f"{c}_{b}")
        for c in ("groundedness", "relevance")
        for b in ("good", "fair", "poor")
    ]
    metrics = ("groundedness", "relevance", "semantic_similarity", "context_utilization")
    return evaluated.agg(F.count("*").alias("total_questions"), *(mean(c) for c in metrics), *bins)


def distribution(evaluated: DataFrame) -> DataFrame:
    long = evaluated.select(F.expr("stack(2, 'groundedness', groundedness, 'relevance', relevance)").alias("metric", "score"))
    return long.groupBy("metric", T.score_bin("score").alias("bin")).agg(F.count("*").alias("n"))


def by_type(evaluated: DataFrame) -> DataFrame:
    means = (F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("groundedness", "relevance", "semantic_similarity"))
    return evaluated.groupBy("question_type").agg(F.count("*").alias("n"), *means)
