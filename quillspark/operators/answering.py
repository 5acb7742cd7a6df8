"""Answering in batches: context, confidence, prompts, answers, post-processing."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

NOT_FOUND = "No matching passage was found."
FAILED = "The question could not be answered because of an error."
TIMED_OUT = "The question took too long and was given up."
PROMPT = "Answer briefly from the passage alone.\n\nPassage:\n{context}\n\nQuestion: {question}\nAnswer:"


class Generator(Protocol):
    """Turns prompts into answers; must be picklable."""

    name: str

    def generate(self, questions: list[str], contexts: list[str], prompts: list[str]) -> list[str]: ...


class ExtractiveGenerator:
    """A stand-in without a model: the sentence of the context that shares most
    words with the question, the first of equals."""

    name = "extractive"

    def generate(self, questions: list[str], contexts: list[str], prompts: list[str]) -> list[str]:
        out = []
        for question, context in zip(questions, contexts, strict=True):
            wanted = set(question.lower().split())
            parts = [s.strip() for s in context.replace("।", ".").split(".") if s.strip()]
            out.append(max(parts, key=lambda s: len(wanted & set(s.lower().split())), default=""))
        return out


def valid_questions(questions: DataFrame) -> DataFrame:
    """Questions of 1 to 1,000 characters."""
    return questions.where(F.length("question").between(1, 1000))


def confidence(scores: Column, lengths: Column) -> Column:
    """From the sources' scores and content lengths (arrays); 0 without any."""
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / n
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda s, x: s + x)
    value = mean * 0.6 + F.least(n / 3.0, F.lit(1.0)) * 0.2 + F.least(total / 1000.0, F.lit(1.0)) * 0.2
    return F.when(n <= 0, 0.0).otherwise(F.least(value, F.lit(1.0)))


SOURCE = "struct<rank:int,score:double,chunk_id:string,content:string,metadata:map<string,string>>"


def with_content(hits: DataFrame, contents: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Hits (query_id, rank, score, id) as query_id and ``source``: what a client
    is shown of each.  ``contents`` has the id, the content, and where there are,
    chunk_id (else the id) and metadata (else null)."""
    given = F.col("chunk_id") if "chunk_id" in contents.columns else F.col(id_col)
    metadata = F.col("metadata") if "metadata" in contents.columns else F.lit(None)
    of = contents.select(F.col(id_col), given.cast("string").alias("chunk_id"), T.text_of("content").alias("content"), metadata.cast("map<string,string>").alias("metadata"))
    joined = hits.select("query_id", id_col, "rank", "score").join(of, id_col)
    return joined.select("query_id", F.struct("rank", "score", "chunk_id", "content", "metadata").cast(SOURCE).alias("source"))


def retrieve_context(hits: DataFrame, contents: DataFrame, queries: DataFrame, id_col: str = "vec_id", separator: str = "\n\n") -> DataFrame:
    """query_id, n_sources, context, confidence and the sources by rank for every
    query.  ``hits`` has at most k rows a query, so its groups are small."""
    found = with_content(hits, contents, id_col).groupBy("query_id").agg(F.collect_list("source").alias("s"))
    found = found.withColumn("s", F.array_sort("s", lambda a, b: a["rank"] - b["rank"]))
    full = queries.select("query_id").distinct().join(found, "query_id", "left")
    full = full.withColumn("s", F.coalesce("s", F.array().cast(f"array<{SOURCE}>")))
    contents_ = F.transform("s", lambda x: x["content"])
    lengths = F.transform("s", lambda x: F.length(x["content"]).cast("bigint"))
    return full.select(
        "query_id",
        F.size("s").alias("n_sources"),
        F.array_join(contents_, separator).alias("context"),
        confidence(F.transform("s", lambda x: x["score"]), lengths).alias("confidence"),
        F.col("s").alias("sources"),
    )


def postprocess_answer(c: str | Column, semantics: str = "intended") -> Column:
    """Cut the answer label, take the last labelled answer of several, and keep
    two words of more than three.  ``observed`` leaves the label's colon."""
    text = T.strip(T.text_of(c))
    cut = len(P.ANSWER_PREFIX) + (0 if semantics == "observed" else 1)
    text = F.when(text.startswith(P.ANSWER_PREFIX), T.strip(F.substr(text, F.lit(cut)))).otherwise(text)

    def last_answer(t: Column) -> Column:
        labelled = F.filter(F.split(t, "\n"), lambda x: T.strip(x).startswith(P.ANSWER_PREFIX))
        own = T.strip(F.split(F.element_at(labelled, -1), P.ANSWER_PREFIX)[1])
        several = F.contains(t, F.lit(P.QUESTION_PREFIX)) & F.contains(t, F.lit(P.ANSWER_PREFIX)) & (F.size(labelled) > 0)
        return F.when(several, own).otherwise(t)

    text = F.transform(F.array(text), last_answer)[0]
    words = T.words(text)
    return F.when(F.size(words) > 3, F.array_join(F.slice(words, 1, 2), " ")).otherwise(text)


def prompt(context: Column, question: Column) -> Column:
    before, between, after = PROMPT.replace("{context}", "\0").replace("{question}", "\0").split("\0")
    return F.concat(F.lit(before), context, F.lit(between), question, F.lit(after))


def generated(generator: Generator, questions: list[str], contexts: list[str], prompts: list[str]) -> list[str | None]:
    """Answers of a batch.  If it fails, each prompt is tried by itself, twice;
    None for one that fails alone."""
    try:
        return list(generator.generate(questions, contexts, prompts))
    except Exception:  # whatever a plugged-in model raises
        out: list[str | None] = []
        for row in zip(questions, contexts, prompts, strict=True):
            got = None
            for _ in range(2):
                try:
                    got = generator.generate(*([x] for x in row))[0]
                    break
                except Exception:
                    continue
            out.append(got)
        return out


def answer(questions: DataFrame, generator: Generator, semantics: str = "intended") -> DataFrame:
    """questions (query_id, question, context, confidence, memory) with answers.
    Without context the generator is not asked; a prompt that it fails on gets
    an error row, and the others their answers."""

    @F.pandas_udf("string")
    def run(question: pd.Series, context: pd.Series, text: pd.Series) -> pd.Series:
        asked = (context.fillna("") != "").to_numpy()
        out = np.full(len(context), None, object)
        out[asked] = generated(generator, *(x[asked].tolist() for x in (question, context, text)))
        return pd.Series(out, dtype=object)

    asked = questions.withColumn("prompt", prompt(F.concat("context", F.coalesce("memory", F.lit(""))), F.col("question")))
    none = F.col("context") == ""
    failed = F.col("raw").isNull()
    return asked.withColumn("raw", run("question", "context", "prompt")).withColumns(
        {
            "answer": F.when(none, NOT_FOUND).when(failed, FAILED).otherwise(postprocess_answer("raw", semantics)),
            "model_used": F.when(none, "none").when(failed, "error").otherwise(generator.name),
            "confidence": F.when(none | failed, 0.0).otherwise(F.col("confidence")),
            "query_language": T.query_language("question"),
        }
    ).drop("raw")
