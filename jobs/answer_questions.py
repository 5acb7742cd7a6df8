"""Job 2: answer a table of questions from a table of documents.

    python -m jobs.answer_questions --config jobs/answer_questions.json

Each question (item_id, text) is embedded, finds its ``top_k`` documents (doc_id,
text) at ``threshold`` or above, and is answered from them; groundedness,
relevance and use of the context are measured.  ``output`` gets three tables:

    answers    a row a question, partitioned by question_type
    sources    the documents behind each answer, by rank, partitioned by query_language
    by_type    counts and means of the answers by question type and model

Documents are read once for their embeddings, which never leave their task but
as the best ``top_k`` for each question, and once for the texts that were found.
A run replaces what an earlier one wrote, partitions without rows included, so
running it again gives the same result.  A question without text or of more than
1,000 characters isn't asked, as in the engine; a document without text is never
found; paths may be remote.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import answering, embedding, evaluation, search

from . import common

log = logging.getLogger("jobs.answer_questions")

DEFAULTS = {
    "questions": None,
    "documents": None,
    "output": None,
    "top_k": 5,
    "threshold": 0.3,
    "metric": "cosine",
    "dimension": 64,
    "settings": {},
}
#: Decimals that measures are written with.
DIGITS = 6


def answers(questions: DataFrame, documents: DataFrame, top_k: int, threshold: float, metric: str, embedder: embedding.Embedder, generator: answering.Generator) -> DataFrame:
    """questions (query_id, question), answered, with sources and measures."""
    contents = documents.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    vectors = embedding.encode(contents.where(T.text_of("content") != ""), embedder, "content").select("vec_id", "embedding")
    asked = answering.valid_questions(questions)
    queries = embedding.encode(asked.select("query_id", T.query_input("question").alias("q")), embedder, "q", prefix=False)
    hits = search.topk(vectors, queries, top_k, metric, threshold)
    rows = asked.join(answering.retrieve_context(hits, contents, queries), "query_id").withColumn("memory", F.lit(""))
    out = answering.answer(rows, generator)
    measures = {
        "confidence": F.col("confidence"),
        "groundedness": evaluation.groundedness("answer", "context"),
        "relevance": evaluation.relevance("question", "context"),
        "context_utilization": evaluation.context_utilization("answer", "context"),
    }
    out = out.withColumns({k: F.round(v, DIGITS) for k, v in measures.items()}).withColumn("question_type", T.question_type("question"))
    return out.select("query_id", "question", "answer", "model_used", "query_language", "n_sources", *measures, "question_type", "sources")


def run(
    spark: SparkSession,
    questions: str,
    documents: str,
    output: str,
    top_k: int = 5,
    threshold: float = 0.3,
    metric: str = "cosine",
    dimension: int = 64,
    settings: dict[str, str] | None = None,
) -> dict[str, int]:
    """Answer a table of questions from a table of documents."""
    # A run replaces all that was there, whatever the session's mode.
    wanted = {"spark.sql.sources.partitionOverwriteMode": "static"} | (settings or {})
    with common.settings(spark, wanted):
        found = Observation("answers")
        rows = spark.read.parquet(questions).select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
        docs = spark.read.parquet(documents).select("doc_id", "text")
        log.info("reading questions of %s and documents of %s", questions, documents)
        made = answers(rows, docs, top_k, threshold, metric, embedding.HashingEmbedder(dimension), answering.ExtractiveGenerator())
        made = made.observe(found, F.count(F.lit(1)).alias("n"), F.count_if(F.col("model_used") == "none").alias("unanswered"))
        made.write.mode("overwrite").partitionBy("question_type").parquet(f"{output}/answers")
        got = spark.read.schema(made.schema).parquet(f"{output}/answers")
        sources = got.select("query_id", "query_language", F.explode("sources").alias("s"))
        sources = sources.select("query_id", F.col("s.rank").alias("rank"), F.col("s.chunk_id").cast("bigint").alias("doc_id"), "s.score", "query_language")
        sources.write.mode("overwrite").partitionBy("query_language").parquet(f"{output}/sources")
        means = (F.round(F.avg(c), DIGITS).alias(f"avg_{c}") for c in ("confidence", "groundedness", "relevance", "context_utilization"))
        got.groupBy("question_type", "model_used").agg(F.count("*").alias("n"), *means).coalesce(1).write.mode("overwrite").parquet(f"{output}/by_type")
        counts = {"questions": rows.count(), "documents": docs.count(), "answers": found.get["n"], "unanswered": found.get["unanswered"]}
    log.info("read %(questions)d questions and %(documents)d documents, wrote %(answers)d answers, %(unanswered)d of them without a source", counts)
    log.info("answers, sources and by_type are in %s", output)
    return counts


if __name__ == "__main__":
    common.main("answer_questions", run, DEFAULTS)
