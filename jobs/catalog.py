"""The jobs as registered queries: each runs twice into one new folder and gives
the whole output as it then stands, with SQL for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans import catalog
from quillspark.sources.folders import session_folder

from . import answer_questions, ingest_chunks


def job1_ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = session_folder(spark, "job1", keep=True)
    # A file stream takes a folder or a glob; the table may be a single file.
    for _ in range(2):
        ingest_chunks.run(spark, f"{sf_dir}/documents.parque[t]", f"{out}/chunks", f"{out}/checkpoint", spread=spark.sparkContext.defaultParallelism)
    return spark.read.parquet(f"{out}/chunks").withColumn("content_key", F.lower(F.hex("content_key")))


def job2_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = session_folder(spark, "job2", keep=True)
    for _ in range(2):
        answer_questions.run(spark, f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet", out)
    sources = spark.read.parquet(f"{out}/sources").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("s"))
    doc_ids = F.array_join(F.transform("s", lambda x: x["doc_id"].cast("string")), ",")
    answers = spark.read.parquet(f"{out}/answers").drop("sources")
    return answers.join(sources.select("query_id", doc_ids.alias("doc_ids")), "query_id", "left")


_KEY = f"md5({T.sql_rewrite('lower(content)', catalog.P.TRIM)})"
JOB1_SQL = (
    "SELECT doc_id, 1 AS source_page, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1)::INT AS seq, content, "
    f"chunk_id, chunk_index, language, content_type, word_count, char_count, {_KEY} AS content_key "
    f"FROM ({catalog.DOCUMENT_CHUNKS_SQL})"
)
_ASKED = catalog.answers_sql(", question, context, n")
JOB2_SQL = f"""
WITH a AS ({_ASKED}), ids AS (SELECT query_id AS q, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS doc_ids FROM (WITH {catalog.found_sql(5)} SELECT * FROM found) GROUP BY 1)
SELECT query_id, question, answer, model_used, query_language, n::INT AS n_sources, confidence::DOUBLE AS confidence,
  round(({catalog.GROUND_SQL})::DOUBLE, 6) AS groundedness, round(({catalog.RELEVANT_SQL})::DOUBLE, 6) AS relevance,
  round(({catalog.UTIL_SQL})::DOUBLE, 6) AS context_utilization, {catalog.QUESTION_TYPE_SQL} AS question_type, doc_ids
FROM a LEFT JOIN ids ON q = query_id WHERE length(question) BETWEEN 1 AND 1000
"""


def queries() -> dict:
    return {"job1_ingest_chunks": job1_ingest_chunks, "job2_answer_questions": job2_answer_questions}


def oracle_sql() -> dict[str, str]:
    return {"job1_ingest_chunks": JOB1_SQL, "job2_answer_questions": JOB2_SQL}
