"""Row types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

PAGE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("tables", T.StringType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("extraction_method", T.StringType()),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("source_page", T.IntegerType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("char_count", T.IntegerType()),
        T.StructField("overlap_start", T.IntegerType()),
        T.StructField("overlap_end", T.IntegerType()),
    ]
)

VECTOR = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)

RESPONSE = T.StructType(
    [
        T.StructField("answer", T.StringType()),
        T.StructField("source_chunks", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("query_language", T.StringType()),
        T.StructField("model_used", T.StringType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("total_tokens", T.IntegerType()),
    ]
)

TEST_CASE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("expected_context_keywords", T.ArrayType(T.StringType())),
    ]
)
