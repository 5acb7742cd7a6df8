"""Streaming ingest (an extension): pages arrive, chunks are appended.

Chunks are made in the row.  Those that a document already has are dropped by
keyed state, a key of 16 bytes and the document for each chunk stored, which
Spark keeps in the checkpoint and divides over ``spark.sql.shuffle.partitions``;
nothing that is stored is read again.  The file sink's log makes each batch
appear once, so a query that was stopped anywhere goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking


def chunk_stream(pages: DataFrame, strategy: str = "sentences", size: int = chunking.SIZE, min_size: int = chunking.MIN_SIZE) -> DataFrame:
    """The new chunks of a stream (or a table) of pages (doc_id, page_number,
    text).  Of equal contents on pages of one document that arrive together one
    stays, of those on one page the first; a null or empty text has no chunks."""
    chunks = chunking.chunk_rows(pages, strategy, size, min_size)
    return chunks.withColumn("content_key", F.unhex(chunking.content_key(F.col("content")))).dropDuplicates(["doc_id", "content_key"])


def ingest_pages(
    pages: DataFrame,
    store: str,
    checkpoint: str,
    strategy: str = "sentences",
    size: int = chunking.SIZE,
    min_size: int = chunking.MIN_SIZE,
    partition_by: tuple[str, ...] = ("language",),
) -> StreamingQuery:
    """Start a query that chunks what the stream has now into the Parquet table
    ``store``.  The observations ``read`` (pages) and ``written`` (chunks) are in
    the query's progress."""
    chunks = chunk_stream(pages.observe("read", F.count(F.lit(1)).alias("pages")), strategy, size, min_size)
    chunks = chunks.observe("written", F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("characters"))
    writer = chunks.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint)
    return writer.partitionBy(*partition_by).trigger(availableNow=True).start()
