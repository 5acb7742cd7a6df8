"""Job 1: take up new documents into a table of chunks.

    python -m jobs.ingest_chunks --config jobs/ingest_chunks.json

A folder of Parquet files (doc_id, text and any more) is read as a stream.  A run
takes the files that have come since the last one, as the checkpoint knows, in
micro-batches of ``max_files``, cleans and chunks them, and appends the chunks
that their document doesn't have yet to ``output``, partitioned by language.  So
a document that is delivered again adds nothing, and a changed one adds what
changed.  A run that finds nothing new leaves the table as it is; one that was
stopped goes on where it was, and the sink's log makes each batch count once.

``input`` is a folder or a glob; paths may be remote.  Where batches are few large
files, fewer than there are cores, ``spread`` deals their documents to so many
tasks; 0 leaves them as they are read.  The number of shuffle
partitions of the first run stays with the checkpoint.
"""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession

from quillspark.operators import chunking
from quillspark.streaming.ingest import ingest_pages

from . import common

log = logging.getLogger("jobs.ingest_chunks")

DEFAULTS = {
    "input": None,
    "output": None,
    "checkpoint": None,
    "strategy": "sentences",
    "size": chunking.SIZE,
    "min_size": chunking.MIN_SIZE,
    "max_files": 1_000,
    "spread": 0,
    "settings": {},
}


def run(
    spark: SparkSession,
    input: str,
    output: str,
    checkpoint: str,
    strategy: str = "sentences",
    size: int = chunking.SIZE,
    min_size: int = chunking.MIN_SIZE,
    max_files: int = 1_000,
    spread: int = 0,
    settings: dict[str, str] | None = None,
) -> dict[str, int]:
    """Take up new documents into a table of chunks."""
    # All batches of a run are counted, not only the last hundred.
    wanted = {"spark.sql.streaming.numRecentProgressUpdates": "100000"} | (settings or {})
    with common.settings(spark, wanted):
        schema = spark.read.parquet(input).select("doc_id", "text").schema
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(input)
        pages = arriving.selectExpr("doc_id", "1 AS page_number", "text")
        if spread:
            pages = pages.repartition(spread, "doc_id")
        log.info("reading what is new in %s (checkpoint %s)", input, checkpoint)
        query = ingest_pages(pages, output, checkpoint, strategy, size, min_size)
        query.awaitTermination()
        counts = {"documents": 0, "chunks": 0, "characters": 0}
        for progress in query.recentProgress:
            found = progress.observedMetrics
            if "read" in found and "written" in found:
                read, written = found["read"], found["written"]
                counts["documents"] += read["pages"]
                counts["chunks"] += written["chunks"]
                counts["characters"] += written["characters"]
                log.info("batch %d: read %d documents, wrote %d chunks", progress.batchId, read["pages"], written["chunks"])
    log.info("read %(documents)d documents, wrote %(chunks)d chunks of %(characters)d characters", counts)
    log.info("chunks are in %s", output)
    return counts


if __name__ == "__main__":
    common.main("ingest_chunks", run, DEFAULTS)
