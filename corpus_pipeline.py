"""A corpus pipeline over ``documents``: toxicity, line dedup, near-duplicates,
benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame that is written as Parquet and read again.  All but the
last return the columns of ``documents``; the last returns the packed pieces.

Defined results at the edges: a document without text has no toxic words and is
kept, its text becomes the empty text in line dedup, is nobody's duplicate and
packs as a separator alone; rows that repeat a doc_id stay or go together; a row
without doc_id is a document of its own, which goes as a duplicate of any row
with an id, and for a passage; an empty table gives an empty result; further
columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, linededup, neardup, packing, toxicity
from quillspark.llm.common import join_bounded, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids to drop are broadcast up to this many; beyond, they are joined.
MAX_BROADCAST_IDS = 1_000_000


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``row_key`` to drop rows by: the id, and for rows without
    one a number of their own, above all ids.  These are written, as the numbers
    must stay; where there are none, the scan finds that from statistics."""
    docs = docs.select(*COLUMNS)
    lone = docs.where("doc_id IS NULL")
    keyed = docs.where("doc_id IS NOT NULL").withColumn("row_key", F.col("doc_id"))
    if lone.isEmpty():
        return keyed
    number = F.lit(2**63 - 1) - F.monotonically_increasing_id()
    return keyed.unionByName(materialize(lone.withColumn("row_key", number), "rows-without-id"))


def _without(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    """``keyed`` but the rows whose key is in ``dropped`` (column doc_id)."""
    dropped = materialize(dropped.select(F.col("doc_id").alias("row_key")).distinct(), "dropped-rows")
    return join_bounded(keyed, dropped, "row_key", "left_anti", MAX_BROADCAST_IDS).select(*COLUMNS)


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5.  The model is fitted on a bounded sample
    of the labelled documents outside the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    scored = toxicity.score(docs, model, carry=("text", "lang", "source", "n_chars"))
    return scored.where("score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines found in ten documents or more.  Copies of a
    text, ten or more, would lose all of it: they stay for the next stage."""
    left = linededup.dedup_lines(docs, min_docs=10, keep_first=False, keep_copies=True, carry=("lang", "source"))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 or more."""
    keyed = _keyed(docs)
    found = neardup.near_duplicates(keyed, percent=80, id_col="row_key")
    return _without(keyed, found.where("NOT kept"))


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    keyed = _keyed(docs)
    return _without(keyed, decontaminate.match_items(keyed, table(spark, sf_dir, "benchmark"), id_col="row_key"))


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of at most 4,096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learning, sketches, edit distances and tokens are beyond SQL; the tests hold
#: each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
