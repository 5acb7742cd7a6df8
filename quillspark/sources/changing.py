"""A saved store that changes where it lies: append, update, delete, clear.

The store is a Parquet table partitioned by ``part``: the cell of each vector
where there are cells, so that a search is pruned to those it probes, or else a
hash of the chunk id.  New rows are appended.  A change reads and writes the
partitions that hold its ids alone, by Spark's dynamic partition overwrite; how
much that is, is for the number of partitions, which should grow with the store.

A row that goes leaves a grave, its id and place without content, as dynamic
overwrite leaves a partition alone that gets no rows.  ``compact`` clears graves
and gathers the small files of appended rows.

Limits, which are those of such a table: changes come one at a time; a change of
several partitions appears partition by partition; who read the table before a
change opens it again.  A change that fails before Spark commits it leaves the
store as it was, and can be made again: its result is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search

PARTS = 8
SCHEMA = "pos bigint, chunk_id string, text string, metadata map<string,string>, vector array<float>, deleted boolean, part int"
_ROW = ("pos", "chunk_id", "text", "metadata", "vector")


def hashed(parts: int = PARTS) -> Callable[[DataFrame], DataFrame]:
    """Places rows by their id."""
    return lambda rows: rows.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int"))


def by_cell(centroids, metric: str) -> Callable[[DataFrame], DataFrame]:
    """Places rows by the cell of their vector."""
    return lambda rows: search.assign_cells(rows, centroids, metric, "vector").withColumnRenamed("cell", "part")


class ChangingStore:
    """The store at ``path``; ``place`` adds a row's part, and gives the same for
    the same row as long as the store lives."""

    def __init__(self, spark: SparkSession, path: str, place: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.place = spark, path, place or hashed()

    def _raw(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def read(self) -> DataFrame:
        """pos, chunk_id, text, metadata, vector, part of what is in the store."""
        return self._raw().where("NOT deleted").drop("deleted")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return self.place(rows.select(*_ROW)).withColumn("deleted", F.lit(False)).select("pos", "chunk_id", "text", "metadata", "vector", "deleted", "part")

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """A new store of rows (pos, chunk_id, text, metadata, vector), whatever was there."""
        self._placed(rows).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        """Rows (chunk_id, text, metadata, vector, and where there is: pos, their
        order) after those of the store; an id may be there already, and the last
        row of an id is its latest."""
        last = self._raw().agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
        self._write(self._placed(search.placed_after(rows, last)), "append")

    def update(self, changes: DataFrame) -> None:
        """Text, metadata and vector of the ids in ``changes``; null leaves a
        value as it was, and an id that isn't there adds nothing.  A vector that
        changes moves its row to its new part.  Of changes to one id any counts."""
        changes = changes.dropDuplicates(["chunk_id"])
        found = self.read().drop("part").join(changes.select("chunk_id"), "chunk_id", "left_semi")
        self._change(changes.select("chunk_id"), self._placed(search.upsert(found, changes)))

    def delete(self, ids: DataFrame) -> None:
        """Remove all rows of the ids (chunk_id)."""
        self._change(ids.select("chunk_id").distinct(), None)

    def _change(self, ids: DataFrame, new: DataFrame | None) -> None:
        """Replace the rows of ``ids`` by ``new`` ones."""
        places = self._raw().join(ids, "chunk_id", "left_semi").where("NOT deleted").select("part")
        places = places if new is None else places.unionByName(new.select("part"))
        touched = [r["part"] for r in places.distinct().collect()]  # no more than there are partitions
        if not touched:
            return
        old = self._raw().where(F.col("part").isin(touched))
        kept = old.join(ids, "chunk_id", "left_anti").select(*old.columns)
        out = kept.unionByName(self._graves(old.join(ids, "chunk_id", "left_semi")))
        self._write(out if new is None else out.unionByName(new), "overwrite")

    @staticmethod
    def _graves(rows: DataFrame) -> DataFrame:
        empty = {"text": "string", "metadata": "map<string,string>", "vector": "array<float>"}
        return rows.withColumns({k: F.lit(None).cast(t) for k, t in empty.items()}).withColumn("deleted", F.lit(True)).select("pos", "chunk_id", *empty, "deleted", "part")

    def clear(self) -> None:
        """Remove all rows."""
        self._write(self._graves(self._raw().groupBy("part").agg(F.max("pos").alias("pos"), F.max("chunk_id").alias("chunk_id"))), "overwrite")

    def compact(self) -> None:
        """One file a part (Spark divides larger ones on reading), without graves,
        but one in a part that has nothing else."""
        raw = self._raw()
        live = raw.groupBy("part").agg(F.max(~F.col("deleted")).alias("live"), F.max("pos").alias("last")).where("NOT live")
        lone = self._graves(raw.join(F.broadcast(live.select("part", F.col("last").alias("pos"))), ["part", "pos"], "left_semi").dropDuplicates(["part"]))
        self._write(raw.where("NOT deleted").unionByName(lone).repartition("part"), "overwrite")
