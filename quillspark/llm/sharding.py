"""Sharding by sampled splitters (operator 10).

Records are ordered by a 64-bit key whose high bits hash the text and whose low
bits hash the record, so equal texts are neighbours and yet can be told apart.
A size-weighted sample of the keys gives quantile boundaries; the records are
range-partitioned by them, each range is measured exactly, and ranges that came
out overfull are sampled again and subdivided.  The measured ranges are then
dealt to the shards, largest first, always to the emptiest shard.

Ranges follow the rows: at least ``ranges_per_shard``, and more where a range
would have over ``ROWS_PER_RANGE`` rows on average, so a task that ranks the
slots of a range has about so many at any size.  What reaches the driver is the
sample (``sample_per_range`` keys expected a range and round) and one row per
range, that is some 20 keys for a million rows.  A group of equal texts stays in one shard unless it is larger than
``group_ranges`` range quotas; larger groups are divided like anything else, so
a hot text never overfills a shard or a task.

Edge cases: a null text counts as empty (size 16, CRC 0); null ids are allowed;
repeated rows each get their own slot; an empty table gives an empty result;
extra columns are ignored; a record larger than a range has one for itself.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

N_SHARDS = 40
RANGES_PER_SHARD = 64
SAMPLE_PER_RANGE = 16
GROUP_RANGES = 16
ROWS_PER_RANGE = 1_000_000
ROUNDS = 4
_LOW = (1 << 24) - 1


def _draw(rows: DataFrame, per_byte: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys drawn with chance size * per_byte, and the bytes each stands for."""
    got = rows.where(F.rand(seed) < F.col("size") * F.lit(per_byte)).select("key", "size").toPandas()
    return got["key"].to_numpy(np.int64), np.maximum(got["size"].to_numpy(np.float64), 1 / per_byte)


def splitters(keys: np.ndarray, weights: np.ndarray, quota: float, group_ranges: int) -> np.ndarray:
    """Boundaries after each ``quota`` of sampled weight.  One that would divide
    a group of equal texts moves to the group's start, unless the group weighs
    over ``group_ranges`` quotas."""
    if not len(keys):
        return np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, cum = keys[order], np.cumsum(weights[order])
    at = np.searchsorted(cum, np.arange(quota, cum[-1], quota))
    cuts = np.unique(keys[at])
    group = keys & ~np.int64(_LOW)
    first = np.searchsorted(group, cuts & ~np.int64(_LOW), "left")
    last = np.searchsorted(group, cuts & ~np.int64(_LOW), "right") - 1
    weight = cum[last] - np.where(first > 0, cum[first - 1], 0)
    return np.unique(np.where(weight > group_ranges * quota, cuts, cuts & ~np.int64(_LOW)))


def _ranged(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "right").astype(np.int32))

    return rows.withColumn("range", range_of("key"))


def deal(sizes: list[int], n_shards: int) -> list[int]:
    """Shard of each range: largest first, to the emptiest shard."""
    heap = [(0, s) for s in range(n_shards)]
    shard = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        filled, s = heapq.heappop(heap)
        shard[i] = s
        heapq.heappush(heap, (filled + sizes[i], s))
    return shard


def shard(
    docs: DataFrame,
    n_shards: int = N_SHARDS,
    ranges_per_shard: int = RANGES_PER_SHARD,
    sample_per_range: int = SAMPLE_PER_RANGE,
    group_ranges: int = GROUP_RANGES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every record."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    record = F.xxhash64(F.col(id_col), F.monotonically_increasing_id())
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).bitwiseAND(F.lit(~_LOW)).bitwiseOR(record.bitwiseAND(F.lit(_LOW))).alias("key"),
        ),
        "shard-keys",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    more = max(1, -(-n // (n_shards * ranges_per_shard * ROWS_PER_RANGE)))
    n_ranges, group_ranges = n_shards * ranges_per_shard * more, group_ranges * more
    quota = max(1.0, total / n_ranges)
    bounds = np.empty(0, np.int64)
    per_byte = sample_per_range / quota
    if total:
        bounds = splitters(*_draw(rows, per_byte, 1), quota, group_ranges)
    for again in range(2, ROUNDS + 2):
        measured = _ranged(rows, bounds).groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
        over = [r["range"] for r in measured if r["bytes"] > 2 * quota and r["n"] > 1]
        if not over or again > ROUNDS:
            break
        finer = _ranged(rows, bounds).where(F.col("range").isin(over))
        more = splitters(*_draw(finer, per_byte * 4 ** (again - 1), again), quota, group_ranges)
        grown = np.union1d(bounds, more)
        if len(grown) == len(bounds):
            break
        bounds = grown
    measured.sort(key=lambda r: r["range"])
    shards = deal([r["bytes"] for r in measured], n_shards)
    filled = [0] * n_shards
    plan = []
    for r, s in zip(measured, shards, strict=True):
        plan.append((r["range"], s, filled[s]))
        filled[s] += r["n"]
    places = spark.createDataFrame(plan, "range int, shard int, base long")
    within = F.row_number().over(Window.partitionBy("range").orderBy("key", "doc_id", "size"))
    return (
        _ranged(rows, bounds)
        .withColumn("rn", within)
        .join(F.broadcast(places), "range")  # one row a range: bounded by the parameters
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rn") - 1).alias("slot"))
    )


def op10_sampled_sharding(spark, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes for the whole ``documents`` table."""
    got = shard(table(spark, sf_dir, "documents"), N_SHARDS)
    return got.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
