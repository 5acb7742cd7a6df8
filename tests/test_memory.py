"""Memory before every turn: a plain version, long conversations, the stream."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import memory
from quillspark.streaming.memory import memory_stream

TURNS = "conv_id bigint, turn bigint, role string, text string"


def talk(seed, conversations=5, long=400):
    rng = random.Random(seed)
    rows = [(9, t, rng.choice(["user", "assistant", "system"]), f"long {t}") for t in range(long)]
    for c in range(conversations):
        turns = sorted(rng.sample(range(100), rng.randrange(1, 30)))
        rows += [(c, t, rng.choice(["user", "user", "assistant", "system"]), rng.choice([f"text {t}", "", None])) for t in turns]
    return rows


def plain(rows, last=4):
    out, seen = [], {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        if role == "system":
            continue
        lines = seen.setdefault(c, [])
        if role == "user":
            out.append((c, t, text, "\n\nRecent conversation:\n" + "\n".join(lines[-last:]) if lines else ""))
        lines.append(("Human: " if role == "user" else "Assistant: ") + (text or ""))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "turn", "text", "memory").collect()), key=repr)


@pytest.mark.parametrize("block", [1_000, 7, 5])
@pytest.mark.parametrize("last", [4, 1])
def test_memory_by_turn(spark, block, last):
    rows = talk(1)
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("n", "part", "line")})
    assert got(memory.memory_by_turn(df, last, block)) == plain(rows, last)
    assert memory.memory_by_turn(spark.createDataFrame([], TURNS)).count() == 0
    numbered = memory.numbered_messages(df, block).where("conv_id = 9").select("i").collect()
    assert sorted(r[0] for r in numbered) == list(range(len(numbered)))


def test_null_turns_and_repeats(spark):
    rows = [(1, None, "user", "a"), (1, 1, "user", "b"), (1, 1, "user", "b"), (None, 3, "user", "x"), (None, 4, "assistant", "y"), (None, 5, "user", "z")]
    found = got(memory.memory_by_turn(spark.createDataFrame(rows, TURNS), 2))
    head = memory.HEADING
    want = [(1, None, "a", ""), (1, 1, "b", head + "Human: a"), (1, 1, "b", head + "Human: a\nHuman: b"), (None, 3, "x", ""), (None, 5, "z", head + "Human: x\nAssistant: y")]
    assert found == sorted(want, key=repr)


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = talk(3, long=60)
    source, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))

    def run():
        stream = memory_stream(spark.readStream.schema(TURNS).parquet(source))
        query = stream.writeStream.format("parquet").option("path", store).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()

    for low, high in ((0, 20), (20, 55), (55, 1_000)):
        part = [r for r in rows if low <= r[1] < high]
        random.Random(low).shuffle(part)
        spark.createDataFrame(part, TURNS).repartition(3).write.mode("append").parquet(source)
        run()
    assert got(spark.read.parquet(store)) == plain(rows) == got(memory.memory_by_turn(spark.read.parquet(source)))
    run()
    assert got(spark.read.parquet(store)) == plain(rows)
