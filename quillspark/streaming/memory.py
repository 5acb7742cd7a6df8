"""Conversation memory on a stream: keyed state of each conversation's last messages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.memory import HEADING, message_line


def memory_stream(turns: DataFrame, last: int = 4) -> DataFrame:
    """conv_id, turn, text, memory of every user message of a stream of (conv_id,
    turn, role, text), as ``memory_by_turn`` gives them for a table.

    A conversation's messages must arrive in order, a micro-batch's in any order
    within it.  The state of a conversation is its last messages, whatever it has
    had; it is in the checkpoint, so a query that starts again goes on with it.
    Messages without conv_id are left out.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["turn", "text"], kind="stable", na_position="first")
        found = []
        for turn, role, text, line in zip(rows["turn"], rows["role"], rows["text"], rows["line"], strict=True):
            if role == "user":
                found.append((key[0], turn, text, HEADING + "\n".join(lines) if lines else ""))
            lines = [*lines, line][-last:]
        state.update((json.dumps(lines),))
        yield pd.DataFrame(found, columns=["conv_id", "turn", "text", "memory"])

    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    rows = turns.where(F.col("role").isin("user", "assistant") & F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text", message_line().alias("line"))
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, text string, memory string"
    return rows.groupBy("conv_id").applyInPandasWithState(step, schema, "lines string", "append", GroupStateTimeout.NoTimeout)
