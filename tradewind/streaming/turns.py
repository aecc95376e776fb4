"""Follow-up questions as a stream: the state of a conversation is its last question and the last answer to it.

A turn changes the state of its own conversation only, so keys spread over tasks and a state stays two texts long, however
long the conversation. The state store is Spark's own (checkpointed with the stream, so a lost executor loses nothing).
The turns of a batch are taken in their order; a turn that comes after later ones of its conversation were taken is
passed over, as the batch query could only tell afterwards. What comes out is written out by the same expressions as in
the batch query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.followups import rewritten
from ..session import ship_package

OUT = "conv_id long, turn long, question string, previous string, last_answer string"
STATE = "turn long, question string, answer string"


class LastExchange(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        turns = pd.concat(list(rows)).sort_values("turn", kind="stable")
        taken, question, answer = self.last.get() if self.last.exists() else (-1, None, None)
        out = []
        for turn, role, text in turns[["turn", "role", "text"]].itertuples(index=False):
            if turn <= taken:
                continue
            taken = int(turn)
            if role == "user":
                out.append((int(key[0]), taken, text, question, answer))
                question, answer = text, None
            elif role == "assistant" and question is not None:
                answer = text
        self.last.update((taken, question, answer))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stream(turns: DataFrame) -> DataFrame:
    """As followups.batch, over a stream of turns (conv_id, turn, role, text). Needs a state store that holds several
    values: spark.sql.streaming.stateStore.providerClass must name the RocksDB provider."""
    ship_package(turns.sparkSession)
    kept = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").transformWithStateInPandas(LastExchange(), OUT, "Append", "None")
    return rewritten(kept)
