"""The archive as a stream: turns come in, archive steps go out, state by conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.timeline import THRESHOLD

OUT = "conv_id bigint, node_id string, archived_at bigint, child_count bigint, total_tokens bigint, roles array<string>, child_turns array<bigint>"


class Archiver(StatefulProcessor):
    """Keeps the active turns of a conversation; an append that exceeds the threshold archives the
    oldest until it is met, never the turn just appended. Turns of a batch are taken in their order."""

    def __init__(self, threshold: int = THRESHOLD):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn bigint, role string, tokens bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active = list(self.turns.get()) if self.turns.exists() else []
        out = []
        for turn, role, tokens in sorted(pd.concat(list(rows))[["turn", "role", "tokens"]].itertuples(index=False, name=None)):
            active.append((int(turn), role, int(tokens)))
            total, gone = sum(t[2] for t in active), []
            while total > self.threshold and len(active) > 1:
                gone.append(active.pop(0))
                total -= gone[-1][2]
            if gone:
                node = hashlib.sha256(f"{key[0]}:{turn}".encode()).hexdigest()
                out.append((key[0], node, int(turn), len(gone), sum(t[2] for t in gone), [t[1] for t in gone], [t[0] for t in gone]))
        self.turns.put(active) if active else self.turns.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def archive_stream(turns: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Archive steps of a stream of (conv_id, turn, role, tokens); needs the RocksDB state store."""
    return turns.groupBy("conv_id").transformWithStateInPandas(Archiver(threshold), OUT, "Append", "None")
