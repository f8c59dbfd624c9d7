"""Conversation archives: old turns leave when the active ones exceed a token threshold."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import token_count

THRESHOLD = 80_000


def numbered(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Adds turn_index, from 0 in each conversation."""
    return turns.withColumn("turn_index", F.row_number().over(W.partitionBy(conv).orderBy(order)) - 1)


def archived(turns: DataFrame, threshold: int | Column = THRESHOLD, tokens: Column | None = None) -> DataFrame:
    """Adds tokens and archived_at: the turn by whose append the row leaves, null while active.

    With C the running sum of tokens, turn j leaves at the first later turn i with
    C(i) - C(j - 1) over the threshold. As C never falls, that is a search in a sorted
    sequence: rows are merged with their own targets C(j - 1) + threshold, and one window in
    the order of running sums finds the first turn beyond, in n log n for any length. The
    last turn never leaves. A column is a threshold a turn, that of the append; sums less
    thresholds may fall, so a conversation's turns are then worked through in order.
    """
    count = token_count(F.col("text")) if tokens is None else tokens
    rows = turns.withColumn("tokens", count.cast("bigint"))
    if not isinstance(threshold, int):
        return _archived_in_order(rows, threshold)
    by = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.sum("tokens").over(by))
    rows = rows.withColumn("_goal", F.col("_c") - F.col("tokens") + F.lit(threshold))
    # a turn sorts at its running sum; a question sorts after all turns of its goal, and looks ahead
    marks = rows.select("conv_id", "turn", F.explode(F.array(
        F.struct(F.col("_c").alias("at"), F.lit(0).alias("ask"), F.col("turn").alias("seen")),
        F.struct(F.col("_goal").alias("at"), F.lit(1).alias("ask"), F.lit(None).cast("bigint").alias("seen")),
    )).alias("m")).select("conv_id", "turn", "m.*")
    ahead = W.partitionBy("conv_id").orderBy("at", "ask", "turn").rowsBetween(1, W.unboundedFollowing)
    found = marks.withColumn("archived_at", F.first("seen", ignorenulls=True).over(ahead)).where("ask = 1")
    # a turn over the threshold alone leaves at the next turn, not at its own
    later = W.partitionBy("conv_id").orderBy("turn")
    found = found.select("conv_id", "turn", "archived_at")
    out = rows.withColumn("_next", F.lead("turn").over(later)).join(found, ["conv_id", "turn"])
    at = F.when(F.col("_next").isNotNull() & F.col("archived_at").isNotNull(), F.greatest("archived_at", "_next"))
    return out.withColumn("archived_at", at).drop("_c", "_goal", "_next")


def _archived_in_order(rows: DataFrame, threshold: Column) -> DataFrame:
    """One queue a conversation: each append pops the oldest turns while the rest is over its threshold."""

    def each(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("turn", kind="stable")
        waiting, held, left = deque(), 0, []
        for turn, tokens, most in part[["turn", "tokens", "most"]].itertuples(index=False, name=None):
            waiting.append((turn, tokens))
            held += tokens
            while held > most and len(waiting) > 1:
                old, n = waiting.popleft()
                held -= n
                left.append((old, turn))
        at = dict(left)
        return pd.DataFrame({"conv_id": part["conv_id"], "turn": part["turn"], "archived_at": pd.array([at.get(t) for t in part["turn"]], dtype="Int64")})

    slim = rows.select("conv_id", "turn", "tokens", threshold.cast("bigint").alias("most"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in ("conv_id", "turn")}
    found = slim.groupBy("conv_id").applyInPandas(each, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, archived_at bigint")
    return rows.join(found, ["conv_id", "turn"])


def node_id(conv: Column, at: Column) -> Column:
    return F.sha2(F.concat(conv.cast("string"), F.lit(":"), at.cast("string")), 256)


def nodes(rows: DataFrame) -> DataFrame:
    """(node_id, conv_id, archived_at, depth, child_count, total_tokens, roles, child_turns), a row an archive step."""
    children = F.array_sort(F.collect_list(F.struct("turn", "role")))
    out = rows.where("archived_at is not null").groupBy("conv_id", "archived_at").agg(F.count("*").alias("child_count"), F.sum("tokens").alias("total_tokens"), children.alias("c"))
    return out.select(node_id(F.col("conv_id"), F.col("archived_at")).alias("node_id"), "conv_id", "archived_at", F.lit(0).alias("depth"), "child_count", "total_tokens", F.transform("c", lambda x: x.role).alias("roles"), F.transform("c", lambda x: x.turn).alias("child_turns"))


def active_tokens(rows: DataFrame) -> DataFrame:
    """(conv_id, active_tokens, next_index) of the turns that haven't left."""
    return rows.groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("archived_at").isNull(), F.col("tokens"))), F.lit(0)).alias("active_tokens"), (F.coalesce(F.max("turn"), F.lit(-1)) + 1).alias("next_index"))


def expand(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node_id, turn, role, text, tokens) of the wanted nodes' turns."""
    own = rows.where("archived_at is not null").withColumn("node_id", node_id(F.col("conv_id"), F.col("archived_at")))
    return wanted.select("node_id").join(own, "node_id").select("node_id", "turn", "role", "text", "tokens")


def unknown(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node_id, error) of wanted ids that no archive step has: ``unknown_node``."""
    known = rows.where("archived_at is not null").select(node_id(F.col("conv_id"), F.col("archived_at")).alias("node_id"))
    return wanted.select("node_id").join(known, "node_id", "left_anti").withColumn("error", F.lit("unknown_node"))
