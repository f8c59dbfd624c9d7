"""Sharding by weighted rendezvous hashing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

SHARDS = 24
SEED = 0
#: About so many rows are numbered by one task.
RUN = 50_000
#: The most equal rows that one generated array stands for.
PIECE = 65_536


def rendezvous(key: Column, weights: list[float], seed: int = SEED) -> Column:
    """The shard with the highest score -weight / ln(u), u a hash of key and shard in (0, 1).

    A shard's score depends on key, shard and its own weight alone: one more shard draws
    rows into itself only, and a weight change moves rows only into or out of that shard.
    Ties go to the greatest shard. Shards of weight 0 get nothing.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    u = lambda i: (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(i)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    scores = [F.struct((F.lit(-float(w)) / F.ln(u(i))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return F.array_max(F.array(*scores)).getField("shard")


def numbered(rows: DataFrame, group: str, order: list[str], count: int) -> DataFrame:
    """``slot``: each row's place in its group, from 0 without gaps, without one task a group.

    Equal rows are counted first, so a row that is repeated often is one row here. A group's
    rows are dealt to runs by a hash of the row; the runs' sizes, a small table, are summed
    to the runs' first places; rows get their places within runs of about ``RUN`` rows, and
    counts become rows again at the end, at most ``PIECE`` to an array.
    """
    runs = max(1, -(-count // RUN))
    unique = rows.groupBy(group, *order).agg(F.count("*").alias("n"))
    unique = cut(unique.withColumn("run", F.pmod(F.xxhash64(*order), F.lit(runs)).cast("int")))
    before = W.partitionBy(group).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    sizes = unique.groupBy(group, "run").agg(F.sum("n").alias("size"))
    firsts = cut(sizes.select(F.col(group).alias("g"), F.col("run").alias("r"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first")))
    placed = unique.join(firsts, F.col(group).eqNullSafe(F.col("g")) & (F.col("run") == F.col("r"))).drop("g", "r")
    within = W.partitionBy(group, "run").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("first", F.col("first") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    pieces = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PIECE}"))))
    offset = F.explode(F.sequence(F.col("piece") * PIECE, F.least(F.col("n"), (F.col("piece") + 1) * PIECE) - 1))
    return pieces.select(group, *order, "first", offset.alias("offset")).select(group, *order, (F.col("first") + F.col("offset")).alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: id, weights and number of shards decide, so rows of one id, and of
    null ids, share a shard. size: the text's UTF-8 bytes plus 8 (null: none). grown_shard:
    the shard with one more of weight 1. slot: the row's place in its shard; equal rows get
    different places. An empty table gives no rows.
    """
    weights = [1.0] * shards if weights is None else weights
    key = F.col("doc_id")
    base = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    rows = base.withColumn("shard", rendezvous(key, weights, seed))
    out = numbered(rows, "shard", ["doc_id", "size", "text_crc32"], -(-docs.select(id_col).count() // len(weights)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), rendezvous(key, [*weights, 1.0], seed).alias("grown_shard"))
