"""Corpora: templates once, trash out, chunks packed, slots shared out, samples chosen."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import spans as S
from ..functions import text as T
from ..session import cut
from .stats import numbered


def template_dedup(lines: DataFrame, key: Column | None = None) -> DataFrame:
    """The first line of each template of a corpus. ``lines``: corpus, ord (orderable), line.

    ``min_by`` combines before the shuffle, so a template with most of the lines is no hot key.
    """
    rows = lines.where(F.trim("line") != "").withColumn("key", T.template_key(F.col("line")) if key is None else key)
    return rows.groupBy("corpus", "key").agg(F.min("ord").alias("ord"), F.min_by("line", "ord").alias("line"), F.count("*").alias("n"))


def without_trash(templates: DataFrame) -> DataFrame:
    return templates.where(~T.is_low_signal(F.col("line")))


def mode_of(path: Column, text: Column) -> Column:
    """``log``, ``code`` or ``prose``, by suffix; a .txt with many short lines is a log."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    short = (F.size(lines) >= 8) & (F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / F.size(lines) < 240)
    code = r"\.(?:py|rs|ts|tsx|js|go|java|c|cpp|h|json)$"
    return F.when(path.rlike(r"\.(?:log|jsonl)$"), "log").when(path.rlike(code), "code").when(path.rlike(r"\.txt$") & short, "log").otherwise("prose")


# What parts units of a text, and what joins them again.
SPLITTERS = {"log": ("\n", "\n"), "code": (r"\n\s*\n", "\n\n"), "prose": (r"(?<=[.?!])\s+(?=[A-Z(\[])", " ")}


def units(text: Column, mode: str) -> Column:
    return F.filter(F.split(text, SPLITTERS[mode][0], -1), lambda u: F.trim(u) != "")


def pack(sizes: Column, most: int) -> Column:
    """The chunk number of each unit, from 0, for units of the given sizes packed greedily.

    A unit over ``most`` is a chunk by itself. Packing begins anew with each chunk, so it is a
    loop in an Arrow function.
    """

    def each(lists: pa.Array) -> pa.Array:
        out = []
        for sizes in lists.to_pylist():
            room, q, numbers = 0, -1, []
            for n in sizes or ():
                if n > room:
                    q += 1
                    room = most if n <= most else 0
                room -= min(n, room)
                numbers.append(q)
            out.append(numbers)
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(each, "array<int>").asNondeterministic()(sizes)


def chunked(docs: DataFrame, most: int = 512, mode: str = "log", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_id, text, n_tokens): units packed to at most ``most`` word tokens; an
    oversized unit is cut to pieces of ``most`` tokens, which follow in its place."""
    rows = docs.select(F.col(id_col).alias("doc_id"), units(F.col(text_col), mode).alias("u"))
    rows = rows.select("doc_id", "u", F.transform("u", lambda x: F.size(T.word_tokens(x))).alias("n"))

    def each(lists: pa.Array, sizes: pa.Array, numbers: pa.Array) -> pa.Array:
        (row, unit), n, q = S.items(lists), *(S.items(x)[1].to_numpy(zero_copy_only=False).astype(np.int64) for x in (sizes, numbers))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (q[1:] != q[:-1])
        at, chunk = np.flatnonzero(new), np.cumsum(new) - 1
        texts = pc.binary_join(S.as_lists(chunk, unit, len(at)), SPLITTERS[mode][1])
        most_ = np.maximum.reduceat(n, at) if len(at) else n
        return S.as_lists(row[at], pa.StructArray.from_arrays([texts, pa.array(most_, pa.int32())], names=["text", "n"]), len(lists))

    # units are put together in their text's row, so that nothing is shuffled
    joined = F.arrow_udf(each, "array<struct<text:string,n:int>>").asNondeterministic()("u", "n", "q")
    rows = rows.select("doc_id", "u", "n", pack(F.col("n"), most).alias("q")).select("doc_id", joined.alias("c"))
    # bound, so that a long unit is cut to tokens once and not for each of its pieces
    cuts = lambda c: T.bound(T.word_tokens(c.text), lambda toks: F.transform(F.sequence(F.lit(0), c.n - 1, F.lit(most)), lambda i: F.array_join(F.slice(toks, i + 1, F.lit(most)), "")))
    pieces = F.flatten(F.transform("c", lambda c: F.when(c.n <= most, F.array(c.text)).otherwise(cuts(c))))
    parts = rows.select("doc_id", F.posexplode(pieces).alias("chunk_id", "text"))
    return parts.select("doc_id", "chunk_id", "text", T.token_count(F.col("text")).alias("n_tokens"))


def water_fill(pools: dict[str, int], target: int, max_share: float = 0.25) -> dict[str, int]:
    """Fair shares of ``target`` slots: equal, no more than a pool has or ``max_share`` allows.

    Shares fill to one level, as water in basins of different depths: the greatest whole level
    whose sum is within the target, found among the sorted depths. What is left over goes
    singly to the basins with most depth above it, then by name. There are a handful of
    corpora, so this runs on the driver over their counts.
    """
    if target <= 0 or not pools:
        return dict.fromkeys(pools, 0)
    most = max(1, int(max_share * target))
    depth = {k: min(n, most) for k, n in pools.items()}
    goal = min(target, sum(depth.values()))
    depths = np.sort(np.fromiter(depth.values(), np.int64, len(depth)))
    full = np.concatenate([[0], np.cumsum(depths)[:-1]])  # what the basins less deep hold
    levels = (goal - full) // np.arange(len(depths), 0, -1)
    level = int(levels[np.argmax(levels < depths)]) if (levels < depths).any() else int(depths[-1])
    out = {k: min(d, level) for k, d in depth.items()}
    for k in sorted((k for k in depth if depth[k] > level), key=lambda k: (-depth[k], k))[: goal - sum(out.values())]:
        out[k] += 1
    return out


#: Parts that a corpus is ranked in before its first rows are ranked together.
SELECT_PARTS = 64
#: Templates in line order that are packed to chunks in one sequence; a run begins after each so many.
BLOCK = 10_000


def stable_select(rows: DataFrame, slots: dict[str, int], text: str = "text", corpus: str = "corpus", order: str = "ord") -> DataFrame:
    """As many rows of each corpus as it has slots: the first by SHA-1 of the text, then order."""
    if not slots:
        return rows.limit(0)
    # ranked in parts first, so that no task sorts a whole corpus: a part keeps its slots' worth
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in slots.items() for x in kv])[F.col(corpus)], F.lit(0))
    key = F.sha1(F.col(text).cast("binary"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(text, order), F.lit(SELECT_PARTS)))
    for by in ([corpus, "_part"], [corpus]):
        rows = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(key, order))).where(F.col("_rank") <= limit)
    return rows.drop("_rank", "_part")


def stable_subsample(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The ``k`` rows of least SHA-1 of their keys, joined by bars."""
    return rows.orderBy(F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in keys]).cast("binary")), *keys).limit(k)


def split_bucket(path: Column, chunk_id: Column, val_frac: float, seed: int = 0) -> Column:
    """``train`` or ``val`` by a hash of seed, path and chunk."""
    if val_frac <= 0:
        return F.lit("train")
    key = F.concat(F.lit(f"{seed}:"), path, F.lit(":"), chunk_id.cast("string"))
    return F.when(T.hash_share(key) < val_frac, "val").otherwise("train")


def sample(lines: DataFrame, target: int, max_share: float = 0.25, most: int = 512) -> tuple[DataFrame, DataFrame]:
    """(chosen chunks, stats by corpus) of lines (corpus, ord, line): templates once, trash out,
    chunks packed, slots shared out, chunks chosen by hash.

    Packing is a sequence, so a chunk begins anew at each ``BLOCK``-th template of a corpus in
    line order: chunks hold neighbouring templates whatever the corpus' size.
    """
    templates = template_dedup(lines)
    good = without_trash(templates)
    # a line has one key, so the key isn't carried on
    placed = numbered(cut(good.select("corpus", "ord", "line")), [F.col("corpus"), F.col("ord"), F.col("line")], "_place")
    before = placed.groupBy("corpus").agg(F.min("_place").alias("_first"))  # a handful
    place = F.col("_place") - F.col("_first")
    good = placed.join(F.broadcast(before), "corpus").withColumn("_block", F.floor(place / BLOCK).cast("long"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x.line)
    texts = good.groupBy("corpus", "_block").agg(F.array_join(ordered, "\n").alias("text"))
    chunks = chunked(texts.select(F.struct("corpus", "_block").alias("id"), "text"), most, "log", id_col="id")
    pool = chunks.select(F.col("doc_id.corpus").alias("corpus"), (F.col("doc_id._block") * (1 << 32) + F.col("chunk_id")).alias("ord"), "text")
    pool = cut(pool)  # counted, then chosen from
    counts = {r.corpus: r["n"] for r in pool.groupBy("corpus").agg(F.count("*").alias("n")).collect()}
    slots = water_fill(counts, target, max_share)
    raw = lines.groupBy("corpus").agg(F.count("*").alias("raw_lines"))
    stats = raw.join(templates.groupBy("corpus").agg(F.count("*").alias("unique_templates"), F.count_if(T.is_low_signal(F.col("line"))).alias("dropped_trash")), "corpus", "left")
    both = lambda d: F.coalesce(F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("corpus")], F.lit(0)) if d else F.lit(0)
    return stable_select(pool, slots), stats.withColumn("chunk_pool", both(counts)).withColumn("selected", both(slots))
