"""Byte spans of pattern matches and intervals over them.

Patterns are Spark's; running sums over a row's matches are numpy's, an Arrow batch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SPAN = "array<struct<s:int,e:int>>"
PARTS = "array<struct<k:int,g:int,n:int>>"


def gaps(text: Column, pattern: str, kind: int = 0) -> Column:
    """array<struct<k, g, n>> of a pattern's matches: the bytes before each since the last one, and its own.

    A text without a match isn't split.
    """
    part = lambda g, h: F.struct(F.lit(kind).alias("k"), F.octet_length(g).alias("g"), F.octet_length(h).alias("n"))
    between = lambda hits: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, part)
    found = F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda hits: F.when(F.size(hits) > 0, between(hits)).otherwise(F.array().cast(PARTS)))
    return F.get(found, F.lit(0))


def parts_of(text: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """The parts of all patterns, a kind each."""
    return F.concat(*[gaps(text, p, k) for k, p in enumerate(patterns)]) if patterns else F.array().cast(PARTS)


def spans_of(parts: pa.Array, merged: bool = False) -> pa.Array:
    """Running sums of all rows' parts at once; a kind starts at 0, and so does a row."""
    parts = pa.concat_arrays([parts]) if parts.offset else parts
    sizes = np.diff(parts.offsets.to_numpy())
    row = np.repeat(np.arange(len(parts)), sizes)
    k, g, n = (parts.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "g", "n"))
    total = np.cumsum(g + n)
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (k[1:] != k[:-1])
    base = (total - g - n)[np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))] if len(row) else total
    e = total - base
    s = e - n
    full = n > 0
    row, s, e = row[full], s[full], e[full]
    if merged and len(row):
        order = np.lexsort((e, s, row))
        row, s, e = row[order], s[order], e[order]
        wide = int(e.max()) + 1
        reach = np.maximum.accumulate(row * wide + e)
        new = np.ones(len(row), bool)
        new[1:] = row[1:] * wide + s[1:] > reach[:-1]
        at = np.flatnonzero(new)
        row, s, e = row[at], s[at], np.maximum.reduceat(e, at)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(parts)))])
    pairs = pa.StructArray.from_arrays([pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["s", "e"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def tile(parts: Column) -> Column:
    """Spans of parts struct<k, g, n>, in order: a gap of g bytes, then n bytes; empty ones left out.

    Sums run over an Arrow batch: a fold over an array copies what it has at each step.
    """

    def each(x: pa.Array) -> pa.Array:
        return spans_of(x)

    return F.arrow_udf(each, SPAN).asNondeterministic()(F.coalesce(parts, F.array().cast(PARTS)))


def merged_spans(parts: Column) -> Column:
    """The union of the spans of parts, whose kinds each tile the text: those that overlap or touch made one."""

    def each(x: pa.Array) -> pa.Array:
        return spans_of(x, True)

    return F.arrow_udf(each, SPAN).asNondeterministic()(F.coalesce(parts, F.array().cast(PARTS)))


def match_spans(text: Column, pattern: str) -> Column:
    """Byte ranges (s, e) of all matches, in order."""
    return tile(gaps(text, pattern))


def token_spans(tokens: Column) -> Column:
    """Spans of tokens that tile their text."""
    return tile(F.transform(tokens, lambda t: F.struct(F.lit(0).alias("k"), F.lit(0).alias("g"), F.octet_length(t).alias("n"))))


def merge(spans: Column) -> Column:
    """The union of intervals: sorted, those that overlap or touch made one."""
    # each span is a kind of its own: a gap up to its start, then itself
    return merged_spans(F.transform(spans, lambda x, i: F.struct(i.alias("k"), x.s.alias("g"), (x.e - x.s).alias("n"))))


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, start and end of every span of a column of lists."""
    lists = pa.concat_arrays([lists]) if lists.offset else lists
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return row, *(lists.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s", "e"))


def items(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of every item of a column of lists, and the items."""
    lists = pa.concat_arrays([lists]) if lists.offset else lists
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def as_lists(row: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """A list for each of ``n`` rows; ``row`` is the row of each value, in rising order."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def hits(spans: pa.Array, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each token, from ``first`` to ``last`` in row ``at``, shares a byte with a span of its row."""
    row, s, e = flat(spans)
    wide = int(max(e.max(initial=0), last.max(initial=0))) + 1
    order = np.argsort(row * wide + s, kind="stable")
    starts, reach = (row * wide + s)[order], np.maximum.accumulate(np.concatenate([[-1], (row * wide + e)[order]]))
    return reach[np.searchsorted(starts, at * wide + last)] > at * wide + first


def overlaps(spans: Column, tokens: Column) -> Column:
    """array<boolean>: whether each of ``tokens``, spans too, shares a byte with one of ``spans``.

    One search in the sorted starts of an Arrow batch: of the spans that start before a token's
    end, does one end after its start?
    """

    def each(spans: pa.Array, tokens: pa.Array) -> pa.Array:
        at, first, last = flat(tokens)
        return as_lists(at, pa.array(hits(spans, at, first, last), pa.bool_()), len(tokens))

    full = lambda x: F.coalesce(x, F.array().cast(SPAN))
    return F.arrow_udf(each, "array<boolean>").asNondeterministic()(full(spans), full(tokens))


def touched(parts: Column, tokens: Column) -> Column:
    """``overlaps`` with the spans of ``parts``."""

    def each(parts: pa.Array, tokens: pa.Array) -> pa.Array:
        at, first, last = flat(tokens)
        return as_lists(at, pa.array(hits(spans_of(parts), at, first, last), pa.bool_()), len(tokens))

    return F.arrow_udf(each, "array<boolean>").asNondeterministic()(F.coalesce(parts, F.array().cast(PARTS)), F.coalesce(tokens, F.array().cast(SPAN)))


# --- the same by rows, where spans come as a table ------------------------------------------


def match_rows(docs: DataFrame, patterns: list[str] | tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, s, e): a row a match of any pattern; ends are running sums in a window."""
    text = F.col(text_col)

    if not patterns:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("s"), F.lit(0).alias("e")).limit(0)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts_of(text, patterns)).alias("pos", "x"))
    upto = W.partitionBy("doc_id", "x.k").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("doc_id", F.sum(F.col("x.g") + F.col("x.n")).over(upto).cast("int").alias("e"), F.col("x.n").alias("n"))
    return rows.where("n > 0").select("doc_id", (F.col("e") - F.col("n")).alias("s"), "e")


def merge_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, s, e): the union of each document's intervals, those that touch made one."""
    w = W.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    numbered = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "_g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_g")


def mark_overlaps(tokens: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Adds ``name`` to tokens (doc_id, s, e, ...): whether a token shares a byte with a row of
    ``rows`` (doc_id, s, e).

    One sweep a document: spans stand at their start, tokens at their end, and a token
    overlaps if a span that starts before the token's end ends after the token's start.
    """
    own = [c for c in tokens.columns if c != "doc_id"]
    left = tokens.select("doc_id", *own, F.col("e").alias("_at"), F.lit(0).alias("_kind"))
    right = rows.select("doc_id", *[F.col(c) if c in ("s", "e") else F.lit(None).cast(tokens.schema[c].dataType).alias(c) for c in own], F.col("s").alias("_at"), F.lit(1).alias("_kind"))
    w = W.partitionBy("doc_id").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("_kind") == 1, F.col("e"))).over(w)
    both = left.unionByName(right).withColumn(name, F.coalesce(reach > F.col("s"), F.lit(False)))
    return both.where("_kind = 0").drop("_at", "_kind")
