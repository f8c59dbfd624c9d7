"""Tokens, locks, and dropping the least valuable spans to a target rate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import spans as S
from ..functions import text as T


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), values: Column | None = None, parts: Column | None = None) -> DataFrame:
    """(doc_id, i, token, s, e, *keep): tokens that tile the text, with byte spans, a row a token.

    ``keep`` should be small, as each token carries it; ``values`` has an element a token and
    gives the column ``value``; ``parts`` (as ``spans.parts_of`` makes them) gives ``locked``.
    All is computed in the text's row, before it becomes a row a token: nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, T.word_tokens(F.col(text_col)).alias("t"), *([] if values is None else [values.alias("v")]), (F.lit(None).cast(S.PARTS) if parts is None else parts).alias("_parts"))
    zipped = ["t", placed(F.col("t"), F.col("_parts")).alias("x"), *([] if values is None else ["v"])]
    rows = rows.select("doc_id", *keep, F.posexplode(F.arrays_zip(*zipped)).alias("i", "z"))
    return rows.select("doc_id", *keep, "i", F.col("z.t").alias("token"), *([] if values is None else [F.col("z.v").alias("value")]), "z.x.s", "z.x.e", *([] if parts is None else ["z.x.locked"]))


def quoted(keyword: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in keyword)


def keyword_spans(docs: DataFrame, keywords: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, s, e): byte ranges of all keywords, found in the text itself."""
    return S.match_rows(docs, [quoted(k) for k in keywords if k], id_col, text_col)


def array_spans(docs: DataFrame, spans: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, s, e) of an array of spans a row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(spans).alias("x")).select("doc_id", "x.s", "x.e")


def keyword_parts(text: Column, keywords: list[str]) -> Column:
    """The parts of all keywords, found in the text itself."""
    return S.parts_of(text, [quoted(k) for k in keywords if k])


def locked(docs: DataFrame, spans: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), values: Column | None = None) -> DataFrame:
    """Tokens of ``docs`` with ``locked``: whether a token shares a byte with one of ``spans``,
    a table (doc_id, s, e) or each text's own parts."""
    if isinstance(spans, Column):
        return tokens(docs, id_col, text_col, keep, values, spans)
    return S.mark_overlaps(tokens(docs, id_col, text_col, keep, values), spans, "locked")


def project(spans: Column, token_spans: Column) -> Column:
    """Per token of another tokenizer, whether it shares a byte with a locked span."""
    return S.overlaps(spans, token_spans)


# --- texts as rows of arrays: an Arrow batch at a time, nothing shuffled ---------------------


@dataclass
class Tokens:
    """The tokens of an Arrow batch of texts, side by side."""

    n: int  # texts
    values: pa.Array
    row: np.ndarray  # the text of each token
    i: np.ndarray  # its place there
    s: np.ndarray
    e: np.ndarray

    @classmethod
    def of(cls, lists: pa.Array) -> Tokens:
        lists = pa.concat_arrays([lists]) if lists.offset else lists
        sizes = np.diff(lists.offsets.to_numpy())
        values = lists.flatten()
        row, first = np.repeat(np.arange(len(lists)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(wide)])
        return cls(len(lists), values, row, np.arange(len(row)) - first, upto[:-1] - upto[first], upto[1:] - upto[first])

    def locked(self, parts: pa.Array | None) -> np.ndarray:
        return np.zeros(len(self.row), bool) if parts is None else S.hits(S.spans_of(parts), self.row, self.s, self.e)

    def groups(self, by: str) -> np.ndarray:
        """The number of each token's span, of the batch: rising by one."""
        if not len(self.row):
            return self.row
        if by == "token":
            return np.arange(len(self.row))
        if by.startswith("chunk:"):
            return np.cumsum(self.i % max(1, int(by[6:])) == 0) - 1
        raw = self.values.cast(pa.large_binary())
        edges = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        space = _SPACE[np.frombuffer(raw.buffers()[2], np.uint8)]
        starts = (self.i == 0) | space[edges[:-1]]
        starts[1:] |= space[edges[1:-1] - 1]
        return np.cumsum(starts) - 1

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Each text of its kept tokens alone."""
        return pc.binary_join(S.as_lists(self.row[keep], self.values.filter(pa.array(keep)), self.n), "")


_SPACE = np.isin(np.arange(256), [32, 9, 13, 10])
_REDUCE = {"max": lambda x, at, n: np.maximum.reduceat(x, at), "min": lambda x, at, n: np.minimum.reduceat(x, at), "mean": lambda x, at, n: np.add.reduceat(x, at) / n}


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x) + (x - np.floor(x) >= 0.5)


def fitting(row: np.ndarray, size: np.ndarray, left: np.ndarray, one: bool = False) -> np.ndarray:
    """Of each row's items in order, those taken: every one that still fits in what is ``left``, and
    with ``one`` the first in any case.

    A choice hangs on those before it in its row, so a step takes an item of every row.
    """
    count = np.bincount(row, minlength=len(left))
    first = np.cumsum(count) - count
    if not one and (size == 1).all():
        return np.arange(len(row)) - first[row] < left[row]
    taken, left, rows = np.zeros(len(row), bool), left.copy(), np.arange(len(left))
    for k in range(int(count.max(initial=0))):
        rows = rows[(count[rows] > k) & ((left[rows] > 0) | (one and k == 0))]
        if not len(rows):
            break
        at = first[rows] + k
        fits = (size[at] <= left[rows]) | (one and k == 0)
        taken[at] = fits
        left[rows] -= size[at] * fits
    return taken


def dropped(toks: Tokens, prob: np.ndarray, locked: np.ndarray, rate: np.ndarray, by: str = "word", reduce: str = "max", half_even: bool = False, of_unlocked: bool = False) -> np.ndarray:
    """Whether each token goes: spans without a locked token, by falling score, then place, as long
    as they fit in ``rate`` of the text's tokens (or of its unlocked ones)."""
    if not len(toks.row):
        return np.zeros(0, bool)
    g = toks.groups(by)
    at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(at, len(g)))
    score, held, row = _REDUCE[reduce](prob, at, size), np.logical_or.reduceat(locked, at), toks.row[at]
    total = np.bincount(toks.row[~locked] if of_unlocked else toks.row, minlength=toks.n)
    share = np.clip(rate, 0.0, 1.0) * total
    most = (np.rint(share) if half_even else _half_up(share)).astype(np.int64)
    free = np.flatnonzero(~held)
    free = free[np.lexsort((-score[free], row[free]))]  # stable: ties stay in their places
    gone = np.zeros(len(at), bool)
    gone[free] = fitting(row[free], size[free], most)
    return gone[g]


def placed(tokens_: Column, parts: Column) -> Column:
    """array<struct<s, e, locked>>: the bytes of tokens that tile their text, and whether one of the
    spans of ``parts`` shares a byte with them."""

    def each(lists: pa.Array, parts: pa.Array) -> pa.Array:
        toks = Tokens.of(lists)
        cells = pa.StructArray.from_arrays([pa.array(toks.s, pa.int32()), pa.array(toks.e, pa.int32()), pa.array(toks.locked(parts), pa.bool_())], names=["s", "e", "locked"])
        return S.as_lists(toks.row, cells, toks.n)

    return F.arrow_udf(each, "array<struct<s:int,e:int,locked:boolean>>").asNondeterministic()(tokens_, F.coalesce(parts, F.array().cast(S.PARTS)))


def group_numbers(tokens_: Column, by: str = "word") -> Column:
    """array<int>: the number of each token's span in its text."""

    def each(lists: pa.Array) -> pa.Array:
        toks = Tokens.of(lists)
        g = toks.groups(by)
        return S.as_lists(toks.row, pa.array(g - g[np.arange(len(g)) - toks.i], pa.int32()), toks.n)

    return F.arrow_udf(each, "array<int>").asNondeterministic()(tokens_)


def group_sizes(tokens_: Column, by: str = "word") -> Column:
    """array<bigint>: the number of tokens of each span of a text."""

    def each(lists: pa.Array) -> pa.Array:
        toks = Tokens.of(lists)
        g = toks.groups(by)
        first = np.flatnonzero(np.diff(g, prepend=-1))
        return S.as_lists(toks.row[first], pa.array(np.bincount(g), pa.int64()), toks.n)

    return F.arrow_udf(each, "array<bigint>").asNondeterministic()(tokens_)


def drop_flags(tokens_: Column, prob: Column, parts: Column, rate: float) -> Column:
    """array<boolean>: the round(rate * unlocked) unlocked tokens of highest prob, first first."""

    def each(lists: pa.Array, probs: pa.Array, parts: pa.Array) -> pa.Array:
        toks = Tokens.of(lists)
        gone = dropped(toks, probs.flatten().to_numpy(zero_copy_only=False), toks.locked(parts), np.full(toks.n, rate), "token", of_unlocked=True)
        return S.as_lists(toks.row, pa.array(gone, pa.bool_()), toks.n)

    return F.arrow_udf(each, "array<boolean>").asNondeterministic()(tokens_, prob, F.coalesce(parts, F.array().cast(S.PARTS)))


SHORTER = "struct<compressed:string,n_in:bigint,n_out:bigint>"


def shorter(toks: Tokens, gone: np.ndarray) -> pa.Array:
    count = lambda row: pa.array(np.bincount(row, minlength=toks.n), pa.int64())
    return pa.StructArray.from_arrays([toks.joined(~gone), count(toks.row), count(toks.row[~gone])], names=["compressed", "n_in", "n_out"])


def span_decoded(tokens_: Column, prob: Column, parts: Column, rate: float, by: str = "word", reduce: str = "max") -> Column:
    """struct<compressed, n_in, n_out>: what ``span_decode`` and ``rebuilt`` make of a text's tokens, in its row."""

    def each(lists: pa.Array, probs: pa.Array, parts: pa.Array) -> pa.Array:
        toks = Tokens.of(lists)
        return shorter(toks, dropped(toks, probs.flatten().to_numpy(zero_copy_only=False), toks.locked(parts), np.full(toks.n, rate), by, reduce))

    return F.arrow_udf(each, SHORTER).asNondeterministic()(tokens_, prob, F.coalesce(parts, F.array().cast(S.PARTS)))


# --- the same by rows ----------------------------------------------------------------------


def groups(rows: DataFrame, by: str = "word") -> DataFrame:
    """Adds g, the number of the token's span: ``word``, ``token`` or ``chunk:N``.

    A word begins at the first token, at white space, and after a token that ends in it.
    """
    if by == "token":
        return rows.withColumn("g", F.col("i"))
    if by.startswith("chunk:"):
        return rows.withColumn("g", F.expr(f"i div {max(1, int(by[6:]))}").cast("int"))
    w = W.partitionBy("doc_id").orderBy("i")
    ends = F.lag(F.col("token").rlike(r"[ \t\r\n]\z")).over(w)  # $ also stands before a last U+2028
    starts = (F.col("i") == 0) | F.col("token").rlike(r"^[ \t\r\n]") | F.coalesce(ends, F.lit(True))
    return rows.withColumn("_starts", starts.cast("int")).withColumn("g", (F.sum("_starts").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int")).drop("_starts")


REDUCERS = {"max": F.max, "mean": F.avg, "min": F.min}


def budget(rate: float | Column, n: Column, half_even: bool = False) -> Column:
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(rate))) * n
    return (F.rint(share) if half_even else F.round(share)).cast("int")


def greedy(spans: Column, k: Column) -> Column:
    """The g of the spans dropped: by falling score, then g, each whole span that still fits.

    ``spans``: array<struct<neg, g, n>>. Each choice hangs on all before it, so it is a loop in
    an Arrow function; a fold would copy what it has at each step.
    """

    def each(lists: pa.Array, budgets: pa.Array) -> pa.Array:
        out = []
        for spans, left in zip(lists.to_pylist(), budgets.to_pylist(), strict=True):
            gone = []
            for x in spans or ():
                if x["n"] <= left:
                    left -= x["n"]
                    gone.append(x["g"])
            out.append(gone)
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(each, "array<int>")(F.array_sort(spans), k)


def span_decode(scored: DataFrame, rate: float | str, by: str = "word", reduce: str = "max") -> DataFrame:
    """Adds dropped to tokens (doc_id, i, token, prob, locked).

    k = round(rate * tokens); a rate a document is named as a column of the tokens. Spans with a locked token stay. The fold sees a document's
    spans, never its tokens.
    """
    rows = groups(scored, by)
    per = rows.groupBy("doc_id", "g").agg(REDUCERS[reduce]("prob").alias("score"), F.count("*").cast("int").alias("n"), F.bool_or("locked").alias("held"))
    if isinstance(rate, str):
        per = per.join(rows.groupBy("doc_id").agg(F.max(rate).alias("_k")), "doc_id")
    else:
        per = per.withColumn("_k", F.lit(float(rate)))
    folded = per.groupBy("doc_id").agg(F.max("_k").alias("_k"), F.sum("n").cast("int").alias("total"), F.collect_list(F.when(~F.col("held"), F.struct((-F.col("score")).alias("neg"), "g", "n"))).alias("spans"))
    gone = folded.select("doc_id", F.explode(greedy(F.col("spans"), budget(F.col("_k"), F.col("total")))).alias("g"), F.lit(True).alias("dropped"))
    return rows.join(gone, ["doc_id", "g"], "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))


def top_k_drop(scored: DataFrame, rate: float) -> DataFrame:
    """Adds dropped: the round(rate * unlocked) unlocked tokens of highest prob, first first."""
    w = W.partitionBy("doc_id")
    k = budget(rate, F.count_if(~F.col("locked")).over(w))
    rank = F.row_number().over(W.partitionBy("doc_id", "locked").orderBy(F.col("prob").desc(), "i"))
    return scored.withColumn("dropped", ~F.col("locked") & (rank <= k))


def rebuilt(decoded: DataFrame) -> DataFrame:
    """(doc_id, compressed, n_in, n_out): the tokens that stay, in order."""
    left = F.transform(F.array_sort(F.collect_list(F.when(~F.col("dropped"), F.struct("i", "token")))), lambda x: x.token)
    return decoded.groupBy("doc_id").agg(F.array_join(left, "").alias("compressed"), F.count("*").alias("n_in"), F.count_if(~F.col("dropped")).alias("n_out"))
