"""Quality control of original/compressed pairs, and labels from them."""

from __future__ import annotations

import ast
import io
import json
import math
import tokenize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import align
from ..functions import spans as S
from ..functions import text as T
from ..session import cut
from . import facts
from .stats import value_at_rank


def qc_metrics(pairs: DataFrame, original: str = "original", compressed: str = "compressed") -> DataFrame:
    """Adds vr (novel words), mr (matched, with repeats), hr (found) and ag = hr - mr.

    Words are cut by Spark and counted in an Arrow function, a batch at a time: arrays have no hashed lookup, so
    counting in the row by built-ins takes the square of a text's length, and counting by
    rows of words shuffles about all the text.
    """

    def each(original: pa.Array, compressed: pa.Array) -> pa.Array:
        n, (ro, wo), (rc, wc) = len(original), S.items(original), S.items(compressed)
        words = pa.concat_arrays([wo, wc]).dictionary_encode()
        code, most = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(words.dictionary))
        (have, held), (kept, left) = (np.unique(k, return_counts=True) for k in (ro * most + code[: len(ro)], rc * most + code[len(ro) :]))
        at = np.searchsorted(have, kept)
        met = np.flatnonzero(np.append(have, -1)[at] == kept)
        total = lambda row, x: pa.array(np.bincount(row, x, minlength=n).astype(np.int64), pa.int64())
        row = kept[met] // most
        sums = [total(ro, np.ones(len(ro))), total(rc, np.ones(len(rc))), total(row, left[met]), total(row, np.minimum(left[met], held[at[met]]))]
        return pa.StructArray.from_arrays(sums, names=["o", "c", "hits", "matched"])

    count = F.arrow_udf(each, "struct<o:bigint,c:bigint,hits:bigint,matched:bigint>").asNondeterministic()
    rows = pairs.withColumn("_n", count(T.qc_tokens(F.col(original)), T.qc_tokens(F.col(compressed))))
    part = lambda a, n: F.when(n == 0, F.lit(0.0)).otherwise(a.cast("double") / F.greatest(n, F.lit(1)))
    n = F.col("_n")
    rows = rows.withColumn("vr", part(n.c - n.hits, n.c)).withColumn("mr", part(n.matched, n.o)).withColumn("hr", part(n.hits, n.o))
    return rows.withColumn("ag", F.col("hr") - F.col("mr")).drop("_n")


def nearest_rank(rows: DataFrame, column: str, drop_pct: float) -> float | None:
    """The value at the nearest rank that leaves out the top ``drop_pct``; None without rows."""
    n = rows.where(F.col(column).isNotNull()).count()
    keep = 1.0 - drop_pct / 100.0
    return value_at_rank(rows, column, max(1, min(n, math.ceil(keep * n)))) if n else None


def qc_filter(scored: DataFrame, vr_top: float = 5.0, ag_top: float = 10.0, floor: float = 0.5) -> DataFrame:
    """Pairs with vr at most ``floor``, then without the top ``vr_top`` % by vr, then, of those
    left, the top ``ag_top`` % by ag; ties with the cutoff stay.

    ``scored`` is written once, so it should carry no more columns than are wanted.
    """
    left = cut(scored).where(F.col("vr") <= floor)
    for column, top in (("vr", vr_top), ("ag", ag_top)):
        most = nearest_rank(left, column, top)
        left = left if most is None else left.where(F.col(column) <= most)
    return left


def histogram(rows: DataFrame, column: str, bins: int = 10, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(bin, n): fixed bins, values beyond an edge count in the bin there."""
    width = (hi - lo) / bins
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(column) - lo) / width)))
    return rows.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def best_output(outputs: DataFrame) -> DataFrame:
    """The best of each original's outputs (id, teacher, original, compressed): extractive ones
    first, then least vr, least ag, shortest, name. Blank outputs don't compete."""
    scored = qc_metrics(outputs.where(F.trim("compressed") != ""))
    order = F.struct((F.col("vr") > 0).alias("novel"), "vr", "ag", F.length("compressed").alias("n"), "teacher")
    return scored.groupBy("id").agg(F.min_by(F.struct("teacher", "compressed", "vr", "ag", "mr", "hr"), order).alias("b")).select("id", "b.*")


# --- byte alignment and labels ------------------------------------------------------------


def aligned_bytes(original: bytes, compressed: bytes, least: int = 3) -> list[tuple[int, int]]:
    """Byte runs of the original that the compressed text keeps, of ``least`` bytes at least."""
    a, b = (np.frombuffer(x, np.uint8) for x in (original, compressed))
    i, _, k = align.blocks(a, b, np.array([len(a)]), np.array([len(b)]), least)
    return list(zip(i.tolist(), (i + k).tolist(), strict=True))


_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
#: Bytes of originals that are aligned together.
ALIGNED = 400_000


def kept_tokens(original: bytes, compressed: bytes, spans: list[tuple[int, int]]) -> list[bool]:
    """Whether each token is kept: all its bytes are, or half of them with one that isn't space."""
    s, e = np.array(spans, np.int64).reshape(-1, 2).T
    a, b = (np.frombuffer(x, np.uint8) for x in (original, compressed))
    return _kept(a, b, np.array([len(a)]), np.array([len(b)]), s, e).tolist()


def _kept(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """``kept_tokens`` of pairs one after another; spans are in the bytes of all originals.

    Counts come from running sums of kept bytes, and of kept bytes that aren't space.
    """
    i, _, k = align.blocks(a, b, ends_a, ends_b)
    edges = np.zeros(len(a) + 1, np.int64)
    edges[i] += 1  # blocks of a pair don't overlap, and each has a start and an end of its own
    np.subtract.at(edges, i + k, 1)
    kept = np.cumsum(edges)[:-1] > 0
    solid = kept & ~_SPACE[a]
    upto, solid_upto = (np.concatenate([[0], np.cumsum(x)]) for x in (kept, solid))
    n, wide = upto[e] - upto[s], e - s
    return (wide > 0) & ((n == wide) | ((2 * n >= wide) & (solid_upto[e] > solid_upto[s])))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings one after another, and where each begins, with the last end; null is empty."""
    x = pc.fill_null(texts, "").cast(pa.large_binary())
    x = pa.concat_arrays([x]) if x.offset else x
    at = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
    data = np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def derive_mask(pairs: DataFrame) -> DataFrame:
    """Adds tokens, spans and keep to pairs. Alignment is of many pairs at once, in about n log n
    for texts whose words mostly differ; the worst of a single pair is its square, in bounded memory."""
    rows = pairs.withColumn("tokens", T.word_tokens(F.col("original"))).withColumn("spans", S.token_spans(F.col("tokens")))

    def each(original: pa.Array, compressed: pa.Array, spans: pa.Array) -> pa.Array:
        (a, at), (b, bt) = _bytes(original), _bytes(compressed)
        row, s, e = S.flat(spans)
        upto = np.searchsorted(row, np.arange(len(original) + 1))  # the first span of each row
        keep, n = np.zeros(len(row), bool), 0
        while n < len(original):
            m = max(n + 1, int(np.searchsorted(at, at[n] + ALIGNED, side="right")) - 1)
            own = slice(upto[n], upto[m])
            base = at[row[own]] - at[n]
            keep[own] = _kept(a[at[n] : at[m]], b[bt[n] : bt[m]], at[n + 1 : m + 1] - at[n], bt[n + 1 : m + 1] - bt[n], s[own] + base, e[own] + base)
            n = m
        return S.as_lists(row, pa.array(keep, pa.bool_()), len(original))

    return rows.withColumn("keep", F.arrow_udf(each, "array<boolean>").asNondeterministic()("original", "compressed", "spans"))


def salience_weights(text: Column, token_spans: Column, weight: float) -> Column:
    """``weight`` for tokens over structural atoms or quoted values of salient keys, else 1."""
    k = len(facts.STRUCTURAL)
    # of a salient key's match, the value alone counts: it ends a quote before the match does
    values = F.regexp_extract_all(text, F.lit(facts.SEMANTIC), F.lit(2))
    quoted = F.zip_with(S.gaps(text, facts.SEMANTIC), values, lambda x, v: F.array(
        F.struct(F.lit(k).alias("k"), x.g.alias("g"), (x.n - 1 - F.octet_length(v)).alias("n"), F.lit(False).alias("own")),
        F.struct(F.lit(k).alias("k"), F.lit(0).alias("g"), F.octet_length(v).alias("n"), F.lit(True).alias("own")),
        F.struct(F.lit(k).alias("k"), F.lit(0).alias("g"), F.lit(1).alias("n"), F.lit(False).alias("own")),
    ))
    # what isn't the value becomes a gap before it
    steps = F.transform(F.flatten(quoted), lambda x: F.struct(x.k.alias("k"), F.when(x.own, x.g).otherwise(x.g + x.n).alias("g"), F.when(x.own, x.n).otherwise(0).alias("n")))
    hit = S.touched(F.concat(S.parts_of(text, facts.STRUCTURAL), steps), token_spans)
    return F.transform(hit, lambda x: F.when(x, F.lit(float(weight))).otherwise(F.lit(1.0)))


def language_of(path: Column) -> Column:
    return F.when(path.rlike(r"\.py$"), "python").when(path.rlike(r"\.jsonl?$"), "json").otherwise("text")


# --- locks from syntax --------------------------------------------------------------------


def json_locks(text: str) -> list[tuple[int, int]]:
    """Byte ranges of a JSON text's punctuation, quotes, numbers and literals; none if invalid."""
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return []
    out, at, i, n = [], 0, 0, len(text)
    while i < n:
        c, j = text[i], i + 1
        if c == '"':
            while text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            body = len(text[i + 1 : j].encode("utf-8", "surrogatepass"))
            out += [(at, at + 1), (at + 1 + body, at + 2 + body)]
            at += body + 2
            i = j + 1
            continue
        if c not in " \t\r\n":
            if c not in "{}[],:":
                while j < n and text[j] not in "{}[],: \t\r\n":
                    j += 1
            out.append((at, at + j - i))
        at += j - i
        i = j
    return out


def python_locks(text: str) -> list[tuple[int, int]]:
    """The same for Python: operators, keywords, numbers and literals; names, strings and
    comments are free. None if it doesn't parse."""
    import keyword

    try:
        ast.parse(text)
        rows = text.splitlines(keepends=True)
        starts = [0]
        for r in rows:
            starts.append(starts[-1] + len(r.encode()))
        out = []
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type in (tokenize.OP, tokenize.NUMBER) or t.type == tokenize.NAME and keyword.iskeyword(t.string):
                (l0, c0), (l1, c1) = t.start, t.end
                out.append((starts[l0 - 1] + len(rows[l0 - 1][:c0].encode()), starts[l1 - 1] + len(rows[l1 - 1][:c1].encode())))
        return out
    except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError, IndexError):
        return []


LOCKERS = {"json": json_locks, "python": python_locks}
#: Names for plain text, which has no syntax to lock.
PLAIN = ("text", "plain", "plaintext", "log")


def syntax_spans(text: Column, language: str) -> Column:
    """Byte ranges that the language's syntax locks; an unknown language raises."""
    language = language.lower()
    if language in PLAIN:
        return F.array().cast(S.SPAN)
    if language not in LOCKERS:
        raise ValueError(f"unsupported_language: {language}")
    lock = LOCKERS[language]

    def each(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        return pa.array([[{"s": s, "e": e} for s, e in lock(x or "")] for x in texts.to_pylist()], kind)

    return F.arrow_udf(each, SPAN_DDL)(text)


SPAN_DDL = S.SPAN


# The syntax that code hangs on; weights fall with the distance to it.
SCAFFOLDS = {
    "python": ("FunctionDef", "AsyncFunctionDef", "ClassDef", "Import", "ImportFrom", "arg", "Call"),
    "json": ("object", "array", "pair"),
}
MAX_HOPS = 16


def python_tree(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, type, parent) in bytes, parents first; empty if it doesn't parse."""
    try:
        root = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    rows = text.encode("utf-8", "surrogatepass").split(b"\n")
    starts = [0]
    for r in rows:
        starts.append(starts[-1] + len(r) + 1)
    out = [(0, starts[-1] - 1, "Module", -1)]
    waiting = [(child, 0) for child in ast.iter_child_nodes(root)]
    while waiting:
        node, parent = waiting.pop()
        me = parent
        if getattr(node, "end_lineno", None) is not None:
            me = len(out)
            out.append((starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset, type(node).__name__, parent))
        waiting += [(child, me) for child in ast.iter_child_nodes(node)]
    return out


def json_tree(text: str) -> list[tuple[int, int, str, int]]:
    """The same for JSON: objects, arrays, pairs and scalars."""
    locks = json_locks(text)
    raw = text.encode("utf-8", "surrogatepass")
    if not locks:
        return []
    out: list[list] = []
    open_: list[int] = []
    i = 0

    def begin(at: int, kind: str) -> int:
        out.append([at, at, kind, open_[-1] if open_ else -1])
        return len(out) - 1

    def close(at: int) -> None:
        out[open_.pop()][1] = at

    while i < len(locks):
        s, e = locks[i]
        token = raw[s:e]
        if token in (b"{", b"["):
            open_.append(begin(s, "object" if token == b"{" else "array"))
        elif token in (b"}", b"]"):
            if out[open_[-1]][2] == "pair":
                close(s)
            close(e)
        elif token == b",":
            if out[open_[-1]][2] == "pair":
                close(s)
        elif token != b":":
            if token == b'"':  # two quotes make a string
                i += 1
                e = locks[i][1]
            if open_ and out[open_[-1]][2] == "object":
                open_.append(begin(s, "pair"))
            out[begin(s, "scalar")][1] = e
        i += 1
    return [tuple(x) for x in out]


def scaffold_hops(tree: list[tuple[int, int, str, int]], at: int, scaffolds: tuple[str, ...]) -> int:
    """Steps up from the smallest node over a byte to a scaffold; ``MAX_HOPS`` without one."""
    inside = [k for k, (s, e, _, _) in enumerate(tree) if s <= at < e]
    node = min(inside, key=lambda k: (tree[k][1] - tree[k][0], -k), default=-1)
    for hops in range(MAX_HOPS):
        if node < 0:
            break
        if tree[node][2] in scaffolds:
            return hops
        node = tree[node][3]
    return MAX_HOPS


KERNELS = {"exp": lambda h, a=0.5: math.exp(-a * max(0, h)), "linear": lambda h, m=6: max(0.0, 1.0 - h / m)}


def split_labels(rows: DataFrame, language: str, text: str = "original", spans: str = "spans", kernel: str = "exp") -> DataFrame:
    """Adds w_semantic, w_dependency and is_code: per token of ``spans``, the weight of syntax by
    its distance to a scaffold and the rest. Plain text, and code that doesn't parse, is all
    semantic; only what parses is code."""
    if language not in SCAFFOLDS:
        ones = F.transform(spans, lambda x: F.lit(1.0))
        return rows.select("*", ones.alias("w_semantic"), F.transform(spans, lambda x: F.lit(0.0)).alias("w_dependency"), F.lit(False).alias("is_code"))
    parse, scaffolds, weigh = {"python": python_tree, "json": json_tree}[language], SCAFFOLDS[language], KERNELS[kernel]

    def each(texts: pa.Array, token_spans: pa.Array) -> pa.Array:
        dep, code = [], []
        for t, own in zip(texts.to_pylist(), token_spans.to_pylist(), strict=True):
            tree = parse(t or "")
            code.append(bool(tree))
            dep.append([min(1.0, max(0.0, weigh(scaffold_hops(tree, x["s"] + (x["e"] - x["s"]) // 2, scaffolds)))) if tree else 0.0 for x in own or []])
        return pa.StructArray.from_arrays([pa.array(dep, pa.list_(pa.float64())), pa.array(code, pa.bool_())], names=["d", "code"])

    out = rows.withColumn("_l", F.arrow_udf(each, "struct<d:array<double>,code:boolean>").asNondeterministic()(text, spans))
    return out.withColumn("w_semantic", F.transform("_l.d", lambda d: 1.0 - d)).withColumn("w_dependency", F.col("_l.d")).withColumn("is_code", F.col("_l.code")).drop("_l")
