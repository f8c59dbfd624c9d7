"""Compression methods to compare, and whether answers survive them."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from ..session import cut
from . import facts
from .decode import Tokens, dropped, fitting


def lines_of(text: Column) -> Column:
    """The lines of a text, carriage returns before a newline left out."""
    return F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n", -1)


def runs_collapsed(text: Column, rate: Column | None = None, min_run: int = 3) -> Column:
    """The text with runs of a template reduced to their first and last line; the rate has no effect."""

    def each(lists: pa.Array, keys: pa.Array) -> pa.Array:
        (row, lines), key = S.items(lists), S.items(keys)[1].dictionary_encode().indices.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(row) else row
        size = np.diff(np.append(at, len(row)))
        n, rn = np.repeat(size, size), np.arange(len(row)) - np.repeat(at, size) + 1
        shown = (n < min_run) | (rn == 1) | (rn == n)
        note = ~shown & (rn == 2)
        notes = pc.binary_join_element_wise("... ", pa.array(n[note] - 2).cast(pa.string()), " lines elided ...", "")
        lines, stays = pc.replace_with_mask(lines, pa.array(note), notes.cast(lines.type)), shown | note
        return pc.binary_join(S.as_lists(row[stays], lines.filter(pa.array(stays)), len(lists)), "\n")

    lines = lines_of(text)
    return F.arrow_udf(each, "string").asNondeterministic()(lines, F.transform(lines, T.normalize_key))


def severest(text: Column, rate: Column) -> Column:
    """Lines by severity, then place, until the budget of tokens is spent; in order again.

    A line that doesn't fit is passed over once something is kept; spending stops when the
    budget is reached.
    """

    def each(lists: pa.Array, cells: pa.Array, budgets: pa.Array) -> pa.Array:
        (row, lines), cells = S.items(lists), S.items(cells)[1]
        rank, cost = (cells.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rank", "cost"))
        order, kept = np.lexsort((rank, row)), np.zeros(len(row), bool)
        kept[order] = fitting(row, cost[order], budgets.to_numpy(zero_copy_only=False).astype(np.int64), one=True)
        return pc.binary_join(S.as_lists(row[kept], lines.filter(pa.array(kept)), len(lists)), "\n")

    lines = lines_of(text)
    cells = F.transform(lines, lambda x: F.struct(T.severity_rank(x).alias("rank"), (T.token_count(x) + 1).alias("cost")))
    budget = F.greatest(F.lit(1), F.rint((F.lit(1.0) - rate) * T.token_count(text)).cast("int"))
    return F.arrow_udf(each, "string").asNondeterministic()(lines, cells, budget)


_CRC = np.array([functools.reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 if c & 1 else 0), range(8), n) for n in range(256)], np.int64)


def crc_probs(seeds: np.ndarray, toks: Tokens) -> np.ndarray:
    """A probability a token: from the CRC-32 of its text's seed, a colon and its place."""
    c = np.array([zlib.crc32(b"%d:" % x) for x in seeds.tolist()], np.int64)[toks.row] ^ 0xFFFFFFFF
    digits = len(str(int(toks.i.max(initial=0))))
    for k in reversed(range(digits)):
        has = (toks.i >= 10**k) | (k == 0)
        c = np.where(has, _CRC[(c ^ (48 + toks.i // 10**k % 10)) & 255] ^ (c >> 8), c)
    return 1.0 - (c ^ 0xFFFFFFFF) / float(1 << 32)


def random_dropped(text: Column, rate: Column, floor: bool = False, span: str | None = None, atoms: Column | None = None) -> Column:
    """The text less a share of its tokens, in the order of their CRC; ``floor`` keeps structural
    atoms, whose parts ``atoms`` may give."""

    def each(seeds: pa.Array, lists: pa.Array, rates: pa.Array, parts: pa.Array) -> pa.Array:
        toks = Tokens.of(lists)
        locked = toks.locked(parts if floor else None)
        gone = dropped(toks, crc_probs(seeds.to_numpy(zero_copy_only=False), toks), locked, rates.to_numpy(zero_copy_only=False), span or "token", half_even=span is None)
        return toks.joined(~gone)

    parts = S.parts_of(text, ()) if not floor else S.parts_of(text, facts.STRUCTURAL) if atoms is None else atoms
    return F.arrow_udf(each, "string").asNondeterministic()(F.crc32(text.cast("binary")), T.word_tokens(text), rate.cast("double"), parts)


#: name: (function of a text and a rate, both columns; whether the rate has an effect; whether it takes
#: ``atoms``). All work on a text in its row, so that nothing is shuffled.
TEXTS = {
    "deterministic": (runs_collapsed, False, False),
    "keep-severity": (severest, True, False),
    "random": (random_dropped, True, False),
    "random+floor": (functools.partial(random_dropped, floor=True), True, True),
    "random+span": (functools.partial(random_dropped, span="word"), True, False),
    "random+span+floor": (functools.partial(random_dropped, floor=True, span="word"), True, True),
}


def _made(docs: DataFrame, made: Column) -> DataFrame:
    return docs.where(F.length("text") > 0).select("doc_id", made.alias("compressed"))


def deterministic(docs: DataFrame, rate: float = 0.0, min_run: int = 3) -> DataFrame:
    """(doc_id, compressed): ``runs_collapsed`` of each text that isn't empty, as the others below."""
    return _made(docs, runs_collapsed(F.col("text"), None, min_run))


def keep_severity(docs: DataFrame, rate: float | Column) -> DataFrame:
    return _made(docs, severest(F.col("text"), F.lit(rate)))


def random_drop(docs: DataFrame, rate: float | Column, floor: bool = False, span: str | None = None) -> DataFrame:
    return _made(docs, random_dropped(F.col("text"), F.lit(rate), floor, span))


def _over(run: Callable[[Column, Column], Column]) -> Callable[[DataFrame, float | Column], DataFrame]:
    return lambda docs, rate: _made(docs, run(F.col("text"), F.lit(rate)))


#: name: (function of documents and rate, whether the rate has an effect)
METHODS = {name: (_over(run), tunable) for name, (run, tunable, _) in TEXTS.items()}
DEFAULT_METHODS = ("deterministic", "keep-severity", "random", "random+floor")


def _ratio(n: Column, left: Column) -> Column:
    return F.when(left == 0, F.lit(float("inf"))).otherwise(n / F.greatest(left, F.lit(1)))


def _drop(n: Column, left: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(1.0 - left / F.greatest(n, F.lit(1)))


def ratio(original: Column, compressed: Column) -> Column:
    """Tokens before over tokens after; infinite if nothing is left."""
    return _ratio(T.token_count(original), T.token_count(compressed))


def achieved_drop(original: Column, compressed: Column) -> Column:
    return _drop(T.token_count(original), T.token_count(compressed))


def survival_items(triples: DataFrame, rates=(0.2, 0.5, 0.8), methods=DEFAULT_METHODS, survives=T.survives) -> DataFrame:
    """(method, rate, triple_id, fact_type, source, survived, ratio, achieved_drop), one by each
    method and rate. ``triples``: triple_id, chunk, answer, fact_type, source; all methods work
    on a triple in its row."""
    text, made = F.col("chunk"), []
    for name in methods:
        run, tunable, floor = TEXTS[name]
        have = {"atoms": F.col("_atoms")} if floor else {}
        for rate in map(float, rates if tunable else (0.0,)):
            short = F.coalesce(F.when(F.length(text) > 0, run(text, F.lit(rate), **have)), text)
            made.append((f"_{len(made)}", F.struct(F.lit(name).alias("method"), F.lit(rate).alias("rate"), short.alias("short"))))
    if any(TEXTS[name][2] for name in methods):
        triples = triples.withColumn("_atoms", S.parts_of(text, facts.STRUCTURAL))  # once for all methods
    rows = triples.select("*", *[column.alias(c) for c, column in made])
    rows = rows.select("triple_id", "fact_type", "source", "answer", T.token_count(text).alias("_n"), F.explode(F.array(*[c for c, _ in made])).alias("m"))
    rows = rows.select("*", "m.*").withColumn("_left", T.token_count(F.col("short")))
    return rows.select("method", "rate", "triple_id", "fact_type", "source", survives(F.col("answer"), F.col("short")).alias("survived"), _ratio(F.col("_n"), F.col("_left")).alias("ratio"), _drop(F.col("_n"), F.col("_left")).alias("achieved_drop"))


def survival_rows(items: DataFrame, *by: str) -> DataFrame:
    """(method, rate, *by, survival, mean_ratio, mean_drop, n)."""
    return items.groupBy("method", "rate", *by).agg(F.avg(F.col("survived").cast("double")).alias("survival"), F.avg("ratio").alias("mean_ratio"), F.avg("achieved_drop").alias("mean_drop"), F.count("*").alias("n"))


def to_ratio(docs: DataFrame, method: str, target: float, steps: int = 14) -> DataFrame:
    """(doc_id, compressed, ratio, rate): each text at the rate, of those that bisection tries
    between 0 and 0.99, whose ratio is nearest to the target; the earliest of equal ones.

    All texts halve their intervals at once; a step is one plan over (doc_id, rate), and its
    small state is checkpointed. A method without a rate is run once.
    """
    run, tunable = METHODS[method]
    text = docs.select("doc_id", "text")

    def at(rates: DataFrame) -> DataFrame:
        made = run(text.join(rates.select("doc_id", "mid"), "doc_id"), F.col("mid"))
        both = text.join(made, "doc_id", "left").select("doc_id", F.coalesce("compressed", "text").alias("compressed"), "text")
        return both.select("doc_id", "compressed", ratio(F.col("text"), F.col("compressed")).alias("ratio"))

    state = text.select("doc_id", F.lit(0.0).alias("lo"), F.lit(0.99 if tunable else 0.0).alias("hi"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("best_ratio"), F.lit(None).cast("double").alias("rate"))
    for _ in range(steps if tunable else 1):
        state = state.withColumn("mid", (F.col("lo") + F.col("hi")) / 2)
        tried = state.join(at(state), "doc_id", "left")
        nearer = F.col("best_ratio").isNull() | (F.abs(F.col("ratio") - target) < F.abs(F.col("best_ratio") - target))
        under = F.col("ratio") < target
        state = cut(tried.select(
            "doc_id", F.when(under, F.col("mid")).otherwise(F.col("lo")).alias("lo"), F.when(under, F.col("hi")).otherwise(F.col("mid")).alias("hi"),
            F.when(nearer, F.col("compressed")).otherwise(F.col("best")).alias("best"), F.when(nearer, F.col("ratio")).otherwise(F.col("best_ratio")).alias("best_ratio"), F.when(nearer, F.col("mid")).otherwise(F.col("rate")).alias("rate"),
        ))
    return state.select("doc_id", F.col("best").alias("compressed"), F.col("best_ratio").alias("ratio"), "rate")


def verdicts(items: DataFrame, method_a: str, method_b: str) -> DataFrame:
    """(rate, survival_a, survival_b, b, c, p_exact, verdict): ``better``, ``worse`` or ``none`` at p < 0.05."""
    from .stats import mcnemar, paired

    pairs = paired(items, method_a, method_b)
    means = pairs.groupBy("rate").agg(F.avg(F.col("a").cast("double")).alias("survival_a"), F.avg(F.col("b").cast("double")).alias("survival_b"))
    tests = mcnemar(pairs, "rate", chi2_p=False)
    verdict = F.when(F.col("p_exact") >= 0.05, "none").when(F.col("a_better"), "better").otherwise("worse")
    return means.join(tests, "rate").select("rate", "survival_a", "survival_b", "b", "c", "p_exact", verdict.alias("verdict"))
