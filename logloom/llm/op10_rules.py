"""Quality rules: base statistics of a text, and an isolation forest over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import value_at_rank
from .common import cut, tidy, utf8, values

WINDOW = 3
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: The forest: trees, and the rows that each draws of all.
TREES, ROWS = 128, 256
SEED = 11
BINS = 4_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Latin capitals, and all Latin letters without marks.
MORE = ("n_upper", "n_letters")
STATS = BASE + MORE


def statistics(text: str) -> tuple[int, ...]:
    """``STATS`` of one text.

    Words are runs without ASCII white space. word_chars: code points in words. n_symbols:
    characters among ``SYMBOLS``. n_dup_lines: lines (split at newlines) that have a word and
    equal an earlier line. n_repeat_words: words inside a 3-word window that the text holds
    twice or more, the first one included.
    """
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").split()]
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    repeated = 0
    if n > WINDOW:
        v = len(codes)
        if v < 2_000_000:  # the code of a window is exact below 2 ** 63
            keys = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:
            _, pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)
            keys = pairs[:-1] * v + ids[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        inside = np.zeros(n, bool)
        for i in range(WINDOW):
            inside[i : n - WINDOW + 1 + i] |= twice
        repeated = int(inside.sum())
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    lower = int(((letters >= 97) & (letters <= 122)).sum())
    return (n, word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, upper, upper + lower)


def with_statistics(text: Column) -> Column:
    """struct of ``STATS`` of binary UTF-8 texts."""

    def each(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics(x.decode("utf-8", "replace")) for x in values(texts)], np.int64).reshape(-1, len(STATS))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=list(STATS))

    return F.arrow_udf(tidy(each), "struct<" + ",".join(f"{s}:bigint" for s in STATS) + ">").asNondeterministic()(text)


def shares(stats: np.ndarray) -> np.ndarray:
    """A row a document: symbols a character and a word, characters a word, capitals a letter;
    then repeated words, repeated lines a word, and the logarithm of the number of words."""
    x = dict(zip(STATS, stats.T.astype(np.float64), strict=True))
    words, chars = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1)
    return np.stack([
        x["n_symbols"] / chars, x["n_symbols"] / words, x["word_chars"] / words, x["n_upper"] / np.maximum(x["n_letters"], 1),
        x["n_repeat_words"] / words, x["n_dup_lines"] / words, np.log(words),
    ], 1)


#: The columns of ``shares`` in which ordinary documents vary most, and the share of all
#: rows, at either end, that isn't ordinary.
VARIED, TAIL = slice(4, 7), 0.002


def ordinary(rows: DataFrame, n: int) -> np.ndarray:
    """The least and greatest ordinary value of the varied columns of the ``shares`` of all ``n`` rows."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    varied = rows.select((F.col("n_repeat_words") / words).alias("a"), (F.col("n_dup_lines") / words).alias("b"), words.alias("c"))
    beyond = int(TAIL * (n - 1))
    ends = np.array([[value_at_rank(varied, c, rank) for c in varied.columns] for rank in (1 + beyond, n - beyond)])
    ends[:, 2] = np.log(ends[:, 2])
    return ends


def features(stats: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """The forest's inputs: ``shares``, of whose varied columns only what is beyond ``usual`` counts.

    Else the forest isolates ordinary documents, which differ most in length and repetition.
    """
    x = shares(stats)
    x[:, VARIED] -= np.clip(x[:, VARIED], *usual)
    return x


class Forest:
    """Isolation forest. Trees are arrays of (feature, split, left child, path length)."""

    def __init__(self, x: np.ndarray | list[np.ndarray], trees: int = TREES, rows: int = ROWS, seed: int = SEED):
        """``x``: all rows, of which each tree draws some, or a list of the rows of each tree."""
        rng = np.random.default_rng(seed)
        if not isinstance(x, list):
            x = [x[rng.choice(len(x), min(rows, len(x)), replace=False)] for _ in range(trees)]
        rows = len(x[0])
        self.deepest = max(1, int(np.ceil(np.log2(max(2, rows)))))
        self.usual = average_path(rows)
        self.trees = [self._grow(own, rng) for own in x]

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes, waiting = [], [(np.arange(len(x)), 0, None)]
        while waiting:
            rows, depth, parent = waiting.pop(0)
            if parent is not None and nodes[parent][2] < 0:
                nodes[parent][2] = len(nodes)
            span = np.ptp(x[rows], axis=0)
            can = np.flatnonzero(span > 0)
            if depth >= self.deepest or len(rows) < 2 or not len(can):
                nodes.append([-1, 0.0, -1, depth + average_path(len(rows))])
                continue
            f = int(rng.choice(can))
            low = x[rows, f].min()
            at = low + span[f] * rng.random()
            goes = x[rows, f] <= at
            nodes.append([f, at, -1, 0.0])
            me = len(nodes) - 1
            waiting += [(rows[goes], depth + 1, me), (rows[~goes], depth + 1, me)]
        return tuple(np.array(c) for c in zip(*nodes, strict=True))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores, 0 to 1: 2 to the power of minus the mean path over the usual path."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, split, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.deepest):
                f = feature[at]
                down = left[at] + (x[every, np.maximum(f, 0)] > split[at])
                at = np.where(f < 0, at, down)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.usual)


def average_path(n: int) -> float:
    """The mean depth of a failed search in a random search tree of ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What the loss of a good document weighs, for that of a bad one caught.
COST = 5


def calibrate(scored: DataFrame, cost: float = COST) -> float:
    """The score from which the share of bad rows, less ``cost`` times that of good rows, is greatest.

    ``scored``: (score, quality) of all labelled rows; they are counted by score in bins.
    Of equal gains the highest score is taken. Above 1, so that nothing is anomalous, if
    either label has no row.
    """
    bin_ = F.floor(F.col("score") * BINS).cast("int").alias("bin")
    bins = scored.where("quality in (0, 1)").groupBy("quality", bin_).agg(F.count("*").alias("n")).collect()
    n = np.zeros((2, BINS + 2))
    for r in bins:
        n[r.quality, r.bin] = r["n"]
    if not n.sum(axis=1).all():
        return 2.0
    bad, good = (np.cumsum(x[::-1])[::-1] / x.sum() for x in n)  # shares of each bin or above
    gain = bad - cost * good
    return int(len(gain) - 1 - np.argmax(gain[::-1])) / BINS


def tree_hash(h: np.ndarray, tree: int) -> np.ndarray:
    """A hash, of 53 bits, of 64-bit hashes of rows and a tree (the finisher of SplitMix64)."""
    z = h.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.int64)


def drawn(rows: DataFrame, n: int, trees: int = TREES, size: int = ROWS) -> list[np.ndarray]:
    """For each tree its own ``size`` of all ``n`` rows (h, ``STATS``), those of least hash of h and tree.

    Only rows whose hash is under a bound come to the driver; it rises until every tree has
    its rows. Rows that are the same come as one with their number.
    """

    def under(limit: int) -> Column:
        def each(hashes: pa.Array) -> pa.Array:
            h = hashes.to_numpy(zero_copy_only=False)
            us = [tree_hash(h, t) for t in range(trees)]
            at = [np.flatnonzero(u < limit) for u in us]
            row = np.concatenate(at)
            order = np.argsort(row, kind="stable")
            tree = np.repeat(np.arange(trees, dtype=np.int32), [len(i) for i in at])
            hashed = np.concatenate([u[i] for u, i in zip(us, at, strict=True)])
            ends = np.cumsum(np.bincount(row, minlength=len(h)))
            items = pa.StructArray.from_arrays([pa.array(tree[order]), pa.array(hashed[order])], names=["t", "u"])
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), items)

        return F.arrow_udf(tidy(each), "array<struct<t:int,u:bigint>>").asNondeterministic()("h")

    size, share = min(size, n), min(1.0, 1.5 * size / n)
    while True:
        near = rows.select(*STATS, F.explode(under(int(share * (1 << 53)))).alias("e"))
        own: list[list[tuple[int, ...]]] = [[] for _ in range(trees)]
        for t, u, *stats, copies in sorted(near.groupBy("e.t", "e.u", *STATS).agg(F.count("*").alias("copies")).collect()):
            own[t] += [tuple(stats)] * min(copies, size - len(own[t]))
        if share == 1.0 or all(len(x) == size for x in own):
            return [np.array(x, np.int64) for x in own]
        share = min(1.0, 4 * share)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base statistics, base_failed, score, kept.

    base_failed: under ``MIN_WORDS`` words, or more than half of the words in repeated
    windows. Others are kept unless the forest's score reaches the threshold. Each tree
    of the forest draws its ``ROWS`` of all rows that pass the base rules, by a hash of id and
    statistics; what is ordinary is counted over all of them, and the threshold comes from all
    labelled ones, good and bad. Null
    and empty texts have no words and fail. Repeated rows have the same verdict; a label counts
    for each row of its id. No rows: no rows. Without a row to fit on, or without labels of both kinds, the base rules decide alone.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), with_statistics(utf8(text_col)).alias("s")).select("doc_id", "s.*")
    rows = cut(rows.withColumn("base_failed", base_failed()))
    good = rows.where("not base_failed")
    n = good.count()
    if not n:
        return rows.select("doc_id", *BASE, "base_failed", F.lit(0.0).alias("score"), (~F.col("base_failed")).alias("kept"))
    usual = ordinary(good, n)
    forest = Forest([features(x, usual) for x in drawn(good.select(F.xxhash64("doc_id", *STATS).alias("h"), *STATS), n)], seed=seed)

    def each(*columns: pa.Array) -> pa.Array:
        return pa.array(forest.scores(features(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1), usual)), pa.float64())

    scored = cut(rows.withColumn("score", F.arrow_udf(tidy(each), "double").asNondeterministic()(*STATS)))
    known = labels.select(F.col(id_col).alias("id"), F.col(quality_col).alias("quality")).where("id is not null").groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("z")).where("quality = z")
    limit = calibrate(scored.where("not base_failed").join(known, F.col("doc_id") == F.col("id")).select("score", "quality"))
    return scored.select("doc_id", *BASE, "base_failed", "score", (~F.col("base_failed") & (F.col("score") < limit)).alias("kept"))
