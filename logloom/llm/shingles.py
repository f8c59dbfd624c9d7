"""Near-duplicates by the Jaccard similarity of word shingles: by SimHash, then by a complete prefix join.

Pairs whose fingerprints the grid links are verified first. Similar texts whose fingerprints
lie further apart, which no grid joins, come from the prefix join, so that no link is lost.

Two sets of similarity 0.8 or more share a shingle among the first fifth (and one) of each,
in any order that is the same for all sets, so candidates are found through those alone.
The order puts shingles last that a sample holds often; it moves work, not results. Shingles
are compared by 64-bit hashes.

Of the sets that share a shingle, each is verified against the least one first. Only pairs
that these links don't join already are verified afterwards, so a group of near copies costs
a row or so a copy and shingle, and yet no pair that matters is left out. Before sets are
compared, their hashes are cut into segments, of whose counts the parity is kept: the distance
of two such vectors is a lower bound of the number of shingles that one set only has. Pairs
meet ``BITS`` segments first, then a number that grows with the set, so that what is left to
compare exactly is nearly only what is similar.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Tables, cut, tidy, utf8, values
from .components import connected_components

WORDS = 5
HASH_SEED = 42
#: The least similarity, as a fraction.
NUM, DEN = 4, 5
#: The share of texts that the order of shingles is learned from, and the frequent shingles it
#: knows at most. Both move work, not results.
SAMPLE, FREQUENT = 1 / 8, 1_000_000
#: Bits of a set's parities; of the finer ones, a power of two of at least so many a shingle.
BITS, FINER = 1_024, 4  # 16 longs, which fold to four
#: One shingle in so many is tried first among those that don't join by their least set.
PARTS = 8
#: So many keys of 8 bytes are broadcast at most.
BROADCAST_KEYS = 500_000


def hashes(text: bytes, size: int = WORDS) -> bytes:
    """The digests of one UTF-8 text's shingles, one after another, repeats included.

    A-Z become lower case, words are joined by single spaces to shingles of ``size`` words,
    and a text of fewer words is one shingle. A text without words has none.
    """
    words = text.lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        return digest(joined, HASH_SEED) if words else b""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return b"".join([digest(joined[i:j], HASH_SEED) for i, j in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)])


def distinct(digests: bytes) -> np.ndarray:
    """The sorted distinct hashes as signed longs; that of the empty shingle where there is none."""
    return np.unique(np.frombuffer(digests or xxhash.xxh64_digest(b"", HASH_SEED), ">i8").astype(np.int64))


def simhash(digests: bytes) -> int:
    """The fingerprint of a text's shingles as a signed long; zero without any."""
    if not digests:
        return 0
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 255 * 64):
        bits = np.unpackbits(rows[at : at + 255 * 64], axis=1)
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of one UTF-8 text's shingles; a text without words has the empty one."""
    return distinct(hashes(text, size))


def prefix(found: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of a set, those of its first shingles that a similar set must share one of, in order."""
    most = len(found) - (NUM * len(found) + DEN - 1) // DEN + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        often = frequent[at] == found
        if often.any():
            late = np.argsort(rank[at[often]], kind="stable")
            found = np.concatenate([found[~often], found[often][late]])
    return found[:most]


def parities(found: np.ndarray, bits: int = BITS) -> np.ndarray:
    """``bits`` bits as longs: whether an odd number of the hashes fall on each.

    Two sets' parities differ in at most as many bits as one set only has shingles.
    """
    odd = np.bincount(found & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def finer(column: Column, size: int = WORDS) -> Column:
    """The parities of a text's set, ``FINER`` bits a shingle or more."""

    def each(texts: pa.Array) -> pa.Array:
        sets = (shingles(x, size) for x in values(texts))
        return pa.array([parities(x, max(64, 1 << (FINER * len(x) - 1).bit_length())) for x in sets], pa.list_(pa.int64()))

    return F.arrow_udf(tidy(each), "array<bigint>").asNondeterministic()(column)


def differ(p: Column, q: Column) -> Column:
    """The bits in which parities differ; the longer ones are folded to the length of the others."""

    def folded(p: Column, q: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), (F.size(p) / F.size(q)).cast("int") - 1), lambda i: F.slice(p, i * F.size(q) + 1, F.size(q)))
        return F.when(F.size(p) <= F.size(q), p).otherwise(F.aggregate(parts, F.array_repeat(F.lit(0).cast("long"), F.size(q)), lambda a, x: F.zip_with(a, x, lambda u, v: u.bitwiseXOR(v))))

    bits = F.zip_with(folded(p, q), folded(q, p), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.aggregate(bits, F.lit(0), lambda n, b: n + b)


def shingle_sets(column: Column, size: int = WORDS) -> Column:
    def each(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(x, size) for x in values(texts)], pa.list_(pa.int64()))

    return F.arrow_udf(tidy(each), "array<bigint>").asNondeterministic()(column)


def sketches(column: Column, frequent: np.ndarray, rank: np.ndarray, size: int = WORDS) -> Column:
    """struct of n, the set's size, f, the text's fingerprint, p, its set's prefix, and s, its parities."""

    def each(texts: pa.Array) -> pa.Array:
        n, f, p, s = [], [], [], []
        for x in values(texts):
            digests = hashes(x, size)
            found = distinct(digests)
            n.append(len(found))
            f.append(simhash(digests))
            p.append(prefix(found, frequent, rank))
            s.append(parities(found))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (p, s)]
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(f, pa.int64()), *lists], names=["n", "f", "p", "s"])

    return F.arrow_udf(tidy(each), "struct<n:int,f:bigint,p:array<bigint>,s:array<bigint>>").asNondeterministic()(column)


def frequent_shingles(docs: DataFrame, text_col: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; how many of a sample's texts hold each) of shingles of two or more."""
    u = F.shiftrightunsigned(F.xxhash64(text_col), 11) / F.lit(float(1 << 53))
    some = docs.where(u < SAMPLE).select(F.explode(shingle_sets(utf8(text_col), size)).alias("h"))
    top = some.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = (top.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(h)
    return h[order], n[order]


def may(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of sizes ``n`` and ``m`` that first meet at places ``i`` and ``j`` of their order can be similar."""
    rest = F.least(n - i, m - j)
    return (NUM * F.greatest(n, m) <= DEN * F.least(n, m)) & ((NUM + DEN) * rest >= NUM * (n + m))


def similar(tables: Tables, docs: DataFrame, rows: DataFrame, pairs: DataFrame, key: str, text_col: str, size: int, repeated: bool = False) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes of ``rows`` whose texts' sets reach the similarity.

    The bound by parities leaves few pairs, so that few sets are made and shuffled. The result
    is one of ``tables``; what it takes on the way is gone at the end.
    """
    def within(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
        """Those of the pairs that the parities of ``sketch`` (k, n, s) let pass."""
        sketch = own.put(sketch)
        light = lambda k, x: sketch.select(F.col("k").alias(k), F.struct("n", "s").alias(x))
        both = pairs.join(light("b", "y"), "b").join(light("a", "x"), "a")
        return own.put(both.where((NUM + DEN) * differ(F.col("x.s"), F.col("y.s")) <= (DEN - NUM) * (F.col("x.n") + F.col("y.n"))).select("a", "b"))

    def named(pairs: DataFrame, *columns: str) -> DataFrame:
        ends = [pairs.select(F.col(c).alias("k")).distinct() for c in ("a", "b")]  # each combined before they meet
        return rows.select("k", *columns).join(ends[0].unionByName(ends[1]).distinct(), "k")

    def of_texts(names: DataFrame, value: Column, *columns: str) -> DataFrame:
        """(k, *columns, s): ``value`` of the nodes' texts; of rows of one key one is read."""
        names = cut(names)  # a key may be of a type that Parquet hasn't
        few = names.count() <= BROADCAST_KEYS
        texts = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(names) if few else names.hint("merge"), "key")
        return (texts.dropDuplicates(["k"]) if repeated else texts).select("k", *columns, value.alias("s"))

    with Tables(docs.sparkSession) as own:
        left = within(pairs, named(pairs, "n", "s"))
        left = within(left, of_texts(named(left, "n", "key"), finer(utf8("text"), size), "n"))
        sets = own.put(of_texts(named(left, "key"), shingle_sets(utf8("text"), size)))
        one, two = sets.select(F.col("k").alias("b"), F.col("s").alias("y")), sets.select(F.col("k").alias("a"), F.col("s").alias("x"))
        both = F.size(F.array_intersect("x", "y"))
        return tables.put(left.join(one, "b").join(two, "a").where(DEN * both >= NUM * (F.size("x") + F.size("y") - both)).select("a", "b"))


def by_fingerprints(rows: DataFrame, grid: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(a, b), a < b: pairs of nodes of ``rows`` (k, f) that fingerprints make candidates.

    Of each fingerprint the least node meets the others of it, and the least ones of the
    fingerprints that ``grid`` links.
    """
    prints = cut(rows.groupBy(F.col("f").alias("fp")).agg(F.min("k").alias("node"), F.count("*").alias("n")))
    of = lambda end: prints.select(F.col("fp").alias(end), F.col("node").alias(f"{end}k"))
    near = grid(prints, prints.count()).join(of("a"), "a").join(of("b"), "b").select(F.least("ak", "bk").alias("a"), F.greatest("ak", "bk").alias("b"))
    same = rows.join(prints.where("n > 1"), F.col("f") == F.col("fp")).where("k > node").select(F.col("node").alias("a"), F.col("k").alias("b"))
    return near.unionByName(same).distinct()


def similar_groups(docs: DataFrame, key: str, grid: Callable[[DataFrame, int], DataFrame], text_col: str = "text", size: int = WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, node, root), a row a row of ``docs``: root is the least node that links reach.

    ``grid`` gives the pairs (a, b) of distinct fingerprints that are near, of a table (fp) and
    its number of rows; what is near by it is verified, then what shares a shingle of a prefix.
    Rows whose sets of shingles have a Jaccard similarity of 0.8 or more are linked. Null
    counts as empty; texts without words link. ``key`` tells rows of different texts apart and
    may be of any type; rows of one key have one root. No rows: no rows.
    """
    frequent, rank = frequent_shingles(docs, text_col, size)
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(key).alias("key"), *own, F.monotonically_increasing_id().alias("k"), sketches(utf8(text_col), frequent, rank, size).alias("e"))
    rows = cut(rows.select("key", *[f"c{i}" for i in range(len(carry))], "k", "e.*"))  # nodes are numbered here, once
    # rows of one key are the same; one of them stands for all
    again = cut(rows.groupBy("key").agg(F.min("k").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"))
    every = rows.join(again, "key", "left").withColumn("least", F.coalesce("least", "k"))
    if repeated := not again.isEmpty():
        rows = cut(every.where("k = least").drop("least"))
    with Tables(docs.sparkSession) as tables:
        near = tables.put(by_fingerprints(rows.select("k", "f"), grid))
        links = similar(tables, docs, rows, near, key, text_col, size, repeated)
        # what fingerprints can't tell. One exchange, of three longs a row: n and pos share one
        entries = rows.select("k", "n", F.posexplode("p").alias("pos", "h")).select("h", "k", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("at"))
        by = W.partitionBy("h")
        met = entries.withColumn("x", F.min(F.struct("k", "at")).over(by)).withColumn("c", F.count("*").over(by)).where("c > 1")
        shared = tables.put(met.select("h", "k", "at", F.col("x.k").alias("xk"), F.col("x.at").alias("xat"), "c"))
        n_of, pos_of = lambda at: F.shiftright(at, 32), lambda at: at.bitwiseAND(0xFFFFFFFF)
        able = lambda a, b: may(n_of(F.col(a)), pos_of(F.col(a)), n_of(F.col(b)), pos_of(F.col(b)))
        first = tables.put(shared.where((F.col("xk") < F.col("k")) & able("xat", "at")).select(F.col("xk").alias("a"), F.col("k").alias("b")).distinct().join(near, ["a", "b"], "left_anti"))
        links = links.unionByName(similar(tables, docs, rows, first, key, text_col, size, repeated))
        roots = connected_components(links)
        # a shingle's other pairs, which have no part in its least set; parities, folded to four longs,
        # go with its sets, so that pairs meet their bound before they are written
        few = [F.get("s", F.lit(i)).bitwiseXOR(F.get("s", F.lit(i + 4))).bitwiseXOR(F.get("s", F.lit(i + 8))).bitwiseXOR(F.get("s", F.lit(i + 12))).alias(f"q{i}") for i in range(4)]
        parity = [f"q{i}" for i in range(4)]
        others = shared.where("c > 2 and k <> xk").select("h", "at", F.col("k").alias("node"))
        done = near.unionByName(first)
        # a part of the shingles joins most of a group, so that the others leave few pairs of it
        for part in (F.pmod("h", F.lit(PARTS)) == 0, F.pmod("h", F.lit(PARTS)) != 0):
            nodes = rows.select(F.col("k").alias("node"), *few).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), *parity)
            open_ = others.where(part).join(nodes, "node").withColumn("r", F.min("root").over(by)).withColumn("z", F.max("root").over(by))
            open_ = tables.put(open_.where("r < z").select("h", "node", "at", "root", *parity))
            x = open_.select("h", F.col("node").alias("a"), F.col("at").alias("ax"), F.col("root").alias("r"), *[F.col(c).alias(f"x{c}") for c in parity])
            y = open_.select(F.col("h").alias("g"), F.col("node").alias("b"), F.col("at").alias("by"), F.col("root").alias("z"), *[F.col(c).alias(f"y{c}") for c in parity])
            apart = sum((F.bit_count(F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))) for c in parity[1:]), F.bit_count(F.col("xq0").bitwiseXOR(F.col("yq0"))))
            bound = (NUM + DEN) * apart <= (DEN - NUM) * (n_of(F.col("ax")) + n_of(F.col("by")))
            rest = x.hint("merge").join(y, (F.col("h") == F.col("g")) & (F.col("a") < F.col("b")) & (F.col("r") != F.col("z")) & able("ax", "by") & bound)
            rest = tables.put(rest.select("a", "b").distinct().join(done, ["a", "b"], "left_anti"))
            if not rest.isEmpty():
                links = links.unionByName(similar(tables, docs, rows, rest, key, text_col, size, repeated))
                roots = connected_components(links)
                done = done.unionByName(rest)
    carried = [F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]
    found = every.select("key", *[f"c{i}" for i in range(len(carry))], F.col("k").alias("node"), "least").join(roots.select(F.col("node").alias("least"), "root"), "least", "left")
    return found.select("key", *carried, "node", F.coalesce("root", "least").alias("root"))
