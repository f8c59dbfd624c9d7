"""SimHash near-duplicates by a grid join on segment bit counts.

A fingerprint of 64 bits is cut into 32 segments of two bits. Its embedding is the vector
of the segments' bit counts, 0 to 2 each. One changed bit moves one coordinate by one, so
the Manhattan distance of two embeddings is at most the Hamming distance of the
fingerprints. Packed, two bits to a coordinate, the embedding is itself a long, which
serves as the cell of the grid. Two cells within Manhattan distance 2 are equal, or one is
a neighbour of the other, or they share a neighbour: each fingerprint is therefore dealt
to its own cell and to the neighbours one step up or down, at most 65 cells and 49 on
average, in place of the 2,081 cells within two steps. Whatever meets in a cell is
verified on the whole fingerprints inside the join, so candidates aren't written out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy, utf8, values
from .components import connected_components
from .shingles import WORDS, hashes, simhash, similar_groups

SHINGLE_WORDS = 3
MAX_BITS = 2
#: The low bit of each two-bit segment.
LOW_BITS = 0x5555555555555555
OWN, UP, DOWN = 0, 1, 2
#: About so many fingerprints are dealt to their cells by one task.
DEALT = 20_000


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """The SimHash of one UTF-8 text as a signed long; zero if it has no word.

    A-Z become lower case, words are joined by single spaces to shingles of ``size``
    words, repeats included, and a text of fewer words is one shingle.
    """
    return simhash(hashes(text, size))


def fingerprints(column: Column) -> Column:
    """The fingerprint of a binary column of UTF-8 texts."""

    def each(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x) for x in values(texts)], pa.int64())

    return F.arrow_udf(tidy(each), "bigint").asNondeterministic()(column)


def embedding(fp: Column) -> Column:
    """The 32 bit counts, two bits each, packed to a long (a half adder on each bit pair)."""
    high, low = F.shiftrightunsigned(fp, 1), F.lit(LOW_BITS)
    return fp.bitwiseXOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(prints: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """(cell, kind, fp): the own cell and those one step up or down in one coordinate."""
    prints = prints.select("fp", embedding(F.col("fp")).alias("v"))
    v = F.col("v")
    field = lambda i: F.shiftrightunsigned(v, 2 * i).bitwiseAND(F.lit(3))
    change = lambda i, plain: v.bitwiseXOR(F.when(field(i) == plain, F.lit(signed(1 << 2 * i))).otherwise(F.lit(signed(3 << 2 * i))))
    dealt = []
    if OWN in kinds:
        dealt.append(F.struct(v.alias("cell"), F.lit(OWN).alias("kind")))
    for i in range(32):
        if UP in kinds:  # 0 to 1, or 1 to 2
            dealt.append(F.when(field(i) < 2, F.struct(change(i, 0).alias("cell"), F.lit(UP).alias("kind"))))
        if DOWN in kinds:  # 1 to 0, or 2 to 1
            dealt.append(F.when(field(i) > 0, F.struct(change(i, 1).alias("cell"), F.lit(DOWN).alias("kind"))))
    return prints.select("fp", F.explode(F.array(*dealt)).alias("c")).where("c is not null").select("c.cell", "c.kind", "fp")


def links(prints: DataFrame, count: int | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct ``fp`` of ``prints`` that differ in 1 or 2 bits.

    Every pair within Manhattan distance 2 meets as own/own, up/own, up/down or up/up. A
    pair may come out twice (the two steps of an up/down pair can be taken in either order).
    """
    count = prints.count() if count is None else count
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // DEALT))
    prints = prints.select("fp").repartition(tasks, "fp")
    left = cells(prints, (OWN, UP)).select("cell", F.col("kind").alias("k"), F.col("fp").alias("x"))
    right = cells(prints, (OWN, UP, DOWN)).select("cell", F.col("kind").alias("l"), F.col("fp").alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= MAX_BITS
    # equal embeddings meet once, as own/own; in other cells only different ones do
    apart = embedding(F.col("x")) != embedding(F.col("y"))
    once = F.when(F.col("k") == OWN, (F.col("l") == OWN) & (F.col("x") < F.col("y"))).when(F.col("l") == UP, apart & (F.col("x") < F.col("y"))).otherwise(apart)
    met = left.hint("merge").join(right, (left.cell == right.cell) & near & once)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_documents(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: key, doc_id, component_id, kept, by word shingles.

    Linked are texts whose sets of shingles of ``words`` words have a Jaccard similarity of 0.8
    or more. Candidates are the pairs of fingerprints (of such shingles) that ``links`` finds;
    fingerprints of similar texts differ in up to 17 bits, which no grid can join, so pairs
    further apart come from shared shingles (see ``shingles``). All pass one exact check. Of each component the row of the least id stays, then of
    the least key, then one row. ``key`` tells rows of different texts apart. Null and empty
    texts link to each other; an empty table gives no rows.
    """
    rows = cut(similar_groups(docs, key, links, text_col, words, (id_col,)).withColumnRenamed(id_col, "doc_id"))
    least = rows.groupBy("root").agg(F.min(F.struct("doc_id", "key", "node")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = rows.join(least, "root", "left")
    return out.select("key", "doc_id", F.coalesce("least.doc_id", "doc_id").alias("component_id"), (F.col("least").isNull() | (F.col("least.node") == F.col("node"))).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, bits.

    component_id is the least id that links reach, itself included. Null and empty texts
    and texts of white space have fingerprint zero and link like any other. Copies share a
    fingerprint; the join works on distinct fingerprints, so a group of copies costs one
    row however large it is. Ids may be null, repeated or of any type that has an order;
    a null id is never a component_id unless its component has none but null ids. An empty
    table gives no rows.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprints(utf8(text_col)).alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(links(prints, prints.count())).select(F.col("node").alias("fp"), F.col("root"))
    grouped = cut(prints.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")))
    # only fingerprints with a link or with copies need a lookup; other rows stand for themselves
    tops = grouped.where("linked").groupBy("root").agg(F.min("least").alias("top"))
    linked = grouped.where("linked").join(tops, "root").select("fp", F.col("top").alias("component_id"))
    copied = grouped.where("n > 1 and not linked").select("fp", F.col("least").alias("component_id"))
    known = cut(linked.unionByName(copied))
    return rows.join(known, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.bit_count("fp").cast("int").alias("bits"),
    )
