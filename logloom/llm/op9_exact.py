"""Exact dedup by chunk recipes, with DataFrame functions only.

A text is cut where its content says so, so equal passages give equal chunks wherever
they stand. A chunk is named by its digest; contents of digests that occur once are never
moved, those of repeated digests are moved to a table of distinct chunks, which verifies
that a digest names one content alone. A document is then an ordered list of chunk
identifiers, and documents are compared by their lists; whole texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A chunk ends with the first three bytes, after its least length, whose values modulo
#: ``CLASSES`` are ``ENDS``: one place in about 600 of a text, whatever its script. It has at
#: most ``MOST`` bytes.
CLASSES, ENDS = 8, (1, 6, 2)
LEAST, MOST = 128, 8192
#: Digests shared by different chunks are named by the chunk itself; so many at most.
MAX_CLASHES = 1_000
#: So many repeated digests of 32 bytes are broadcast at most.
BROADCAST_DIGESTS = 500_000


def boundary() -> str:
    """The pattern of the bytes that end a chunk, in a text of one character a byte."""
    return "".join("[" + "".join(f"\\x{{{b:x}}}" for b in range(256) if b % CLASSES == r) + "]" for r in ENDS)


def chunks(text: Column) -> Column:
    """The text's chunks in order, one character a byte; their concatenation is the text's
    bytes, and "" has none."""
    octets = F.decode(text.cast("binary"), "ISO-8859-1")
    long = f"(?s).{{{LEAST - len(ENDS)},{MOST - len(ENDS)}}}?{boundary()}|.{{1,{MOST}}}"
    return F.when(F.octet_length(text) <= LEAST, F.filter(F.array(octets), lambda c: c != "")).otherwise(F.regexp_extract_all(octets, F.lit(long), F.lit(0)))


def digest(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk.cast("binary"), 256))


def ambiguous(pieces: DataFrame, name=digest) -> DataFrame:
    """The digests of ``pieces`` (chunk) that more than one content has: none, unless SHA-256 breaks.

    Contents are grouped whole, and combined before they are shuffled.
    """
    distinct = pieces.groupBy("chunk").agg(F.lit(1).alias("one")).select(name(F.col("chunk")).alias("digest"))
    return distinct.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_expr: Column | None = None, name=digest) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical, byte for byte; null counts as empty. Of equal texts the
    row with the greatest id stays (null ids are least; of rows equal in id and text one
    stays). An empty table gives no rows. ``id_expr`` may give another key than a column,
    ``name`` another digest of a chunk.
    """
    key = F.col(id_col) if id_expr is None else id_expr
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(key.alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))

    def recipes(of) -> DataFrame:
        return cut(source.select("doc_id", "row", F.transform(chunks(F.col("text")), of).alias("recipe"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")))

    rows = recipes(name)
    repeated = cut(rows.select(F.explode("recipe").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    few = repeated.count() <= BROADCAST_DIGESTS
    pieces = source.select(F.explode(chunks(F.col("text"))).alias("chunk")).withColumn("digest", name(F.col("chunk")))
    pieces = pieces.join(F.broadcast(repeated) if few else repeated.hint("merge"), "digest", "left_semi")
    clash = [r.digest for r in ambiguous(pieces, name).limit(MAX_CLASHES + 1).collect()]
    if len(clash) > MAX_CLASHES:
        raise ValueError("the digest doesn't tell chunks apart")
    if clash:
        rows = recipes(lambda c: F.when(name(c).isin(clash), c.cast("binary")).otherwise(name(c)))
    last = F.max(F.struct("doc_id", "row")).alias("last")
    groups = cut(rows.groupBy("recipe").agg(last, F.count("*").alias("n")).where("n > 1"))
    joined = rows.join(groups, "recipe", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("last.row") == F.col("row"))).alias("kept"),
        "text_sha256",
        "row",
    )
