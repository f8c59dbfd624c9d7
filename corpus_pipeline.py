"""From raw documents to encoded training data: five stages, each an operator of ``logloom.llm``.

A stage begins with a collection of the executors' garbage: else the heap that one stage filled
stands beside the Python workers of the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import cut, documents, shared_dir, utf8
from logloom.llm.op2_simhash import similar_documents
from logloom.llm.op4_language import languages
from logloom.llm.op6_mixing import mixed_documents
from logloom.llm.op8_bpe import encoded
from logloom.llm.op9_exact import exact_groups
from logloom.session import remove, scratch, ship, tidy_shuffles, trim

#: So many keys of 16 bytes are broadcast at most.
BROADCAST_KEYS = 500_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column, of a name that it hasn't, that tells rows apart in any scan: their id
    and a hash of all their columns. Rows that share it are the same in every column."""
    name = "__pipeline_key"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    return docs.withColumn(name, F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h"))), name


def _staying(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, by ``found``: (key, stays), a row each.

    Keys of rows that go are broadcast if few enough, so that no text is shuffled; more are
    joined by a shuffle. Of rows that are the same in every column, as many stay as ``found`` says.
    """
    keyed, name = _keyed(docs)
    key, left, whole = f"{name}k", f"{name}n", F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    counts = found.groupBy(F.col("key").alias(key)).agg(F.count("*").alias("n"), F.count_if("stays").alias(left))
    counts = cut(counts.where(F.col(left) < F.col("n")).select(key, left))

    def met(keys: DataFrame, how: str) -> DataFrame:
        few = keys.count() <= BROADCAST_KEYS
        return keyed.join(F.broadcast(keys) if few else keys.hint("merge"), F.col(name) == F.col(key), how)

    out = met(counts.select(key), "left_anti").drop(name)
    some = counts.where(F.col(left) > 0)
    if some.isEmpty():
        return out
    one = met(some, "inner").groupBy(name).agg(F.first(whole).alias("doc"), F.first(left).alias("copies"))
    return out.unionByName(one.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier rejects go; ``lang`` stays as it was.

    Null and empty texts and texts without a letter are rejected. The decision follows the text,
    so repeated rows go or stay together. An empty table gives no rows.
    """
    trim(ship(spark))
    keyed, name = _keyed(docs)
    found = languages(keyed, carry=(name,))
    return _staying(docs, found.select(F.col(name).alias("key"), (~F.col("rejected")).alias("stays")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the greatest doc_id stays, one row where ids repeat.

    Null counts as empty, so that one row of all null and empty texts stays; null ids are
    least. An empty table gives no rows.
    """
    trim(ship(spark))
    keyed, name = _keyed(docs)
    found = exact_groups(keyed, id_col=name)
    return _staying(docs, found.select(F.col("doc_id").alias("key"), F.col("kept").alias("stays")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id stays, one row where ids repeat.

    Copies are near at a Jaccard similarity of 0.8 of five-word shingles, which the bits of
    fingerprints can't tell: ``similar_documents`` says why. Texts without words are near
    copies of each other; null ids are least. An empty table gives no rows.
    """
    trim(ship(spark))
    with tidy_shuffles(spark):
        found = similar_documents(*_keyed(docs))
        return _staying(docs, found.select("key", F.col("kept").alias("stays")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times.

    Texts without words have no size and are taken as often as their source's whole repeats,
    or once more by hash; null is a source like any other. Rows equal in id and text are taken
    alike. An empty table gives no rows.
    """
    trim(ship(spark))
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and digests of ids and of what they decode to.

    A null or empty text has no ids; every row is encoded, repeated ones too. An empty table
    gives no rows.
    """
    trim(ship(spark))
    return docs.select("doc_id", "lang", "source", encoded(utf8("text"), with_ids=True).alias("e")).select("doc_id", "lang", "source", "e.*")


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixing),
    ("byte-level BPE", encoding),
]

#: Neither the classifier nor SimHash can be said in SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and reread.

    A stage's output, and the checkpoints made for it, are removed when the next one is
    written; the last one's output stays, since the result is read from it.
    """
    ship(spark)
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
