"""A quality classifier: supervised subword embeddings, trained by SGD in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subword
from .common import remainder, tidy, utf8, values

FEATURES = subword.Features(bits=15, high=3, words=2)
#: At most so many labelled documents teach the model: those whose hashed id is least.
MAX_TRAIN = 6_000


def bags_of(features: subword.Features):
    """A column function: UTF-8 texts to struct<ids: int32s, shares: float32s> as bytes."""

    def each(texts: pa.Array) -> pa.Array:
        got = [subword.bag(x.decode("utf-8", "replace"), features) for x in values(texts)]
        return pa.StructArray.from_arrays([pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([b.tobytes() for _, b in got], pa.binary())], names=["ids", "shares"])

    return F.arrow_udf(tidy(each), "struct<ids:binary,shares:binary>").asNondeterministic()


def fit(rows: list[tuple[bytes, bytes, int]], classes: int, features: subword.Features, **how) -> dict:
    """A model of rows (ids, shares, class)."""
    bags = [(np.frombuffer(ids, np.int32), np.frombuffer(part, np.float32)) for ids, part, _ in rows]
    return subword.train(bags, [y for *_, y in rows], classes, features, **how)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", held_out=None, max_train: int = MAX_TRAIN, features: subword.Features = FEATURES) -> dict | None:
    """Fit on at most ``max_train`` labelled documents outside ``held_out``; None without any.

    Labels other than 0 and 1, null ids, and ids labelled both ways teach nothing. A
    document whose id is repeated counts once a row, within the bound.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(quality_col).alias("y")).where("id is not null and y in (0, 1)")
    if held_out is not None:
        known = known.where(~held_out("id"))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    ids = known.orderBy(F.xxhash64("id"), "id").limit(max_train).select("id", "y")
    picked = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).join(F.broadcast(ids), "id")  # max_train rows at most
    rows = picked.select("id", "y", F.xxhash64("id", "text").alias("h"), bags_of(features)("text").alias("b")).select("id", "y", "h", "b.ids", "b.shares").orderBy("h", "id").limit(max_train).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.id, r.ids))
    return fit([(r.ids, r.shares, int(r.y)) for r in rows], 2, features)


def score_quality(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (that of label 1, 0 to 1), predicted.

    Null texts count as empty; a text without words gets the share of label 1 among the
    labels learned from. Without a model the score is 0.5. No other column is read.
    """

    def each(texts: pa.Array) -> pa.Array:
        return pa.array([float(subword.probabilities(x.decode("utf-8", "replace"), model)[1]) for x in values(texts)], pa.float64())

    score = F.lit(0.5) if model is None else F.arrow_udf(tidy(each), "double").asNondeterministic()(utf8(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def held_out(key):
    return F.coalesce(remainder(key, 3) == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, as ``score_quality`` has them.

    The model is fitted outside the held-out third. Null, empty and repeated texts, repeated and
    null ids and columns of other names have results as any other row has; no rows: no rows.
    """
    model = train_quality(docs, labels, held_out=held_out)
    return score_quality(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
