"""The content-addressed store of elided payloads, a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import content_id

SCHEMA = "id string, payload string, omitted_count bigint, created_at timestamp"


def entries(payloads: DataFrame, payload: str = "payload", omitted: str = "omitted_count", created_at: str | None = None) -> DataFrame:
    """Rows of the store. Ids are content addresses; ``created_at`` is a timestamp's text."""
    at = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
    return payloads.where(F.col(payload).isNotNull()).select(content_id(F.col(payload)).alias("id"), F.col(payload).alias("payload"), F.col(omitted).cast("bigint").alias("omitted_count"), at.alias("created_at"))


def stash(rows: DataFrame, path: str) -> None:
    """Append, one commit a call. Equal payloads have one id, so a rerun changes no answer."""
    rows.dropDuplicates(["id"]).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def retrieve(store: DataFrame, wanted: DataFrame, id_col: str = "cache_id") -> DataFrame:
    """(cache_id, payload, omitted_count, found, error) for each wanted id; unknown: ``cache_miss``."""
    unique = store.groupBy("id").agg(F.min("payload").alias("payload"), F.min("omitted_count").alias("omitted_count"))
    got = wanted.select(F.col(id_col).alias("cache_id")).join(unique, F.col("cache_id") == F.col("id"), "left")
    found = F.col("id").isNotNull()
    return got.select("cache_id", "payload", "omitted_count", found.alias("found"), F.when(~found, "cache_miss").alias("error"))


def group_payloads(groups: DataFrame) -> DataFrame:
    """Store rows and manifest of elided line groups: (doc_id, group_idx, payload, omitted_count, cache_id)."""
    payload = F.to_json("elided")
    return groups.select("doc_id", "group_idx", payload.alias("payload"), F.col("n_elided").cast("bigint").alias("omitted_count"), content_id(payload).alias("cache_id"))
