"""Head and tail of long arrays; the middle goes to the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compress_array(df: DataFrame, array: str, head: int = 3, tail: int = 3, min_len: int = 20) -> DataFrame:
    """Adds head, middle, tail, omitted and cache_id to rows of ``df``.

    An array of at least head + tail + max(min_len, 1) elements is cut, others pass whole as
    ``head`` with nothing omitted. cache_id is the SHA-256 of the middle's JSON, so equal
    middles are stored once and reruns agree.
    """
    a, n = F.col(array), F.size(array)
    cut = n >= head + tail + max(min_len, 1)
    middle = F.when(cut, F.slice(a, F.lit(head + 1), n - head - tail))
    rest = F.when(cut, F.slice(a, n - tail + 1, F.lit(tail))) if tail else F.when(cut, F.slice(a, 1, 0))
    first = F.when(cut, F.slice(a, 1, head)).otherwise(a)
    return df.select("*", first.alias("head"), middle.alias("middle"), rest.alias("tail"), F.when(cut, n - head - tail).otherwise(0).alias("omitted"), F.when(cut, content_id(F.to_json(middle))).alias("cache_id"))


def summary(omitted: Column, cache_id: Column) -> Column:
    """The element that stands for the middle, as JSON."""
    how = F.when(cache_id.isNull(), " (not stored)").otherwise("; retrieve by the id")
    return F.to_json(F.struct(cache_id.alias("cache_id"), omitted.alias("omitted_count"), F.concat(omitted.cast("string"), F.lit(" items elided"), how).alias("summary")))


def compress_json(df: DataFrame, column: str, head: int = 3, tail: int = 3, min_len: int = 20, cache: bool = True) -> DataFrame:
    """The same for a column of JSON text: adds compressed, cache_id, omitted and middle_json.

    Anything but an array, and invalid JSON, passes as it is. Elements keep their spelling up
    to white space and number form, as the JSON parser prints them.
    """
    value = F.try_parse_json(F.col(column))
    array = F.try_variant_get(value, "$", "array<variant>")
    rows = df.withColumn("_items", F.transform(array, lambda x: F.to_json(x)))
    n = F.size("_items")
    cut = F.coalesce(n >= head + tail + max(min_len, 1), F.lit(False))
    joined = lambda a: F.array_join(a, ",")
    middle = F.when(cut, F.concat(F.lit("["), joined(F.slice("_items", F.lit(head + 1), n - head - tail)), F.lit("]")))
    rows = rows.withColumn("omitted", F.when(cut, n - head - tail).otherwise(0)).withColumn("middle_json", middle)
    rows = rows.withColumn("cache_id", F.when(cut, content_id(F.col("middle_json"))) if cache else F.lit(None).cast("string"))
    edge = [F.slice("_items", 1, head), F.array(summary(F.col("omitted"), F.col("cache_id")))] + ([F.slice("_items", n - tail + 1, F.lit(tail))] if tail else [])
    short = F.concat(F.lit("["), joined(F.concat(*edge)), F.lit("]"))
    return rows.withColumn("compressed", F.when(cut, short).otherwise(F.col(column))).drop("_items")


def content_id(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)
