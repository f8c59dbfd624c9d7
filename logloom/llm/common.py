"""What the operators of this subpackage share: lineage cuts, row keys, words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Tables, cut, shared_dir

__all__ = ["WORD", "Tables", "cut", "documents", "release", "remainder", "shared_dir", "tidy", "utf8", "values"]

#: A word: a run of anything but ASCII white space. ``bytes.split()`` splits the same way.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column: Column | str) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("binary"), F.lit(b""))


def remainder(key: Column | str, n: int) -> Column:
    """crc32 of the key's decimal text, modulo ``n``; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % n


def values(column: pa.Array, step: int = 256) -> Iterator:
    """The values of an Arrow column, of which only a few at a time are Python objects."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def release() -> None:
    """Give freed memory back: a worker may wait long for its next task beside a full heap.

    Arrow's memory comes from the C library from then on, which keeps less of it.
    """
    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(each: Callable) -> Callable:
    """An Arrow function that gives memory back after each batch."""

    @wraps(each)
    def run(*columns):
        try:
            return each(*columns)
        finally:
            release()

    return run
