"""``python -m logloom.selftest``: checks of an installation; ``--demo`` shows what each call does."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import text as T
from .operators import arrays, lines, store
from .session import build_session, ship
from .sources import curated


def _docs(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)


def _locked_text(spark: SparkSession, text: str, language: str, keywords: list[str]) -> set[str]:
    rows = api.lock_mask(_docs(spark, text), language, keywords).where("locked").collect()
    return {r.token.strip() for r in rows}


def check_store(spark: SparkSession) -> None:
    with tempfile.TemporaryDirectory() as path:
        rows = _docs(spark, "one", "two").select(F.col("text").alias("payload"), F.lit(1).alias("omitted_count"))
        store.stash(store.entries(rows), path + "/store")
        wanted = spark.createDataFrame([("one",), ("three",)], "t string").select(arrays.content_id(F.col("t")).alias("cache_id"))
        found = sorted(r.found for r in api.retrieve(spark, path + "/store", wanted).collect())
        assert found == [False, True], found


def check_json(spark: SparkSession) -> None:
    got = _locked_text(spark, '{"id": 42, "ok": true}', "json", [])
    assert {"{", "}", ":", "42", "true"} <= got and "id" not in got, got


def check_python(spark: SparkSession) -> None:
    got = _locked_text(spark, "def area(r):\n    return 3 * r\n", "python", [])
    assert {"def", "return", "3", "*"} <= got and "area" not in got, got


def check_keywords(spark: SparkSession) -> None:
    got = _locked_text(spark, "the pool was exhausted twice", "text", ["exhausted"])
    assert got == {"exhausted"}, got


def check_round_trip(spark: SparkSession) -> None:
    docs = curated.curated(spark).select(F.xxhash64("source").alias("doc_id"), "text")
    units, groups = lines.units(docs)
    made = lines.rebuild(units, groups, docs.select("doc_id", F.col("text").endswith("\n").alias("ends_in_newline")))
    assert made.join(docs, ["doc_id", "text"]).count() == docs.count()


def check_facts(spark: SparkSession) -> None:
    got = {r.source: r.answer for r in curated.curated_triples(spark).collect()}
    short = api.compress_log(curated.curated(spark).select(F.col("source").alias("doc_id"), "text"))
    text = {r.doc_id: r.compressed for r in short.collect()}
    assert set(got) == set(text) and got["traceback"] == "ConnectionResetError"
    assert all(got[s] in text[s] for s in ("traceback", "api", "distsys")), got


def check_scorer(spark: SparkSession) -> None:
    assert api.model_file(None) == ("unset", None) and api.model_file("")[0] == "empty" and api.model_file("/no/such/file")[0] == "missing"


CHECKS: dict[str, Callable[[SparkSession], None]] = {
    "store": check_store, "scorer": check_scorer, "json": check_json, "python": check_python, "keywords": check_keywords, "round trip": check_round_trip, "facts": check_facts,
}


def run(spark: SparkSession) -> dict[str, str]:
    """Name to what is wrong, of the checks that fail."""
    failed = {}
    for name, check in CHECKS.items():
        try:
            check(spark)
        except Exception as e:  # each check is reported, the others still run
            failed[name] = f"{type(e).__name__}: {e}"[:300]
    return failed


def demo(spark: SparkSession) -> list[str]:
    """Lines: what the calls make of the curated documents."""
    docs = curated.curated(spark).select(F.col("source").alias("doc_id"), "text")
    out = []
    for r in api.compress_log(docs).orderBy("doc_id").collect():
        out.append(f"{r.doc_id}: {r.input_tokens} -> {r.output_tokens} tokens, {r.ratio:.2f}x")
    for r in curated.curated_triples(spark).orderBy("doc_id").collect():
        out.append(f"{r.doc_id}: {r.question} {r.answer}")
    masks = api.lock_mask(docs, keywords=["request_id"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("locked").alias("locked"))
    out += [f"{r.doc_id}: {r.locked} of {r.n} tokens locked" for r in masks.orderBy("doc_id").collect()]
    kinds = docs.select("doc_id", F.size(F.array_distinct(F.transform(F.split("text", "\n"), T.normalize_line))).alias("n"))
    return out + [f"{r.doc_id}: {r.n} templates" for r in kinds.orderBy("doc_id").collect()]


def main(args: list[str]) -> int:
    spark = ship(build_session("logloom self-test"))
    if "--demo" in args:
        print("\n".join(demo(spark)))
        return 0
    failed = run(spark)
    for name in CHECKS:
        print(f"{name}: {failed.get(name, 'ok')}")
    print(f"{len(CHECKS) - len(failed)} of {len(CHECKS)} checks passed")
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
