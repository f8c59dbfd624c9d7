"""``python -m logloom COMMAND``: the measurements and reports over files, for use from a shell."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import selftest
from .operators import facts, harness, labels, methods
from .session import build_session, cut, ship
from .sources import readers, sinks


def bench(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Throughput, totals and survival of must-survive strings of the logs under a folder."""
    files = readers.discover_logs(spark, a.path).withColumnRenamed("path", "doc_id")
    found = harness.throughput(files, a.batches, a.chunk_bytes)
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    needles = readers.must_survive(spark, a.path, files.withColumnRenamed("doc_id", "path"))
    by_file = files.select("doc_id", folder(F.col("doc_id")).alias("folder")).join(needles, "folder").select("doc_id", "needle")
    return sinks.throughput_report(found | harness.survivals(harness.reductions(files, a.chunk_bytes), by_file).first().asDict(), a.path)


def stats(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Intervals and paired tests of a results file."""
    results = readers.read_results(spark, a.path)
    pairs = spark.createDataFrame([tuple(p.split(":")) for p in a.pairs], "method_a string, method_b string")
    report = sinks.analysis_report(harness.method_stats(results, a.resamples), harness.domain_stats(results), harness.pair_tests(results, pairs), a.metric)
    return [r.line for r in report.collect()]


def _records(spark: SparkSession, path: str, limit: int | None) -> DataFrame:
    return readers.read_pairs(spark, path, limit).select(F.monotonically_increasing_id().alias("id"), "original", "compressed", "src_path", "chunk_id")


def ceiling(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """How many needles the labels of a file of pairs keep."""
    # rows are numbered once, since they are read again and again
    records = cut(_records(spark, a.path, a.limit))
    return sinks.ceiling_report(harness.ceiling_counts(records, harness.ceiling_items(records, a.semantic), a.semantic))


def survival(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Survival by method and rate of a file of triples."""
    rows = readers.read_triples(spark, a.path)
    triples = rows.select(F.concat_ws("#", "doc_id", "answer").alias("triple_id"), F.col("text").alias("chunk"), "answer", "fact_type", "source")
    items = methods.survival_items(triples, tuple(a.rates))
    return [r.line for r in sinks.survival_report(methods.survival_rows(items)).collect()]


def triples(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """The best fact of each window of the logs under a folder, a JSON line each."""
    files = readers.discover_logs(spark, a.path).withColumnRenamed("path", "doc_id")
    rows = facts.triples(files, a.width, a.width, a.semantic).orderBy("doc_id", "start").select("doc_id", "question", "answer", "fact_type")
    return [json.dumps(r.asDict()) for r in rows.toLocalIterator()]


def shards(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Training shards of a file of pairs that quality control lets pass, written by bucket."""
    pairs = readers.read_pairs(spark, a.path)
    kept = labels.qc_filter(labels.qc_metrics(pairs)).select("src_path", "chunk_id", "original", "compressed")
    made = harness.shards(kept, a.min_tokens, a.val_frac, a.seed)
    sinks.write_jsonl(made, a.out, "bucket")
    return [f"{k}: {v}" for k, v in harness.shard_summary(pairs.count(), kept, made).first().asDict().items()]


COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], list[str]]] = {f.__name__: f for f in (bench, stats, ceiling, survival, triples, shards)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="logloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        p = sub.add_parser(name, help=f.__doc__)
        p.add_argument("path")
    add = lambda name, *flags, **how: sub.choices[name].add_argument(*flags, **how)
    add("bench", "--batches", type=int, default=32)
    add("bench", "--chunk-bytes", type=int, default=readers.CHUNK_BYTES)
    add("stats", "--metric", choices=harness.METRICS, default="judge")
    add("stats", "--resamples", type=int, default=1000)
    add("stats", "--pairs", nargs="*", default=["random+span:keep-severity"], help="method_a:method_b")
    add("ceiling", "--limit", type=int)
    add("ceiling", "--semantic", action="store_true")
    add("survival", "--rates", type=float, nargs="*", default=[0.2, 0.5, 0.8])
    add("triples", "--width", type=int, default=40)
    add("triples", "--semantic", action="store_true")
    add("shards", "out")
    add("shards", "--min-tokens", type=int, default=0)
    add("shards", "--val-frac", type=float, default=0.1)
    add("shards", "--seed", type=int, default=0)
    for name in ("selftest", "demo"):
        sub.add_parser(name)
    return top


def main(args: list[str], spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if a.command in ("selftest", "demo"):
        return selftest.main(["--demo"] if a.command == "demo" else [])
    spark = ship(spark or build_session())
    print("\n".join(COMMANDS[a.command](spark, a)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
