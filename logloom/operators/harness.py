"""Whole measurements: throughput and totals, paired analysis, the label ceiling, training shards."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from ..sources.readers import CHUNK_BYTES, byte_chunks
from . import corpus, facts, labels, lines, methods, stats

PERCENTS = (50, 95, 99)


def percentiles(rows: DataFrame, column: str, percents: tuple[int, ...] = PERCENTS) -> dict[int, float]:
    """The value at place round(p / 100 * (n - 1)), from 0, of the sorted values; 0 without rows."""
    values = cut(rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x")))
    n = values.count()
    place = lambda p: int(p / 100 * (n - 1) + 0.5)  # noqa: E731  halves go up
    return {p: stats.value_at_rank(values, "x", place(p) + 1) if n else 0.0 for p in percents}


def reductions(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, chunk_id, bytes, tokens_in, tokens_out, elided, reduced) of each chunk of each text,
    reduced by its line templates alone."""
    chunks = byte_chunks(docs, chunk_bytes).select(F.struct("doc_id", "chunk_id").alias("doc_id"), F.col("chunk").alias("text"))
    short = lines.reduced(chunks)
    rows = chunks.join(short, "doc_id")
    return rows.select("doc_id.doc_id", "doc_id.chunk_id", F.octet_length("text").alias("bytes"), T.token_count(F.col("text")).alias("tokens_in"), T.token_count(F.col("reduced")).alias("tokens_out"), F.col("n_elided").alias("elided"), "reduced")


def totals(chunks: DataFrame) -> DataFrame:
    """One row of all chunks of ``reductions``: files, chunks, bytes, tokens_in, tokens_out, ratio, pct_removed, elided."""
    agg = chunks.agg(F.countDistinct("doc_id").alias("files"), F.count("*").alias("chunks"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "tokens_in", "tokens_out", "elided")])
    part = lambda a, b: F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(F.lit(0.0))
    return agg.select("*", part(F.col("tokens_in"), F.col("tokens_out")).alias("ratio"), part(100.0 * (F.col("tokens_in") - F.col("tokens_out")), F.col("tokens_in")).alias("pct_removed"))


def survivals(chunks: DataFrame, needles: DataFrame) -> DataFrame:
    """(kept, total): for each chunk, of its document's ``needles`` (doc_id, needle), those that its reduced text holds."""
    met = chunks.select("doc_id", "reduced").join(needles.select("doc_id", "needle"), "doc_id")
    return met.agg(F.count_if(F.contains("reduced", F.col("needle"))).alias("kept"), F.count("*").alias("total"))


def throughput(docs: DataFrame, batches: int = 32, chunk_bytes: int = CHUNK_BYTES) -> dict:
    """Totals of ``docs``, MB a second, and percentiles of the milliseconds a chunk takes.

    Chunks are measured together, a hashed share of the documents at a time: a batch's
    seconds over its chunks are one latency, since a cluster doesn't work through chunks singly.
    """
    spark, took = docs.sparkSession, []
    for k in range(batches):
        part = reductions(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), chunk_bytes)
        began = time.monotonic()
        row = totals(part).first()
        if row.chunks:
            took.append((row.asDict(), time.monotonic() - began))
    whole = {c: sum(r[c] for r, _ in took) for c in ("files", "chunks", "bytes", "tokens_in", "tokens_out", "elided")}
    seconds = sum(s for _, s in took)
    slow = spark.createDataFrame([(1000 * s / r["chunks"],) for r, s in took], "ms double")
    return whole | {"ratio": whole["tokens_in"] / max(1, whole["tokens_out"]), "mb_per_s": whole["bytes"] / (1 << 20) / max(seconds, 1e-9), "latency_ms": percentiles(slow, "ms")}


# --- paired analysis of a results table ---------------------------------------------------

METRICS = ("judge", "exact")


def method_stats(results: DataFrame, resamples: int = 1000, conf: float = 0.95, seed: int = 0) -> DataFrame:
    """(ratio_key, method, metric, n, point, lo, hi, judge_errors) of results as ``read_results`` has them."""
    errors = results.groupBy("ratio_key", "method").agg(F.count_if("judge_error").alias("judge_errors"))
    long = results.select("ratio_key", "method", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("survived")) for m in METRICS])).alias("x")).select("ratio_key", "method", "x.*")
    return stats.bootstrap_ci(long, "ratio_key", "method", "metric", resamples=resamples, conf=conf, seed=seed).join(errors, ["ratio_key", "method"])


def domain_stats(results: DataFrame) -> DataFrame:
    """(ratio_key, method, domain, n, judge_survived, judge_rate, exact_survived, exact_rate)."""
    counts = [F.count_if(m).alias(f"{m}_survived") for m in METRICS]
    rates = [F.avg(F.col(m).cast("double")).alias(f"{m}_rate") for m in METRICS]
    return results.groupBy("ratio_key", "method", facts.domain(F.col("fact_type")).alias("domain")).agg(F.count("*").alias("n"), *counts, *rates)


def pair_tests(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ratio_key, method_a, method_b, metric, b, c, n_discordant, chi2, p_exact, a_better, p_chi2) of
    ``pairs`` (method_a, method_b), at every ratio key that has both methods.

    Items are paired by their place; where the two lists differ in length or in a doc_id, it raises.
    """
    item = F.struct("doc_id", *METRICS)
    side = lambda m: results.select("ratio_key", F.col("method").alias(m), "ord", item.alias(m[-1]))
    have = results.select("ratio_key", "method").distinct()
    both = pairs.join(have.withColumnRenamed("method", "method_a"), "method_a").join(have.withColumnRenamed("method", "method_b"), ["ratio_key", "method_b"])
    a = both.join(side("method_a"), ["ratio_key", "method_a"])
    b = both.join(side("method_b"), ["ratio_key", "method_b"])
    keys = ["ratio_key", "method_a", "method_b", "ord"]
    met = a.join(b, keys, "full")
    same = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    held = met.withColumn("a", F.when(same, F.col("a")).otherwise(F.raise_error(F.lit("paired methods are not aligned on doc_id"))))
    long = held.select(*keys[:3], F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").alias("a"), F.col(f"b.{m}").alias("b")) for m in METRICS])).alias("x")).select(*keys[:3], "x.*")
    return stats.mcnemar(long, *keys[:3], "metric")


# --- the label ceiling --------------------------------------------------------------------


def ceiling_items(records: DataFrame, semantic: bool = False) -> DataFrame:
    """(id, fact_type, teacher, label, severe, drop), a row a record whose needle is in its original.

    ``records``: id, original, compressed. The needle is the original's best fact. teacher: it
    survives in the compressed text; label: in what the aligned labels keep; drop: the share
    of tokens that those labels drop; severe: it survives the severity method at that share.
    """
    found = (facts.semantic_candidates if semantic else facts.candidates)(F.col("original"))
    rows = records.select("id", "original", "compressed", F.explode(facts.best(F.col("original"), found)).alias("b"))
    rows = rows.select("id", "original", "compressed", "b.fact_type", "b.answer").where(T.survives(F.col("answer"), F.col("original")))
    masked = labels.derive_mask(rows)
    kept = F.array_join(F.transform(F.filter(F.arrays_zip("tokens", "keep"), lambda x: x["keep"]), lambda x: x["tokens"]), "")
    n = F.size("tokens")
    drop = F.when(n > 0, 1.0 - F.size(F.filter("keep", lambda k: k)) / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))
    rows = cut(masked.select("id", "original", "fact_type", "answer", T.survives(F.col("answer"), F.col("compressed")).alias("teacher"), T.survives(F.col("answer"), kept).alias("label"), drop.alias("drop")))
    other = methods.keep_severity(rows.select(F.col("id").alias("doc_id"), F.col("original").alias("text"), F.col("drop").alias("rate")), F.col("rate"))
    rows = rows.join(other.select(F.col("doc_id").alias("id"), F.col("compressed").alias("severe")), "id", "left")
    return rows.select("id", "fact_type", "teacher", "label", T.survives(F.col("answer"), F.coalesce("severe", F.lit(""))).alias("severe"), "drop")


def ceiling_counts(records: DataFrame, items: DataFrame, semantic: bool = False) -> dict:
    """The counters of a label ceiling: chunks, with_needle, needle_in_original, teacher_survived,
    label_survived, keepsev_survived, sum_teacher_drop, and by_type: fact type to [n, teacher, severity]."""
    found = (facts.semantic_candidates if semantic else facts.candidates)(F.col("original"))
    seen = records.agg(F.count("*").alias("chunks"), F.count_if(F.size(found) > 0).alias("with_needle")).first().asDict()
    all_ = items.agg(F.count("*").alias("needle_in_original"), F.count_if("teacher").alias("teacher_survived"), F.count_if("label").alias("label_survived"), F.count_if("severe").alias("keepsev_survived"), F.coalesce(F.sum("drop"), F.lit(0.0)).alias("sum_teacher_drop")).first().asDict()
    return seen | all_ | {"by_type": {r.fact_type: [r.n, r.teacher, r.keep_severity] for r in ceiling_types(items).collect()}}


def ceiling_types(items: DataFrame) -> DataFrame:
    """(fact_type, n, teacher, label, keep_severity)."""
    return items.groupBy("fact_type").agg(F.count("*").alias("n"), F.count_if("teacher").alias("teacher"), F.count_if("label").alias("label"), F.count_if("severe").alias("keep_severity"))


# --- training shards ----------------------------------------------------------------------


def long_enough(shards: DataFrame, least: int, column: str = "tokens") -> DataFrame:
    """Shards of ``least`` tokens or more; 0 keeps all."""
    return shards.where(F.size(column) >= least) if least else shards


def shards(pairs: DataFrame, min_tokens: int = 0, val_frac: float = 0.1, seed: int = 0, needle_weight: float = 1.0) -> DataFrame:
    """(src_path, chunk_id, tokens, tags, w_semantic, w_dependency, is_code, bucket) of surviving pairs
    (src_path, chunk_id, original, compressed): labels by alignment, code by its syntax, a bucket by hash."""
    masked = labels.derive_mask(pairs.withColumn("_lang", labels.language_of(F.col("src_path"))))
    out = None
    for language in ("python", "json", "text"):
        part = labels.split_labels(masked.where(F.col("_lang") == language), language)
        out = part if out is None else out.unionByName(part)
    if needle_weight != 1.0:
        salient = labels.salience_weights(F.col("original"), F.col("spans"), needle_weight)
        out = out.withColumn("w_semantic", F.zip_with("w_semantic", salient, lambda a, b: a * b))
    rows = out.select("src_path", "chunk_id", "tokens", F.transform("keep", lambda k: k.cast("int")).alias("tags"), "w_semantic", "w_dependency", "is_code", corpus.split_bucket(F.col("src_path"), F.col("chunk_id"), val_frac, seed).alias("bucket"))
    return long_enough(rows, min_tokens)


def shard_summary(n_in: int, survivors: DataFrame, made: DataFrame) -> DataFrame:
    """One row: total_in, survived, dropped_short, emitted, train, val, pct_code, mean_tokens."""
    found = made.agg(F.count("*").alias("emitted"), F.count_if(F.col("bucket") == "train").alias("train"), F.count_if(F.col("bucket") == "val").alias("val"), F.coalesce(100.0 * F.avg(F.col("is_code").cast("double")), F.lit(0.0)).alias("pct_code"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("mean_tokens"))
    kept = survivors.agg(F.count("*").alias("survived"))
    both = found.join(F.broadcast(kept))  # one row each
    return both.select(F.lit(n_in).cast("bigint").alias("total_in"), "survived", (F.col("survived") - F.col("emitted")).alias("dropped_short"), "emitted", "train", "val", "pct_code", "mean_tokens")
