"""Writers: lines, JSON lines, shards, manifests and reports. Spark's commits make them whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str, column: str = "line") -> tuple[int, int]:
    """Text lines; (written, skipped nulls)."""
    counts = rows.agg(F.count(column).alias("w"), F.count_if(F.col(column).isNull()).alias("s")).first()
    rows.where(F.col(column).isNotNull()).select(column).write.mode("overwrite").text(path)
    return counts.w, counts.s


def write_jsonl(rows: DataFrame, path: str, by: str | None = None) -> None:
    w = rows.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def write_report(rows: DataFrame, path: str, name: str = "rows") -> None:
    """One JSON object of a small result, {name: [...]}, rows sorted by their JSON."""
    one = rows.agg(F.array_sort(F.collect_list(F.to_json(F.struct("*")))).alias("r"))
    one.select(F.concat(F.lit('{"' + name + '":['), F.array_join("r", ","), F.lit("]}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def manifest(lines: DataFrame, samples: int = 3) -> DataFrame:
    """(corpus, line_count, bytes, samples) of (corpus, ord, line): the first non-blank lines."""
    rows = lines.where(F.trim("line") != "")
    first = rows.groupBy("corpus").agg(F.count("*").alias("line_count"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("corpus").orderBy("ord"))
    some = rows.withColumn("_r", rank).where(F.col("_r") <= samples).groupBy("corpus").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x.line).alias("samples"))
    return first.join(some, "corpus")


def survival_report(rows: DataFrame) -> DataFrame:
    """(line): a table of survival by method and rate."""
    line = F.format_string("%-20s drop=%.2f survival=%5.1f%% ratio=%.2fx achieved=%.2f n=%d", "method", "rate", F.col("survival") * 100, "mean_ratio", "mean_drop", "n")
    return rows.orderBy("method", "rate").select(line.alias("line"))


def significance_report(rows: DataFrame) -> DataFrame:
    """(line): paired tests by rate, with a verdict at p < 0.05."""
    verdict = F.when(F.col("p_exact") >= 0.05, "no difference").when(F.col("a_better"), "A better").otherwise("B better")
    return rows.orderBy("rate").select(F.format_string("rate=%.2f b=%d c=%d chi2=%.3f p=%.4f %s", "rate", "b", "c", "chi2", "p_exact", verdict).alias("line"))


def throughput_report(found: dict, name: str) -> list[str]:
    """Lines of ``harness.throughput``'s figures, and of survivals if they are among them."""
    late = "  ".join(f"p{p}={v:.2f}" for p, v in found["latency_ms"].items())
    out = [
        f"== results: {name} ==", f"files processed : {found['files']}", f"bytes processed : {found['bytes'] / (1 << 20):.1f} MB", f"chunks          : {found['chunks']}",
        f"tokens          : {found['tokens_in']} -> {found['tokens_out']}", f"ratio           : {found['ratio']:.2f}x ({100 * (1 - found['tokens_out'] / max(1, found['tokens_in'])):.1f}% removed)",
        f"lines elided    : {found['elided']}", f"throughput      : {found['mb_per_s']:.1f} MB/s", f"chunk latency ms: {late}",
    ]
    if found.get("total"):
        lost = "" if 100 * found["kept"] / found["total"] >= 99.9 else "  (answer tokens lost)"
        out.append(f"survival        : {100 * found['kept'] / found['total']:.2f}% ({found['kept']}/{found['total']}){lost}")
    return out


def _share(part: int, whole: int) -> str:
    return f"{100 * part / whole:.1f}%" if whole else "n/a"


def ceiling_report(c: dict) -> list[str]:
    """Lines of ``harness.ceiling_counts``' counters, with the verdict on the labels."""
    n = c["needle_in_original"]
    rows = [("teacher", c["teacher_survived"]), ("labels", c["label_survived"]), ("keep-severity at the same drop", c["keepsev_survived"])]
    out = [f"records: {c['chunks']}", f"with a needle: {c['with_needle']}", f"needle in the original: {n}", f"mean drop of the labels: {c['sum_teacher_drop'] / n if n else 0.0:.3f}"]
    out += [f"{name}: {_share(k, n)} ({k}/{n})" for name, k in rows]
    for kind, (total, teacher, severe) in sorted(c["by_type"].items(), key=lambda x: -x[1][0]):
        out.append(f"  {kind}: teacher {_share(teacher, total)}, keep-severity {_share(severe, total)} (n={total})")
    if n:
        gain = (c["teacher_survived"] - c["keepsev_survived"]) / n
        out.append("verdict: " + ("the labels keep fewer needles than keep-severity" if gain < -1e-9 else "the labels match keep-severity" if gain < 1e-9 else f"the labels keep more needles, by {100 * gain:.1f} points"))
    return out


def analysis_report(methods: DataFrame, domains: DataFrame, pairs: DataFrame, metric: str) -> DataFrame:
    """(line) of ``harness.method_stats``, ``domain_stats`` and ``pair_tests``, by ratio key."""
    cell = F.format_string("  %-20s n=%d %.0f%% [%.0f-%.0f] errors=%d", "method", "n", 100 * F.col("point"), 100 * F.col("lo"), 100 * F.col("hi"), "judge_errors")
    top = methods.where(F.col("metric") == metric).select("ratio_key", F.lit(1).alias("part"), F.col("method").alias("at"), cell.alias("line"))
    heads = top.select("ratio_key").distinct().select("ratio_key", F.lit(0).alias("part"), F.lit("").alias("at"), F.concat(F.lit("ratio "), "ratio_key").alias("line"))
    cell = F.format_string("    %s %s n=%d %.0f%% (%d/%d)", "method", "domain", "n", 100 * F.col(f"{metric}_rate"), f"{metric}_survived", "n")
    middle = domains.select("ratio_key", F.lit(2).alias("part"), F.concat_ws(":", "method", "domain").alias("at"), cell.alias("line"))
    mark = F.when((F.col("p_exact") < 0.05) & F.col("a_better"), "  A significantly better").otherwise("")
    cell = F.format_string("    %s vs %s: b=%d c=%d chi2=%.2f p_chi2=%.4f p_exact=%.4f%s", "method_a", "method_b", "b", "c", "chi2", "p_chi2", "p_exact", mark)
    last = pairs.where(F.col("metric") == metric).select("ratio_key", F.lit(3).alias("part"), F.concat_ws(":", "method_a", "method_b").alias("at"), cell.alias("line"))
    return heads.unionByName(top).unionByName(middle).unionByName(last).orderBy("ratio_key", "part", "at").select("line")
