"""Paired significance tests, bootstrap intervals and ranking metrics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut


def chi2_tail(chi2: Column) -> Column:
    """The upper tail of chi-squared with one degree of freedom, by ``math.erfc``."""

    def each(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else math.erfc(math.sqrt(max(v, 0.0) / 2)) for v in x.to_pylist()], pa.float64())

    return F.arrow_udf(each, "double")(chi2)


def exact_binomial(n: Column, k: Column) -> Column:
    """Two-sided binomial p at one half: min(1, 2 * P(X <= k)), the tail as an incomplete beta function.

    P(X <= k) = I(1/2; n - k, k + 1), by its continued fraction, in about sqrt(n) steps.
    """

    def each(ns: pa.Array, ks: pa.Array) -> pa.Array:
        rows = zip(ns.to_pylist(), ks.to_pylist(), strict=True)
        return pa.array([None if a is None or b is None else 1.0 if a == 0 else min(1.0, 2.0 * half_tail(a, b)) for a, b in rows], pa.float64())

    return F.arrow_udf(each, "double")(n.cast("bigint"), k.cast("bigint"))


def half_tail(n: int, k: int) -> float:
    """P(X <= k) of n fair coins."""
    if k >= n:
        return 1.0
    if 2 * k + 1 > n:  # the fraction settles fast on the lesser side only
        return 1.0 - half_tail(n, n - k - 1)
    a, b, x = n - k, k + 1, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a + b) * math.log(0.5)) / a
    tiny, c = 1e-300, 1.0
    d = 1.0 / (1.0 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 100_000):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1.0 / ((1.0 + up * d) or tiny), (1.0 + up / c) or tiny
        out *= d * c
        down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1.0 / ((1.0 + down * d) or tiny), (1.0 + down / c) or tiny
        out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * out


def mcnemar(pairs: DataFrame, *by: str, a: str = "a", b: str = "b", chi2_p: bool = True) -> DataFrame:
    """(*by, b, c, n_discordant, chi2, p_exact, a_better[, p_chi2]) of paired booleans.

    b: A alone, c: B alone. chi2 has Yates' correction, not clamped: |b - c| of 0 gives 1 / n.
    """
    counts = pairs.groupBy(*by).agg(F.count_if(F.col(a) & ~F.col(b)).alias("b"), F.count_if(~F.col(a) & F.col(b)).alias("c"))
    n = F.col("b") + F.col("c")
    chi2 = F.when(n == 0, F.lit(0.0)).otherwise(F.pow(F.abs(F.col("b") - F.col("c")) - 1.0, F.lit(2.0)) / F.greatest(n, F.lit(1)))
    out = counts.withColumn("n_discordant", n).withColumn("chi2", chi2).withColumn("p_exact", exact_binomial(n, F.least("b", "c"))).withColumn("a_better", F.col("b") > F.col("c"))
    return out.withColumn("p_chi2", F.when(F.col("n_discordant") == 0, F.lit(1.0)).otherwise(chi2_tail(F.col("chi2")))) if chi2_p else out


def paired(items: DataFrame, method_a: str, method_b: str, key: str = "triple_id") -> DataFrame:
    """(rate, key, a, b): two methods on the same items; an item that one of them lacks raises."""
    side = lambda m, name: items.where(F.col("method") == m).select("rate", key, F.col("survived").alias(name), F.lit(True).alias(f"has_{name}"))
    both = side(method_a, "a").join(side(method_b, "b"), ["rate", key], "full")
    return both.select("rate", key, F.when(F.col("has_a") & F.col("has_b"), F.col("a")).otherwise(F.raise_error(F.lit("survival vectors must be aligned")).cast("boolean")).alias("a"), "b")


def bootstrap_ci(items: DataFrame, *by: str, value: str = "survived", resamples: int = 1000, conf: float = 0.95, seed: int = 0) -> DataFrame:
    """(*by, point, lo, hi, n): the percentile interval of the mean of booleans.

    A resample of n draws from booleans is, but for order, n draws of a success with the
    observed share, so a group is carried as two counts, whatever its size, and a resample is
    one binomial number, drawn by a generator that seed, group and resample decide.
    """
    groups = items.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(value)).alias("k"))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in by]) if by else F.lit("")
    draws = groups.withColumn("_key", key).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))

    def each(seeds: pa.Array, n: pa.Array, k: pa.Array) -> pa.Array:
        rows = zip(seeds.to_pylist(), n.to_pylist(), k.to_pylist(), strict=True)
        return pa.array([int(np.random.default_rng(s & (1 << 64) - 1).binomial(a, b / a)) for s, a, b in rows], pa.int64())

    total = F.arrow_udf(each, "bigint")(F.xxhash64(F.lit(seed), "_key", "r"), "n", "k")
    means = draws.withColumn("mean", total / F.col("n"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy("mean")) - 1
    low, high = min(resamples - 1, int((1 - conf) / 2 * resamples)), min(resamples - 1, int((1 - (1 - conf) / 2) * resamples))
    pick = lambda i: F.max(F.when(F.col("_rank") == i, F.col("mean")))
    return means.withColumn("_rank", rank).groupBy(*by).agg((F.max("k") / F.max("n")).alias("point"), pick(low).alias("lo"), pick(high).alias("hi"), F.max("n").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def ranking(scored: DataFrame, prob: str = "prob", gold: str = "gold", order: str = "i", target_rate: float | None = None) -> DataFrame:
    """One row of ranking metrics of (order, prob, gold 0/1).

    Items are ranked by falling prob, ties by ``order``; for the rank sum of ROC-AUC by rising
    prob, ties by ``order``. The ranking is a global order: range-partitioned sorts number it
    without bringing all rows to one task.
    """
    down = numbered(scored.select(F.col(prob).cast("double").alias("p"), F.col(gold).cast("bigint").alias("g"), F.col(order).alias("i")), [F.col("p").desc(), F.col("i")], "rank", "g", "tp")
    total = scored.agg(F.count("*").alias("n"), F.sum(F.col(gold).cast("bigint")).alias("pos"))
    up = numbered(down, [F.col("p").asc(), F.col("i")], "up")
    rows = up.join(F.broadcast(total))  # one row
    rate = F.col("pos") / F.col("n") if target_rate is None else F.lit(target_rate)
    k = F.least(F.col("n"), F.greatest(F.lit(1), F.rint(rate * F.col("n")).cast("bigint")))
    f1 = 2.0 * F.col("tp") / (F.col("rank") + F.col("pos"))
    hit = (F.col("p") >= 0.5).cast("bigint")
    clipped = F.least(F.lit(1.0 - 1e-7), F.greatest(F.lit(1e-7), F.col("p")))
    agg = rows.agg(
        F.max("n").alias("tokens"), F.max("pos").alias("pos"), F.max(k).alias("k"), F.max(rate).alias("target_rate"),
        F.sum(F.when(F.col("g") == 1, F.col("tp") / F.col("rank"))).alias("ap"),
        F.sum(F.when(F.col("g") == 1, F.col("up"))).alias("rank_sum"),
        F.max(F.struct(f1.alias("f1"), (-F.col("rank")).alias("first"), F.col("p").alias("thr"))).alias("best"),
        F.max(F.when(F.col("rank") == k, F.struct("tp", "p"))).alias("at"),
        F.sum(hit * F.col("g")).alias("tp5"), F.sum(hit).alias("pred5"),
        F.avg(-F.when(F.col("g") == 1, F.ln(clipped)).otherwise(F.ln(1.0 - clipped))).alias("bce"),
    )
    n, pos, tp = F.col("tokens"), F.col("pos"), F.col("at.tp")
    neg = n - pos
    prec, rec = _ratio(tp, F.col("k")), _ratio(tp, pos)
    prec5, rec5 = _ratio(F.col("tp5"), F.col("pred5")), _ratio(F.col("tp5"), pos)
    both = lambda a, b: F.when(a + b == 0, F.lit(0.0)).otherwise(2 * a * b / F.when(a + b == 0, F.lit(1.0)).otherwise(a + b))
    return agg.select(
        n.alias("tokens"), (pos / n).alias("gold_rate"), F.col("target_rate"),
        F.coalesce(_ratio(F.col("ap"), pos), F.lit(0.0)).alias("pr_auc"),
        F.when((pos > 0) & (neg > 0), (F.col("rank_sum") - pos * (pos + 1) / 2) / F.when(pos * neg == 0, F.lit(1)).otherwise(pos * neg)).otherwise(F.lit(0.0)).alias("roc_auc"),
        F.col("best.f1").alias("best_f1"), F.col("best.thr").alias("best_f1_thr"),
        both(prec, rec).alias("f1_at_target"), prec.alias("prec_at_target"), rec.alias("rec_at_target"),
        ((tp + neg - (F.col("k") - tp)) / n).alias("accuracy_at_target"), F.col("at.p").alias("thr_at_target"), (F.col("k") / n).alias("pred_drop_rate"),
        both(prec5, rec5).alias("argmax_f1"), prec5.alias("argmax_prec"), rec5.alias("argmax_rec"), (F.col("pred5") / n).alias("argmax_drop_rate"), F.col("bce").alias("per_token_bce"),
    )


def numbered(rows: DataFrame, order: list[Column], name: str, add: str | None = None, total: str | None = None) -> DataFrame:
    """Adds the row's place in a global order, from 1, and the running sum of ``add``.

    Rows are dealt by ranges of the order and numbered in their range; the ranges' sizes, a
    row each, are summed and broadcast. The dealt rows are written once: ranges come from a
    sample, so that two executions may deal differently.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # sorted and numbered where they are dealt to: the number's high bits are the range, the low ones the place
    at = F.monotonically_increasing_id()
    dealt = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33).cast("int")))
    w = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    inside = dealt.withColumn(name, F.col("_at").bitwiseAND((1 << 33) - 1).cast("int") + 1)
    if add:
        inside = inside.withColumn(total, F.sum(add).over(w))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"), (F.sum(add) if add else F.lit(0)).alias("_s"))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    begins = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_s0"))
    out = inside.join(F.broadcast(begins), "_part").withColumn(name, F.col(name) + F.col("_n0"))
    if add:
        out = out.withColumn(total, F.col(total) + F.col("_s0"))
    return out.drop("_part", "_at", "_n0", "_s0")


#: Bins that a range of values is counted in at once.
RANK_BINS = 4_096


def value_at_rank(rows: DataFrame, column: str, rank: int) -> float:
    """The value at a rank, from 1, of the column's values in rising order; nulls have no rank.

    A range of values is counted in bins, and the bin with the rank becomes the range, until
    it is one value. No task sorts the column; ``rows`` should be cheap to read again.
    """
    x = F.col(column).cast("double")
    low, high, below = *rows.agg(F.min(x), F.max(x)).first(), 0
    while low < high:
        at = F.least(F.lit(RANK_BINS - 1), F.floor((x - low) / (high - low) * RANK_BINS))
        bins = rows.where(x.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).orderBy("bin").collect()
        for b in bins:
            if below + b.n >= rank:
                low, high = b.low, b.high
                break
            below += b.n
    return low
