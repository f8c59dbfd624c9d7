"""Mixing overlapping sources to target weights by a min-cost flow."""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Cost of a word's first, second and third use: convex, so fresh words go first.
COSTS = (0, 1, 3)
SEED = "mix-1"
#: Patterns are kinds of membership, not documents; more of them raise.
MAX_PATTERNS = 5_000
DIGIT = 4_096
HASH_BITS = 60


def targets(sizes: dict, weights=WEIGHTS, most: int = REPEATS) -> dict:
    """Source to target: shares of all sizes by weight, none above ``most`` times its size.

    Sources go by code point, null last, and take the weights in turn. What a source can't
    take is shared among the others by weight, until none is above.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    rest, open_, out = Fraction(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: rest * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
        rest -= sum(out[s] for s in over)
        open_ -= set(over)
    return {s: out[s] for s in names}


def route(patterns: list[tuple[tuple, int]], quotas: dict, costs=COSTS) -> list[int]:
    """Words each pattern gives, by a min-cost max-flow from patterns to source quotas.

    ``patterns``: (its sources, its size). A pattern gives its size once at each cost of
    ``costs``, which must not fall. Augmenting paths of least cost are found by label
    correction, so earlier routes are changed where that spares repetition.
    """
    names = list(quotas)
    node = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    sink = 1 + len(patterns) + len(names)
    to, room, cost, out = [], [], [], [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)

    for i, (members, size) in enumerate(patterns):
        for c in costs:
            arc(0, 1 + i, size, c)
        for s in members:
            arc(1 + i, node[s], len(costs) * size, 0)
    for s in names:
        arc(node[s], sink, quotas[s], 0)
    while True:
        best, via, queue, waits = {0: 0}, {}, deque([0]), {0}
        while queue:
            x = queue.popleft()
            waits.discard(x)
            for e in out[x]:
                if room[e] and best[x] + cost[e] < best.get(to[e], 1 << 60):
                    best[to[e]], via[to[e]] = best[x] + cost[e], e
                    if to[e] not in waits:
                        waits.add(to[e])
                        queue.append(to[e])
        if sink not in best:
            break
        path, x = [], sink
        while x:
            path.append(via[x])
            x = to[via[x] ^ 1]
        n = min(room[e] for e in path)
        for e in path:
            room[e] -= n
            room[e ^ 1] += n
    given = [0] * len(patterns)
    for i in range(len(patterns)):
        given[i] = sum(room[e ^ 1] for e in out[0] if to[e] == 1 + i)
    return given


def hashed(id_col: Column, text: Column, seed: str = SEED) -> Column:
    """The seeded 60-bit place of a document: equal for rows equal in id and text only."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def members(source: Column, is_array: bool) -> Column:
    """The membership pattern as text: the sorted distinct sources, null among them last."""
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(source, F.array(F.lit(None).cast("string"))))) if is_array else F.array(source.cast("string")))


def thresholds(rows: DataFrame, wanted: dict[str, int]) -> dict[str, int]:
    """Pattern to the hash up to which documents are taken, sizes summing nearest to ``wanted``.

    Digit by digit of the hash, from the most significant: sizes are summed by pattern and
    digit, at most ``DIGIT`` sums a pattern, and the digit where the sum is reached is opened.
    No task or driver ever holds a pattern's documents. Documents of one hash go together.
    """
    below = dict.fromkeys(wanted, -1)  # the greatest hash known to be taken
    left, prefix, shift = dict(wanted), dict.fromkeys(wanted, 0), HASH_BITS
    active = {p for p, n in wanted.items() if n > 0}
    while shift and active:
        shift -= DIGIT.bit_length() - 1
        opened = F.broadcast(rows.sparkSession.createDataFrame([(p, prefix[p]) for p in sorted(active)], "p string, own long"))  # at most ``MAX_PATTERNS``
        under = (F.col("pattern") == F.col("p")) & (F.shiftrightunsigned("hash", shift + DIGIT.bit_length() - 1) == F.col("own"))
        digit = F.shiftrightunsigned("hash", shift)
        sums = rows.join(opened, under, "left_semi").groupBy("pattern", digit.alias("digit")).agg(F.sum("size").alias("n")).where("n > 0").collect()
        by: dict[str, list] = {p: [] for p in active}
        for r in sums:
            by[r.pattern].append((r.digit, r.n))
        for p in list(active):
            for d, n in sorted(by[p]):
                if n > left[p]:
                    prefix[p] = d
                    if not shift and 2 * left[p] >= n:  # one document, or equal ones: the nearer side
                        below[p] = d
                    break
                left[p] -= n
                below[p] = (d + 1 << shift) - 1
                if not left[p]:
                    active.discard(p)
                    break
            else:
                active.discard(p)
    return below


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, costs=COSTS, seed: str = SEED) -> tuple[DataFrame, DataFrame, dict]:
    """(rows, plan, targets): the sized rows, checkpointed, and what is taken of each pattern.

    The plan has a row a pattern: pattern, reps (copies of every document) and upto (the
    hash up to which documents get one copy more).
    """
    spark = docs.sparkSession
    is_array = docs.schema[source_col].dataType.typeName() == "array"
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), members(F.col(source_col), is_array).alias("pattern"), word_count(F.col(text_col)).alias("size"), hashed(F.col(id_col), F.col(text_col), seed).alias("hash")))
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.from_json(F.col("pattern"), "array<string>").alias("sources")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found = sorted(((r.pattern, tuple(r.sources), r["size"]) for r in found), key=lambda x: x[0])
    sizes: dict = {}
    for _, own, n in found:
        for s in own:
            sizes[s] = sizes.get(s, 0) + n
    aims = targets(sizes, weights, len(costs)) if len(found) == len(sizes) and all(len(own) == 1 for _, own, _ in found) else shared_targets(sizes, sum(n for *_, n in found), weights, len(costs))
    given = route([(own, n) for _, own, n in found], {s: round(t) for s, t in aims.items()}, costs)
    reps = {p: g // n if n else 0 for (p, _, n), g in zip(found, given, strict=True)}
    upto = thresholds(rows, {p: g % n if n else 0 for (p, _, n), g in zip(found, given, strict=True)})
    return rows, table(spark, [(p, reps[p], upto[p]) for p, *_ in found]), {"targets": aims, "sizes": sizes}


def shared_targets(sizes: dict, total: int, weights, most: int) -> dict:
    """Targets where sources overlap: shares of the words there are, not of their double count."""
    scale = Fraction(total, max(1, sum(sizes.values())))
    return {s: t * scale for s, t in targets(sizes, weights, most).items()}


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The plan, a row a pattern, at most ``MAX_PATTERNS``: small enough to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, "pattern string, reps long, upto long"))


def copies(pattern_hash: DataFrame, plan_table: DataFrame) -> DataFrame:
    """``pattern_hash`` (pattern, hash, ...) with the number of copies the mix takes."""
    return pattern_hash.join(plan_table, "pattern").withColumn("copies", F.col("reps") + F.when(F.col("hash") <= F.col("upto"), 1).otherwise(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies.

    source_size and target are those of the row's source (of an array's first source). Whole
    documents are taken, at most three times; a source misses its target by half a document
    (rows equal in id and text are one here), or by what its documents can't supply. Null
    texts have no words; null is a source like any other. Reruns agree. No rows: no rows.
    """
    rows, plan_table, known = plan(docs, id_col, text_col, source_col)
    aims = [(s, int(known["sizes"][s]), float(t)) for s, t in known["targets"].items()]
    by_source = F.broadcast(docs.sparkSession.createDataFrame(aims, "s string, source_size long, target double"))
    out = copies(rows, plan_table).withColumn("first", F.from_json("pattern", "array<string>")[0])
    return out.join(by_source, F.col("first").eqNullSafe(F.col("s")), "left").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    _, plan_table, _ = plan(docs, id_col, text_col, source_col)
    is_array = docs.schema[source_col].dataType.typeName() == "array"
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), members(F.col(source_col), is_array).alias("pattern"), hashed(F.col(id_col), F.col(text_col)).alias("hash"))
    taken = copies(keyed, plan_table).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return taken.select("doc.*")


#: For single sources: the flow gives each its rounded target, whole repeats come first, and
#: of the rest documents are taken by hash while their sizes fit, the next one if that is nearer.
ORACLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')))[1:15])::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM docs GROUP BY source),
total AS (SELECT sum(source_size)::DOUBLE AS n FROM sources),
ordered AS (
  SELECT source, source_size, weight, 3.0 * source_size / weight AS full_at,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM sources),
level AS (SELECT (n - capped) / open_weight AS share FROM ordered, total WHERE full_at >= (n - capped) / open_weight ORDER BY full_at, source NULLS LAST LIMIT 1),
aims AS (SELECT source, source_size, least(3.0 * source_size, weight * share)::DOUBLE AS target FROM ordered, level),
quotas AS (
  SELECT *, least(round_even(target, 0)::BIGINT, 3 * source_size) AS quota,
         CASE WHEN source_size = 0 THEN 0 ELSE least(round_even(target, 0)::BIGINT, 3 * source_size) // source_size END AS reps
  FROM aims),
placed AS (
  SELECT d.doc_id, d.size, d.hash, q.source_size, q.target, q.reps, q.quota - q.reps * q.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.hash) AS own
  FROM docs d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       size * (reps + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own < rest AND 2 * (rest - (upto - own)) >= own)) THEN 1 ELSE 0 END) AS taken,
       reps + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own < rest AND 2 * (rest - (upto - own)) >= own)) THEN 1 ELSE 0 END AS copies
FROM placed
"""
