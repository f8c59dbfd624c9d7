"""Work on a text in its row: the same as by rows of tokens, with nothing shuffled, in even tasks."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import spans as S
from logloom.functions import text as T
from logloom.operators import decode, facts, methods
from logloom.plans import inputs, registry


def texts(n=80):
    rng = random.Random(3)
    words = ["ERROR", "10.0.0.1", "é", "straße", "disk", "request_id=a1", "(full)", "的", "\n", "", "x", " "]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", "", "\t", "\u2028"]) for _ in range(rng.randrange(0, 40))) for _ in range(n)] + ["", None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string").repartition(3)


def scored(docs):
    prob = lambda n, i: ((n * 37 + i * 61) % 7) / 7.0  # noqa: E731  many ties
    rows = decode.locked(docs, S.match_rows(docs, facts.STRUCTURAL)).withColumn("prob", prob(F.length("token"), F.col("i")))
    arrays = docs.where(F.length("text") > 0).select("doc_id", T.word_tokens(F.col("text")).alias("t"), S.parts_of(F.col("text"), facts.STRUCTURAL).alias("parts"))
    return rows, arrays.withColumn("prob", F.transform("t", lambda x, i: prob(F.length(x), i)))


@pytest.mark.parametrize("by, reduce, rate", [("word", "max", 0.4), ("chunk:4", "max", 0.7), ("word", "min", 0.5), ("token", "mean", 0.3), ("word", "mean", 1.0)])
def test_decoding_in_the_row_equals_rows(docs, by, reduce, rate):
    rows, arrays = scored(docs)
    want = decode.rebuilt(decode.span_decode(rows, rate, by, reduce)).collect()
    got = arrays.select("doc_id", decode.span_decoded(F.col("t"), F.col("prob"), F.col("parts"), rate, by, reduce).alias("m")).select("doc_id", "m.*").collect()
    assert sorted((r.doc_id, r.compressed, r.n_in, r.n_out) for r in got) == sorted((r.doc_id, r.compressed, r.n_in, r.n_out) for r in want)


def test_flags_in_the_row_equal_rows(docs):
    rows, arrays = scored(docs)
    want = sorted((r.doc_id, r.i, r.dropped) for r in decode.top_k_drop(rows, 0.3).select("doc_id", "i", "dropped").collect())
    got = arrays.select("doc_id", F.posexplode(decode.drop_flags(F.col("t"), F.col("prob"), F.col("parts"), 0.3)).alias("i", "dropped")).collect()
    assert sorted(map(tuple, got)) == want
    key = lambda df: sorted((r.doc_id, r.i, r.s, r.e, r.locked) for r in df.collect())
    assert key(decode.locked(docs, S.parts_of(F.col("text"), facts.STRUCTURAL))) == key(rows)


def test_span_numbers_in_the_row_equal_rows(docs):
    rows, arrays = scored(docs)
    for by in ("word", "chunk:4", "token"):
        want = decode.groups(rows, by)
        got = arrays.select("doc_id", F.posexplode(decode.group_numbers(F.col("t"), by)).alias("i", "g"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("doc_id", "i", "g").collect()))
        sizes = arrays.select("doc_id", F.posexplode(decode.group_sizes(F.col("t"), by)).alias("g", "n"))
        assert sorted(map(tuple, sizes.collect())) == sorted(map(tuple, want.groupBy("doc_id", "g").count().collect()))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("name, most", [
    ("survival_random", 2), ("survival_by_fact_type", 2), ("domain_survival", 2), ("method_random_floor", 1), ("topk_drop", 1), ("chunk_groups", 1),
    ("span_decode_word", 1), ("span_decode_min", 1), ("span_decode_chunk", 1), ("lock_mask_word", 1),
])
def test_tokens_are_not_shuffled(spark, sf, name, most):
    """A deal of the table's rows, and of totals where there are any."""
    assert exchanges(registry.queries()[name](spark, sf)) <= most


def test_one_row_group_of_many_splits_is_dealt(spark, tmp_path):
    spark.range(0, 40_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).write.parquet(str(tmp_path / "t.parquet"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = spark.read.parquet(str(tmp_path / "t.parquet"))
        assert rows.rdd.getNumPartitions() > 8
        for key in (None, "x"):
            sizes = [r["n"] for r in inputs.spread(rows, key).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
            assert sum(sizes) == 40_000 and max(sizes) < 15_000
        rows.repartition(16).write.parquet(str(tmp_path / "even.parquet"))
        even = spark.read.parquet(str(tmp_path / "even.parquet"))
        assert inputs.spread(even) is even
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_crc_of_many_places(spark):
    text = " ".join("ab" for _ in range(1_200))
    r = spark.createDataFrame([(0, text)], "doc_id int, text string")
    toks = decode.tokens(r).orderBy("i").collect()
    import zlib

    seed = zlib.crc32(text.encode())
    order = sorted(range(len(toks)), key=lambda i: (zlib.crc32(f"{seed}:{i}".encode()), i))
    gone = set(order[: round(0.5 * len(toks))])
    assert methods.random_drop(r, 0.5).first().compressed == "".join(x.token for x in toks if x.i not in gone)


def test_chunks_are_made_in_their_row(spark, sf):
    """Units were shuffled to chunks and chunks to their places; one deal of chunks to the cores stays."""
    assert exchanges(registry.queries()["chunk_texts"](spark, sf)) <= 1
    assert exchanges(registry.queries()["derive_mask"](spark, sf)) <= 2


def test_places_are_numbered_where_rows_are_dealt_to(spark):
    from logloom.operators import stats

    rows = spark.createDataFrame([(k * 7919 % 1_000, k) for k in range(1_000)], "x int, k int")
    out = stats.numbered(rows, [F.col("x")], "place")
    assert exchanges(out.drop("place")) <= 2  # of the ranges' sizes alone
    assert sorted((r.x, r.place) for r in out.collect()) == [(x, x + 1) for x in range(1_000)]


def test_keys_of_lines_without_digits_or_long_runs(spark):
    import re

    lines = ["plain words only", "deadbeefdeadbeefab rest", "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee", "qxzkvbnmwrtplkjh ends", "٣ at", "abc123def456ghi789 x", "short a1b2", ""]
    got = [r.k for r in spark.createDataFrame(list(enumerate(lines)), "i int, line string").orderBy("i").select(T.mask_random(T.normalize_line(F.col("line"))).alias("k")).collect()]
    assert got[0] == lines[0] and got[7] == "" and got[1].startswith("<HEX>") and got[2] == "<UUID>" and got[4] == "<NUM> at" and got[6] == "short a1b2"
    assert [re.sub("<RAND>", "", k) for k in (got[3], got[5])] == [" ends", " x"]
