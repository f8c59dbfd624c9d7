"""Registered queries cover their whole tables."""

from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import corpus, stats
from logloom.plans import registry


def test_every_node_is_described(spark, sf):
    queries = registry.queries()
    columns = ("node_id", "child_count", "total_tokens", "roles")
    nodes = queries["archive_nodes"](spark, sf)
    assert nodes.where("conv_id % 2 = 1").count() > 0
    assert sorted(queries["node_describe"](spark, sf).select(*columns).collect()) == sorted(nodes.select(*columns).collect())


def test_sample_packs_neighbours_at_every_size(spark, monkeypatch):
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04}")
    lines = {c: [f"{c} service {word(i)} handled its request" for i in range(n)] for c, n in (("x", 47), ("y", 8))}
    df = spark.createDataFrame([(c, i, x) for c in lines for i, x in enumerate(lines[c])], "corpus string, ord bigint, line string").repartition(7)
    whole = {c: corpus.sample(df.where(f"corpus = '{c}'"), 1_000, 1.0, 24)[0].orderBy("ord").collect() for c in lines}
    monkeypatch.setattr(corpus, "BLOCK", 10)
    for c in lines:
        got = [r.text.split("\n") for r in corpus.sample(df, 1_000, 1.0, 24)[0].where(f"corpus = '{c}'").orderBy("ord").collect()]
        assert sum(got, []) == lines[c]
        runs = [lines[c][i : i + 10] for i in range(0, len(lines[c]), 10)]
        size = len(whole[c][0].text.split("\n"))
        assert got == [run[i : i + size] for run in runs for i in range(0, len(run), size)]


def test_every_chunk_has_a_mask(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 12")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.chunk_id): (r.n_tokens, r.n_kept) for r in registry.queries()["derive_mask"](spark, str(tmp_path)).collect()}
    chunks = corpus.chunked(docs).select("doc_id", "chunk_id", F.size(T.word_tokens(F.col("text"))).alias("n")).collect()
    assert {k: n for k, (n, _) in got.items()} == {(r.doc_id, r.chunk_id): r.n for r in chunks}
    assert {i for i, _ in got} == {r.doc_id for r in docs.where("trim(text) <> ''").collect()}
    assert all(0 < kept <= n for n, kept in got.values())


def test_bootstrap_takes_all_resamples(spark, sf):
    rows = spark.read.parquet(f"{sf}/labels.parquet").select("toxic", (F.col("quality") == 1).alias("survived"))
    want = stats.bootstrap_ci(rows, "toxic", resamples=1000)
    assert sorted(registry.queries()["bootstrap_ci"](spark, sf).collect()) == sorted(want.collect())


def test_stream_reads_a_table_of_many_files(spark, sf, tmp_path):
    """A folder's own name was asked of its files, so that none was read."""
    spark.read.parquet(f"{sf}/conversations.parquet").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    queries, columns = registry.queries(), ("node_id", "child_count", "total_tokens", "roles", "child_turns")
    want = sorted(queries["archive_nodes"](spark, sf).select(*columns).collect())
    assert want and sorted(queries["archive_stream"](spark, str(tmp_path)).select(*columns).collect()) == want
