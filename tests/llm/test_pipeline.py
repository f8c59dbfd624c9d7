"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

from . import models as M


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    extra = spark.createDataFrame([(10_000 + i, t, "en", "src0", 3) for i, t in enumerate([None, "", "123 456", "!!"])], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(extra)
    docs = docs.unionByName(docs.where("doc_id % 50 = 0"))  # rows that repeat whole
    docs.write.parquet(str(base / "in"))
    tables = [spark.read.parquet(str(base / "in"))]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, tables[-1], sf).write.parquet(str(base / str(k)))
        tables.append(spark.read.parquet(str(base / str(k))))
    return tables


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_columns(stages):
    assert all(t.columns == stages[0].columns for t in stages[:-1])


def test_language(stages):
    before, after = Counter(rows(stages[0])), Counter(rows(stages[1]))
    assert not after - before
    gone = [r for r in (before - after).elements()]
    assert {r[0] for r in gone} >= {10_000, 10_001, 10_002, 10_003}
    assert sum(r[0] < 10_000 for r in gone) <= 2


def test_exact(stages):
    before, after = rows(stages[1]), rows(stages[2])
    best = {}
    for r in before:
        best[r[1]] = max(best.get(r[1], -1), r[0])
    assert sorted((r[1], r[0]) for r in after) == sorted(best.items())


def test_near(stages):
    from .test_shingles import shingles, similar

    before, after = rows(stages[2]), rows(stages[3])
    sets = [shingles(r[1]) for r in before]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for own in holders.values() for b in own for a in own if a < b}
    groups = M.components([(a, b) for a, b in pairs if similar(sets[a], sets[b])], range(len(sets)))
    least = {}
    for i, r in enumerate(before):
        least[groups[i]] = min(least.get(groups[i], r[0]), r[0])
    assert sorted(r[0] for r in after) == sorted(least.values())


def test_mixing(stages):
    from logloom.llm.op6_mixing import mix

    want = {r.doc_id: r.copies for r in mix(stages[3]).collect()}
    assert Counter(r[0] for r in rows(stages[4])) == Counter({i: n for i, n in want.items() if n})


def test_encoding(stages):
    import hashlib

    import numpy as np

    got = {r.doc_id: r for r in stages[5].collect()}
    assert stages[5].count() == stages[4].count()
    for r in stages[4].collect():
        g = got[r.doc_id]
        assert g.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and g.n_tokens == len(g.ids)
        assert g.ids_sha256 == hashlib.sha256(np.array(g.ids, "<u4").tobytes()).hexdigest()


def test_near_dedup_keeps_one_of_repeated_ids(spark, sf, tmp_path):
    d = M.table(spark, ["one two three four"] * 3 + ["five"], ids=[1, 1, 2, 1]).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(str(tmp_path / "d"))
    out = P.near_dedup(spark, spark.read.parquet(str(tmp_path / "d")), sf)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "five"), (1, "one two three four")]


def test_empty_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.lit(False))
    docs.write.parquet(str(tmp_path / "0"))
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, spark.read.schema(docs.schema).parquet(str(tmp_path / str(k))) if k == 0 else spark.read.parquet(str(tmp_path / str(k))), sf).write.parquet(str(tmp_path / str(k + 1)))
    assert spark.read.parquet(str(tmp_path / str(len(P.STAGES)))).count() == 0


#: Names that operators use for columns of their own.
CLASHING = ("key", "left", "stays", "root", "node", "k", "h", "s", "n", "truth", "row", "copies", "doc", "pattern", "hash", "__pipeline_key", "__pipeline_keyk", "digest")


def test_columns_of_any_name(spark, sf, tmp_path):
    texts = ["the same words in here", "the same words in here", None, "", "one two three four five six", "1234", "another text with several words"]
    d = M.table(spark, texts, ids=[1, 2, 3, 4, 5, 6, None]).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    d = d.unionByName(d.where("doc_id = 5"))
    d.write.parquet(str(tmp_path / "0"))
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, spark.read.parquet(str(tmp_path / str(k))), sf).write.parquet(str(tmp_path / str(k + 1)))
        out = spark.read.parquet(str(tmp_path / str(k + 1)))
        assert k == len(P.STAGES) - 1 or (out.columns == d.columns and all(r[c] == i for r in out.collect() for i, c in enumerate(CLASHING)))
    left = [r.doc_id for r in spark.read.parquet(str(tmp_path / "3")).collect()]
    assert sorted(left, key=str) == [2, 5, None]


def test_language_equals_the_operator(spark, stages):
    """The rows that go are those that the language operator rejects, whatever else is equal in them."""
    from logloom.llm.op4_language import languages

    gone = {r.doc_id for r in languages(stages[0]).where("rejected").collect()}
    assert Counter(rows(stages[1])) == Counter(r for r in rows(stages[0]) if r[0] not in gone)


def test_mixing_meets_its_targets(stages):
    """Sizes, targets and copies by plain counting."""
    from logloom.llm.op6_mixing import targets

    before, after = rows(stages[3]), Counter(r[0] for r in rows(stages[4]))
    words = {r[0]: len(M.WORD.findall(r[1] or "")) for r in before}
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r[3]] += words[r[0]]
        taken[r[3]] += words[r[0]] * after[r[0]]
    assert max(after.values()) <= 3
    for s, t in targets(sizes).items():
        assert abs(taken[s] - t) <= max(words[r[0]] for r in before if r[3] == s) / 2 + 1


def test_encoding_equals_the_library(stages):
    from .test_layout import TIK

    texts = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].collect():
        assert r.ids == TIK.encode_ordinary(texts[r.doc_id])


def test_run_leaves_its_last_output_only(spark, sf):
    import os

    from logloom.session import shared_dir

    shared = shared_dir(spark)
    before = set(os.listdir(shared))
    checkpoints = lambda: {d for top in os.listdir(shared) if os.path.isdir(f"{shared}/{top}") and not top.startswith(("pipeline", "token", "ware")) for d in os.listdir(f"{shared}/{top}")}
    had = checkpoints()
    assert P.run(spark, sf).count() > 0
    made = [d for d in os.listdir(shared) if d not in before and d.startswith("pipeline-")]
    assert len(made) == 1 and os.listdir(f"{shared}/{made[0]}") == [str(len(P.STAGES) - 1)]
    assert not checkpoints() - had


def test_no_shared_folder_raises_on_a_cluster(monkeypatch):
    from logloom import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {"spark.checkpoint.dir": None}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_stages_begin_with_a_collected_heap(spark, sf):
    """What earlier stages left on the heap doesn't stand beside the workers of the next one."""
    beans = list(spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    whole = [b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = sum(b.getCollectionCount() for b in whole)
    P.encoding(spark, docs, sf)  # a plan only
    assert sum(b.getCollectionCount() for b in whole) > before
