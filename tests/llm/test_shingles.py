"""Near copies of the pipeline against brute force: five words, a Jaccard similarity of 0.8."""

import random

import xxhash

import corpus_pipeline as P
from logloom.llm import op2_simhash

from . import models as M


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_near_copies(spark, sf, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]  # in many texts that aren't copies
    texts = ["", " ", "One two", "one  two", "one two three four five", "one two three four six"]
    for n in (9, 30, 60, 200):
        base = [word() for _ in range(n)]
        for _ in range(12):  # a chain of edits, so that ends are linked through others only
            texts.append(" ".join(base))
            for _ in range(max(1, n // 60)):
                base[rng.randrange(n)] = word()
        texts += [" ".join(passage + [word() for _ in range(n)]) for _ in range(12)]
    rng.shuffle(texts)
    M.table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "d"))
    out = P.near_dedup(spark, spark.read.parquet(str(tmp_path / "d")), sf)
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if similar(sets[a], sets[b])]
    groups = M.components(pairs, range(len(sets)))
    assert len(pairs) > 20 and any(not similar(sets[i], sets[g]) for i, g in groups.items())
    assert sorted(r.doc_id for r in out.collect()) == [i for i in groups if groups[i] == i]


def test_rows_that_repeat_often(spark, sf, tmp_path):
    """Rows the same in every column cost no more than their number: one of them stands for all."""
    texts = ["one two three four five six seven"] * 400 + ["one two three four five six seven eight nine ten"] * 3 + ["one two three four five six seven eight"]
    d = M.table(spark, texts, ids=[7] * 400 + [8] * 3 + [9]).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(str(tmp_path / "d"))
    out = P.near_dedup(spark, spark.read.parquet(str(tmp_path / "d")), sf).collect()
    sets = [shingles(t) for t in dict.fromkeys(texts)]
    groups = M.components([(a, b) for b in range(3) for a in range(b) if similar(sets[a], sets[b])], range(3))
    assert sorted(r.doc_id for r in out) == sorted({min(i for i, g in zip((7, 8, 9), groups.values(), strict=True) if g == root) for root in set(groups.values())})


def fingerprint(text):
    """SimHash of five-word shingles, repeats included, by counting votes."""
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), 42) for i in range(max(1, len(words) - 4))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_give_candidates(spark, sf, tmp_path, monkeypatch):
    """The stage makes SimHash fingerprints of five words, and the grid joins them to every near pair."""
    rng = random.Random(6)
    texts = ["", "one two three", "one  two three"]
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for _ in range(4):  # a word more at the end changes few bits
            texts.append(" ".join(base))
            base.append(f"w{rng.randrange(10**6)}")
    M.table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "d"))
    seen, plain = [], op2_simhash.links

    def grid(prints, count=None):
        found = plain(prints, count)
        seen.append(({r.fp % 2**64 for r in prints.collect()}, {(r.a % 2**64, r.b % 2**64) for r in found.collect()}))
        return found

    monkeypatch.setattr(op2_simhash, "links", grid)
    P.near_dedup(spark, spark.read.parquet(str(tmp_path / "d")), sf).collect()
    ((prints, pairs),) = seen
    want = {fingerprint(t) for t in texts}
    assert prints == want
    near = {frozenset((a, b)) for a in want for b in want if 0 < (a ^ b).bit_count() <= 2}
    assert near and {frozenset(p) for p in pairs} == near


def test_candidates_hold_groups_of_equal_fingerprints(spark):
    from logloom.llm.shingles import by_fingerprints

    rows = spark.createDataFrame([(0, 7), (1, 7), (2, 7), (3, 6), (4, 6), (5, 5), (6, 1 << 40 | 0xFF)], "k bigint, f bigint")
    pairs = {(r.a, r.b) for r in by_fingerprints(rows, op2_simhash.links).collect()}
    assert pairs == {(0, 1), (0, 2), (3, 4), (0, 3), (0, 5), (3, 5)}


def test_many_partitions_leave_few_files(spark, sf, tmp_path):
    """Steps over small tables don't fill the disk with a file for each of their partitions."""
    import os
    import time

    from logloom.session import shared_dir

    rng = random.Random(7)
    texts = [f"w{i} a b c" for i in range(4)]
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(12):
            texts.append(" ".join(base))
            base[rng.randrange(60)] = f"w{rng.randrange(10**6)}"
    M.table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "d"))
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        shuffles = {x for d in disk.localDirs() for _, _, names in os.walk(d.getPath()) for x in names if x.startswith("shuffle_")}
        return shuffles | {f"{d}/{x}" for d, _, names in os.walk(shared_dir(spark)) for x in names if x.startswith("part-")}

    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        before = files()
        out = P.near_dedup(spark, spark.read.parquet(str(tmp_path / "d")), sf)
        sets = [shingles(t) for t in texts]
        groups = M.components([(a, b) for b in range(len(sets)) for a in range(b) if similar(sets[a], sets[b])], range(len(sets)))
        assert sorted(r.doc_id for r in out.collect()) == [i for i in groups if groups[i] == i]
        time.sleep(2)  # shuffle files are deleted in the background
        made = files() - before
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(made) < 40 * 30


def test_tables_go_with_their_work(spark):
    import os

    import pytest

    from logloom.session import Tables

    with pytest.raises(ZeroDivisionError), Tables(spark) as tables:
        table = tables.put(spark.createDataFrame([(1, [2], None), (None, None, "x")], "a bigint, b array<bigint>, c string"))
        none = tables.put(table.where("a > 1"))
        assert sorted(table.collect(), key=str) == [(1, [2], None), (None, None, "x")]
        assert none.count() == 0 and none.columns == ["a", "b", "c"] and len(os.listdir(tables.base)) == 2
        1 / 0  # noqa: B018
    assert not os.path.exists(tables.base)
