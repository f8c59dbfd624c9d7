"""Near and exact duplicates, components."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.llm import op2_simhash as near
from logloom.llm import op9_exact as exact
from logloom.llm.components import connected_components

from . import models as M


def test_fingerprint_equals_model():
    for t in M.TEXTS:
        got = near.fingerprint((t or "").encode())
        assert got % (1 << 64) == M.fingerprint(t)


def test_near_duplicates(spark):
    rows = near.near_duplicates(M.table(spark)).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert len(rows) == len(M.TEXTS) and all(len(r.fingerprint) == 16 for r in rows)
    assert prints == {i: M.fingerprint(t) for i, t in enumerate(M.TEXTS)}
    assert {r.doc_id: r.component_id for r in rows} == M.near_groups(list(prints), list(prints.values()))


def flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def test_links_are_all_pairs_within_two_bits(spark):
    """Dense families of fingerprints: chains, balls, and all distances up to four."""
    rng = random.Random(9)
    fps = {0, (1 << 64) - 1, 1 << 63, 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        fps.add(x)
        fps.update(flipped(rng, x, n) for n in (1, 1, 2, 2, 3, 4))
        for _ in range(6):
            x = flipped(rng, x, 2)
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in near.links(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()}
    want = {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    assert {frozenset(p) for p in got} == want


def test_embedding_bounds_the_distance(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(63) for _ in range(40)]
    rows = spark.createDataFrame([(f,) for f in fps], "fp bigint").select("fp", near.embedding(F.col("fp")).alias("v")).collect()
    for r in rows:
        assert [(r.v >> 2 * i & 3) for i in range(32)] == [(r.fp >> 2 * i & 1) + (r.fp >> 2 * i + 1 & 1) for i in range(32)]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (3, 4), (4, 3), (None, 5)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [e for e in edges if None not in e]
    assert got == M.components(real, {n for e in real for n in e})
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_exact_groups(spark):
    rows = exact.exact_groups(M.table(spark)).collect()
    by = {}
    for i, t in enumerate(M.TEXTS):
        by.setdefault(t or "", []).append(i)
    assert len(rows) == len(M.TEXTS)
    for r in rows:
        own = by[M.TEXTS[r.doc_id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlucmwfgyp") for _ in range(rng.randrange(1, 10))) for _ in range(n))


def test_exact_groups_of_long_texts_by_chunks(spark):
    rng = random.Random(6)
    base = prose(rng, 12_000)
    texts = [base, base, base + " ", " " + base, base[:9000] + "z" + base[9001:], "q" * 30000, "q" * 30000, "q" * 30001]
    cut = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", exact.chunks(F.col("t")).alias("c")).collect()
    assert all("".join(r.c) == texts[r.i] and len(r.c) > 1 for r in cut)
    rows = {r.doc_id: r for r in exact.exact_groups(M.table(spark, texts)).collect()}
    assert [rows[i].group_size for i in range(8)] == [2, 2, 1, 1, 1, 2, 2, 1]


def test_cuts_follow_the_content(spark):
    """After a prefix of any length nearly all chunks are the same ones."""
    rng = random.Random(7)
    bases = [prose(rng, 12_000), "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(20_000))]
    for base in bases:
        texts = [base] + [prose(rng, n)[:n] + base for n in (1, 37, 100, 300, 1000)]
        first, *others = [r.c for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(exact.chunks(F.col("t")).alias("c")).collect()]
        assert all(len(set(first) & set(c)) > 0.9 * len(first) for c in others)
        assert all(len(c) <= exact.MOST for c in first) and len(base.encode()) / len(first) < 3000


def test_exact_groups_survive_a_weak_digest(spark):
    weak = lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 1).cast("string"))  # noqa: E731  16 values
    texts = [f"text number {i % 40}" for i in range(60)]
    rows = exact.exact_groups(M.table(spark, texts), name=weak).collect()
    assert {r.doc_id: r.group_size for r in rows} == {i: texts.count(t) for i, t in enumerate(texts)}


def test_one_of_repeated_rows_is_kept(spark):
    d = M.table(spark, ["same", "same", "same", "other"], ids=[5, 5, 5, 5])
    rows = exact.exact_groups(d).collect()
    assert sum(r.kept for r in rows) == 2 and {r.keep_id for r in rows} == {5}


@pytest.mark.parametrize("op", [near.near_duplicates, exact.exact_groups])
def test_null_ids_and_empty_tables(spark, op):
    d = M.table(spark, ["x y z", "x y z", "w"], ids=[None, 4, None])
    assert op(d).count() == 3
    assert op(d.limit(0)).count() == 0
