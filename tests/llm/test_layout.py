"""Licences, sharding, mixing, token files and BPE."""

import base64
import hashlib
import os
import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logloom.llm import op1_licences, op5_sharding, op6_mixing, op7_token_files, op8_bpe
from logloom.llm.queries import oracle_sql, queries

from ..oracle import compare, connect
from . import models as M


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, sf, name):
    compare(spark, connect(sf), queries()[name], oracle_sql()[name], sf)


# --- licences -----------------------------------------------------------------------------


def test_licences(spark):
    mit = "MIT License\n\n" + op1_licences._MIT
    texts = [mit, "  " + mit.upper().replace("SUBLICENSE", "SUB-LICENSE"), "MIT Licence\nCopyright (c) 2020 Someone\n" + mit.split("\n", 1)[1], mit + " and more", "some text\nReleased under the MIT Licence!\nCopyright 2021 A\nLicensed under the Apache Licence, version 2.0", None, "", "© all"]
    rows = {r.doc_id: r for r in op1_licences.scan_licences(M.table(spark, texts)).collect()}
    assert [rows[i].licence for i in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, None]
    assert rows[4].line_licences == "Apache-2.0,MIT" and rows[5].line_licences == ""
    assert op1_licences.scan_licences(M.table(spark).limit(0)).count() == 0


def test_whole_licences_however_wrapped_and_titled(spark):
    texts, names = [], []
    for name, titles, text in op1_licences.WHOLE:
        for width in (40, 72, 1000):
            body = "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
            texts += [body, f"{titles[0]}\n\nCopyright (c) 1999-2020, A. Person\nAll rights reserved.\n\n{body}\n", f"  {titles[-1].upper()}\n© 2020 A\n{body}"]
            names += [name] * 3
    for path, name in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("MPL-2.0", "MPL-2.0")):
        if os.path.exists(f"/usr/share/common-licenses/{path}"):
            texts.append(open(f"/usr/share/common-licenses/{path}", encoding="utf-8").read())
            names.append(name)
    texts += [texts[0] + " and more", texts[0][:-20]]
    rows = {r.doc_id: r.licence for r in op1_licences.scan_licences(M.table(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == [*names, None, None]


def test_licences_of_repeated_rows(spark):
    d = M.table(spark, ["Licensed under CC BY 4.0.\nLicensed under the MIT License.", "x", "x"], ids=[1, 1, None])
    rows = sorted((r.line_licences, r.licence) for r in op1_licences.scan_licences(d.unionByName(d)).collect())
    assert rows == [("", None)] * 4 + [("CC-BY-4.0,MIT", None)] * 2


# --- sharding -----------------------------------------------------------------------------


def test_sharding(spark):
    texts = [f"text {i % 70} " + "y" * (i % 9) for i in range(900)] + M.TEXTS
    rows = op5_sharding.shard(M.table(spark, texts)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 24)
    by = Counter(r.shard for r in rows)
    assert set(by) == set(range(24)) and max(by.values()) < 3 * min(by.values())
    for s in by:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(by[s]))
    moved = sum(r.grown_shard == 24 for r in rows)
    assert 0 < moved < 3 * len(rows) / 25
    assert {r.doc_id: r.shard for r in op5_sharding.shard(M.table(spark, texts[:50])).collect()} == {r.doc_id: r.shard for r in rows if r.doc_id < 50}


def test_sharding_hot_row_and_weights(spark, monkeypatch):
    monkeypatch.setattr(op5_sharding, "PIECE", 7)
    monkeypatch.setattr(op5_sharding, "RUN", 20)
    d = M.table(spark, ["hot"] * 50 + ["cold"] * 30, ids=[9] * 50 + list(range(100, 129)) + [None])
    rows = op5_sharding.shard(d, 3).collect()
    assert len(rows) == 80 and len({r.shard for r in rows if r.doc_id == 9}) == 1
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    many = spark.range(4000).select(op5_sharding.rendezvous(F.col("id"), [3.0, 1.0, 0.0]).alias("s")).groupBy("s").count().collect()
    count = {r.s: r["count"] for r in many}
    assert 2 not in count and 2.6 < count[0] / count[1] < 3.4
    assert op5_sharding.shard(d.limit(0), 3).count() == 0


# --- mixing -------------------------------------------------------------------------------


def test_targets_stop_and_reshare():
    t = op6_mixing.targets({"a": 10, "b": 100, None: 100, "c": 0})
    assert t["a"] == 30 and t["c"] == 0 and sum(t.values()) == 210
    assert t["b"] * 5 == t[None] * 2  # b has weight 2, null the fourth, 5
    assert op6_mixing.targets({}) == {}


def flow_model(patterns, quotas):
    """The most words that patterns can give, and the least cost, by brute force over small cases."""
    best = (0, 0)

    def go(k, left, given, cost):
        nonlocal best
        if k == len(patterns):
            if (given, -cost) > (best[0], -best[1]):
                best = (given, cost)
            return
        members, size = patterns[k]
        for total in range(3 * size + 1):
            c = min(total, size) * 0 + max(0, min(total - size, size)) + 3 * max(0, total - 2 * size)
            for first in range(total + 1) if len(members) > 1 else [total]:
                use = dict(left)
                use[members[0]] -= first
                if len(members) > 1:
                    use[members[1]] -= total - first
                if min(use.values()) >= 0:
                    go(k + 1, use, given + total, cost + c)

    go(0, quotas, 0, 0)
    return best


def test_flow_is_least_cost():
    rng = random.Random(8)
    for _ in range(25):
        patterns = [(("a",), rng.randrange(4)), (("b",), rng.randrange(4)), (("a", "b"), rng.randrange(4))]
        quotas = {"a": rng.randrange(9), "b": rng.randrange(9)}
        given = op6_mixing.route(patterns, quotas)
        cost = sum(max(0, min(g - n, n)) + 3 * max(0, g - 2 * n) for g, (_, n) in zip(given, patterns, strict=True))
        assert (sum(given), cost) == flow_model(patterns, quotas)


def test_mix(spark):
    rng = random.Random(5)
    texts = ["w " * rng.randrange(1, 60) for _ in range(600)] + M.TEXTS
    d = M.table(spark, texts, source=lambda i: None if i % 11 == 0 else "hot" if i % 2 else f"s{i % 4}")
    rows = op6_mixing.mix(d).collect()
    assert len(rows) == len(texts)
    words = {i: len(M.WORD.findall(t or "")) for i, t in enumerate(texts)}
    source = {r.doc_id: r.source for r in d.collect()}
    sizes = Counter()
    for i, n in words.items():
        sizes[source[i]] += n
    aims, taken = op6_mixing.targets(sizes), Counter()
    for r in rows:
        assert r.size == words[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and abs(r.target - float(aims[source[r.doc_id]])) < 1e-6
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    biggest = max(words.values())
    assert all(abs(taken[s] - aims[s]) <= biggest / 2 + 1 for s in aims)
    assert sorted(rows) == sorted(op6_mixing.mix(d.repartition(3)).collect())
    copies = Counter(r.doc_id for r in op6_mixing.mixed_documents(d).collect())
    assert copies == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert op6_mixing.mixed_documents(d).columns == d.columns


def test_mix_of_overlapping_sources(spark):
    d = spark.createDataFrame([(i, "w " * 10, [["a"], ["b"], ["a", "b"], ["b", "a"], None][i % 5]) for i in range(100)], "doc_id bigint, text string, source array<string>")
    rows = op6_mixing.mix(d).collect()
    assert len(rows) == 100 and all(r.taken <= 30 for r in rows)
    assert abs(sum(r.taken for r in rows) - 1000) <= 30
    assert op6_mixing.mix(d.limit(0)).count() == 0


# --- token files and BPE ------------------------------------------------------------------

RANKS = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def odd_texts(n=1500, more=()):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "b,", "the", "é", "日本", "😀", "123", "'s", "'ll", " ", "!!", "$$$", "\r\n", "A", "\x1c", "　", "\0", "don't", "word.", "Word", *more]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_bpe_equals_library():
    bpe = op8_bpe.load()
    texts = [t or "" for t in M.TEXTS] + odd_texts() + ["a" * 3000, "ab" * 2000, "é" * 2000, " " * 999, "abcabc " * 900, "".join(random.Random(2).choice("abcdefgh") for _ in range(5000))]
    for t, ids in zip(texts, bpe.pieces.each(pa.array(texts)), strict=True):
        assert ids.tolist() == TIK.encode_ordinary(t), repr(t[:60])
        assert bpe.decode(ids) == t.encode()


def test_bpe_queue_with_ranks_that_fall():
    """A merge may make a pair of lower rank; it goes before other places of the present rank."""
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 300, b"abab": 301, b"ababab": 299, b"ba": 302}
    bpe = op8_bpe.Bpe(ranks, r"\S+|\s+")
    for t in ["abab", "ababab", "abcab", "babab", "abababab", "bababc"] + ["".join(random.Random(i).choice("abc") for _ in range(12)) for i in range(200)]:
        raw = t.encode()
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while raw not in ranks:
            found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = [ranks[raw]] if raw in ranks else [ranks[p] for p in parts]
        assert np.frombuffer(bpe.encode([t])[0], "<u4").tolist() == want == bpe.long_piece(raw), t


def test_rank_queue():
    rng = random.Random(0)
    q, items = op8_bpe.RankQueue(50_000), []
    for _ in range(2000):
        if rng.random() < 0.6:
            item = (rng.randrange(50_000), rng.randrange(99))
            items.append(item)
            q.push(*item)
        elif items:
            items.remove(want := min(items))
            assert q.pop() == want
    while items:
        items.remove(want := min(items))
        assert q.pop() == want
    assert q.pop() is None


def test_bpe_query(spark):
    rows = {r.doc_id: r for r in op8_bpe.bpe_encode(M.table(spark), with_ids=True).collect()}
    for i, t in enumerate(M.TEXTS):
        ids = TIK.encode_ordinary(t or "")
        assert (rows[i].n_tokens, rows[i].ids) == (len(ids), ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert op8_bpe.bpe_encode(M.table(spark).limit(0)).count() == 0


def test_file_encoder_equals_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for t in M.TEXTS] + odd_texts(800) + odd_texts(800, ["<|endoftext|>", "<|", "|>", "<|endoftext|"])
    for t, got in zip(texts, op7_token_files.Encoder(op7_token_files.TOKENIZER).pieces.each(pa.array(texts)), strict=True):
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:60])


@pytest.mark.parametrize("planes", [4, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 1000, 2001])
def test_image_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 20, n).astype("<u4")
    image = op7_token_files.Image(op7_token_files.write_image([3, None, -5], [n, 0, 0], ids, planes, 1000))
    assert (image.ids() == ids).all() and (image.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all()
    assert image.doc_ids == [3, None, -5] and image.lengths.tolist() == [n, 0, 0]
    with pytest.raises(ValueError):
        op7_token_files.Image(b"nope" + bytes(60))


@pytest.mark.parametrize("planes", [4, 32])
def test_token_files(spark, tmp_path, planes):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(0)
    ids = rng.sample(range(-50, 500), len(M.TEXTS))
    rows = op7_token_files.token_files(M.table(spark, ids=ids), str(tmp_path / "t"), planes=planes, files_ids=300).orderBy("doc_id").collect()
    at = 0
    for r, (i, t) in zip(rows, sorted(zip(ids, M.TEXTS, strict=True)), strict=True):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_token_files_of_repeated_and_null_ids(spark, tmp_path):
    d = M.table(spark, ["b", "a", "c", "a", "z"], ids=[7, 7, None, 7, 1])
    rows = op7_token_files.token_files(d, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 7, 7, 7] and [r.start for r in rows] == [0, 2, 4, 6, 8]
    assert op7_token_files.token_files(d.limit(0), str(tmp_path / "e")).count() == 0
