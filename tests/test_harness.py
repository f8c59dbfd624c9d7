"""Numbering, ranks, packing and the harness against plain models."""

import difflib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from logloom import api, selftest
from logloom.functions import text as T
from logloom.operators import corpus, facts, harness, labels, lines, methods, stats, timeline
from logloom.sources import curated, readers, sinks

from .test_operators import archive_model, docs


def tokens(text):
    return regex.findall(T.WORD_TOKEN, text)


def norm(text):
    return re.sub(r"\s+", " ", text).strip().lower()


def ranks_auc(p, g):
    order = np.lexsort((np.arange(len(p)), p))
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    pos = g.sum()
    return (rank[g == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(p) - pos))


def test_ranking_of_many_rows(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rng = np.random.default_rng(4)
        p, g = rng.integers(0, 5000, 20_000) / 5000, rng.integers(0, 2, 20_000)
        df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, g, strict=True))], "i bigint, prob double, gold int").repartition(5)
        assert abs(stats.ranking(df).first().roc_auc - ranks_auc(p, g)) < 1e-12
        places = [r.x for r in stats.numbered(df, [F.col("prob"), F.col("i")], "x").select("x").collect()]
        assert sorted(places) == list(range(1, 20_001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_value_at_rank(spark):
    rng = random.Random(2)
    for xs in ([3.0], [1.0] * 9, [rng.choice([rng.random(), 0.5, -7.0, 1e9]) for _ in range(3000)]):
        df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
        for k in {1, len(xs), (len(xs) + 1) // 2, max(1, len(xs) - 3)}:
            assert stats.value_at_rank(df, "x", k) == sorted(xs)[k - 1]
    for p, v in harness.percentiles(spark.createDataFrame([(float(i),) for i in range(11)], "x double"), "x").items():
        assert v == math.floor(p / 100 * 10 + 0.5)
    assert harness.percentiles(spark.createDataFrame([], "x double"), "x") == {50: 0.0, 95: 0.0, 99: 0.0}


def test_half_tail_is_exact():
    for n in (1, 2, 7, 30, 200):
        for k in {0, 1, n // 3, n // 2, n - 1, n}:
            want = sum(math.comb(n, i) for i in range(k + 1)) / 2**n
            assert abs(stats.half_tail(n, k) - want) < 1e-12
    assert 0 < stats.half_tail(10**9, 5 * 10**8 - 60_000) < 1e-3


def test_chunks_hold_to_their_limit_in_every_mode(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    long = " ".join(word() for _ in range(300)) + "."
    texts = ["\n".join([long, "short line", long + " " + word()]), f"{long} Then a short one. {long}\n\nAnd more.", " ", ""]
    for mode in corpus.SPLITTERS:
        rows = corpus.chunked(docs(spark, texts), 64, mode).collect()
        assert rows and all(0 < r.n_tokens <= 64 for r in rows)
        for i, t in enumerate(texts):
            got = "".join(r.text for r in sorted(rows, key=lambda r: r.chunk_id) if r.doc_id == i)
            assert re.sub(r"\s", "", got) == re.sub(r"\s", "", t)


def fill_model(pools, target, share):
    most = max(1, int(share * target))
    out, goal = dict.fromkeys(pools, 0), min(target, sum(min(n, most) for n in pools.values()))
    while sum(out.values()) < goal:  # a slot at a time to the least full, the deepest first
        open_ = [k for k in pools if out[k] < min(pools[k], most)]
        least = min(out[k] for k in open_)
        out[min((k for k in open_ if out[k] == least), key=lambda k: (-min(pools[k], most), k))] += 1
    return out


def test_water_fill_equals_a_slot_at_a_time():
    rng = random.Random(6)
    for _ in range(300):
        pools = {c: rng.randrange(0, 12) for c in "abcdef"[: rng.randrange(1, 7)]}
        target, share = rng.randrange(0, 30), rng.choice([0.1, 0.25, 0.5, 1.0])
        want = fill_model(pools, target, share) if target else dict.fromkeys(pools, 0)
        assert corpus.water_fill(pools, target, share) == want


def kept_model(original, compressed, spans):
    blocks = difflib.SequenceMatcher(None, original, compressed, autojunk=False).get_matching_blocks()
    kept = {i for m in blocks if m.size >= 3 for i in range(m.a, m.a + m.size)}
    out = []
    for s, e in spans:
        own = [i for i in range(s, e) if i in kept]
        out.append(e > s and (len(own) == e - s or (2 * len(own) >= e - s and any(not original[i : i + 1].isspace() for i in own))))
    return out


def test_kept_tokens_equal_a_plain_model():
    rng = random.Random(8)
    for _ in range(60):
        words = [rng.choice(["alpha", "be", "c", "delta é"]) for _ in range(rng.randrange(0, 12))]
        original = rng.choice([" ", "  ", "\n"]).join(words).encode()
        compressed = " ".join(w for w in words if rng.random() < 0.6).encode()
        ends = np.cumsum([len(t.encode()) for t in tokens(original.decode())]).tolist()
        spans = list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []
        assert labels.kept_tokens(original, compressed, spans) == kept_model(original, compressed, spans)


def test_masks_of_chunks_equal_a_plain_model(spark):
    texts = ["one two three four five six seven", "a b", "", "the pool ran out of room  at night"]
    pairs = [(i, t, " ".join(w for k, w in enumerate(t.split(" ")) if k % 3 != 2)) for i, t in enumerate(texts)]
    for r in labels.derive_mask(spark.createDataFrame(pairs, "id int, original string, compressed string")).collect():
        assert r.tokens == tokens(r.original)
        assert r.keep == kept_model(r.original.encode(), r.compressed.encode(), [(x.s, x.e) for x in r.spans])


def severity_model(text, rate):
    rows = text.split("\n")
    rank = lambda x: next((i for i, s in enumerate(T.SEVERITIES) if s in x.upper()), 6)
    budget, spent, kept = max(1, round((1.0 - rate) * len(tokens(text)))), 0, []
    for i in sorted(range(len(rows)), key=lambda i: (rank(rows[i]), i)):
        cost = len(tokens(rows[i])) + 1
        if spent + cost <= budget or not kept:
            spent += cost
            kept.append(i)
    return "\n".join(rows[i] for i in sorted(kept))


def test_label_ceiling_equals_a_plain_model(spark):
    rng = random.Random(9)
    records = []
    for i in range(25):
        rows = [f"INFO step {rng.randrange(99)} fine today", f"ERROR request_id=r{i}x status=503 failed", "WARN slow disk seen here", "no fact at all"]
        text = "\n".join(rng.sample(rows, rng.randrange(1, 5)))
        records.append((i, text, " ".join(w for k, w in enumerate(text.split(" ")) if k % 3 != i % 3)))
    df = spark.createDataFrame(records, "id int, original string, compressed string")
    facts_of = {r.id: (r.b.fact_type, r.b.answer) for r in df.select("id", F.explode(facts.best(F.col("original"), facts.candidates(F.col("original")))).alias("b")).collect()}
    got = {r.id: r for r in harness.ceiling_items(df).collect()}
    assert set(got) == set(facts_of) and len(got) > 5
    for i, original, compressed in records:
        if i in got:
            toks = tokens(original)
            ends = np.cumsum([len(t.encode()) for t in toks]).tolist()
            keep = kept_model(original.encode(), compressed.encode(), list(zip([0, *ends[:-1]], ends, strict=True)))
            kind, answer = facts_of[i]
            drop = 1 - sum(keep) / len(toks)
            r = got[i]
            assert r.fact_type == kind and abs(r["drop"] - drop) < 1e-12
            holds = lambda t: norm(answer) in norm(t)  # noqa: B023, E731
            assert (r.teacher, r.label, r.severe) == (holds(compressed), holds("".join(t for t, k in zip(toks, keep, strict=True) if k)), holds(severity_model(original, drop)))
    counts = harness.ceiling_counts(df, harness.ceiling_items(df))
    assert counts["chunks"] == 25 and counts["with_needle"] == counts["needle_in_original"] == len(got) == sum(n for n, *_ in counts["by_type"].values())
    assert any(x.startswith("verdict") for x in sinks.ceiling_report(counts))


def test_random_drop_equals_a_plain_model(spark):
    texts = ["one two three four five six", "client_ip=10.0.0.1 ERROR disk  full again and again", "x"]
    got = {r.doc_id: r.compressed for r in methods.random_drop(docs(spark, texts), 0.5).collect()}
    for i, t in enumerate(texts):
        toks = tokens(t)
        prob = [1 - zlib.crc32(f"{zlib.crc32(t.encode())}:{k}".encode()) / 2**32 for k in range(len(toks))]
        gone = sorted(range(len(toks)), key=lambda k: (-prob[k], k))[: round(0.5 * len(toks))]
        assert got[i] == "".join(x for k, x in enumerate(toks) if k not in gone)
    spans = {r.doc_id: r.compressed for r in methods.random_drop(docs(spark, texts).withColumn("r", F.lit(0.5)), F.col("r"), floor=True, span="word").collect()}
    assert "10.0.0.1" in spans[1] and "ERROR" in spans[1]


def test_system_triples_agree_between_runs(spark):
    line = "17/06/09 20:10:4{} INFO executor.Executor: Finished writing shuffle output {}"
    rows = [("spark", d, n, line.format(n % 10, "again" if n % 3 else f"for part {'abcdefgh'[n % 8]}")) for d in range(6) for n in range(40)]
    df = spark.createDataFrame(rows, "system string, doc_id bigint, line_no int, line string")
    key = lambda x: sorted((r.answer, r.doc_id, r.line_no, r.chunk) for r in facts.system_triples(x, 4).collect())
    assert key(df.repartition(3)) == key(df.repartition(7, "line")) and key(df)


def test_archive_with_a_threshold_a_turn(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for c in range(40):
        sizes = [rng.choice([0, 3, 30, 200]) for _ in range(rng.randrange(1, 14))]
        limits = [rng.choice([10, 60, 300]) for _ in sizes]
        rows += [(c, t, n, m) for t, (n, m) in enumerate(zip(sizes, limits, strict=True))]
        active, held = [], 0
        for t, n in enumerate(sizes):
            active.append(t)
            held += n
            while held > limits[t] and len(active) > 1:
                held -= sizes[active[0]]
                want[c, active.pop(0)] = t
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, n bigint, most bigint")
    got = {(r.conv_id, r.turn): r.archived_at for r in timeline.archived(df, F.col("most"), F.col("n")).collect()}
    assert {k: v for k, v in got.items() if v is not None} == want
    same = timeline.archived(df, F.lit(60), F.col("n")).where("archived_at is not null").count()
    assert same == timeline.archived(df, 60, F.col("n")).where("archived_at is not null").count() == sum(len(archive_model([n for c, _, n, _ in rows if c == k], 60)) for k in range(40))


def test_byte_level_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    texts = ["ERROR é 日本 disk", "", "pool  exhausted\nnow"]
    rows = docs(spark, texts).select("doc_id", "text", api.bpe_tokens(F.col("text"), path, public.PATTERN).alias("t")).withColumn("back", api.bpe_decode(F.transform("t", lambda x: x.id), path, public.PATTERN)).collect()
    for r in rows:
        assert r.back == r.text and [x.s for x in r.t] == [0, *[x.e for x in r.t]][: len(r.t)] and (not r.t or r.t[-1].e == len(r.text.encode()))
    masked = api.bpe_lock_mask(docs(spark, texts), path, public.PATTERN, keywords=["exhausted"]).where("locked").collect()
    assert {r.doc_id for r in masked} == {2} and min(r.s for r in masked) <= 6 < max(r.e for r in masked)


def test_shards_and_their_summary(spark):
    pairs = [("a.py", 0, "def f(x):\n    return x + 1\n", "def f(x): return x"), ("b.log", 0, "ERROR disk full on node seven tonight", "ERROR disk full"), ("c.txt", 1, "tiny", "tiny")]
    df = spark.createDataFrame(pairs, "src_path string, chunk_id bigint, original string, compressed string")
    made = harness.shards(df, min_tokens=4, needle_weight=3.0)
    rows = {r.src_path: r for r in made.collect()}
    assert set(rows) == {"a.py", "b.log"} and rows["a.py"].is_code and not rows["b.log"].is_code
    assert all(len(r.tokens) == len(r.tags) == len(r.w_semantic) == len(r.w_dependency) for r in rows.values())
    assert max(rows["b.log"].w_semantic) == 3.0
    s = harness.shard_summary(5, df, made).first()
    assert (s.total_in, s.survived, s.dropped_short, s.emitted, s.train + s.val, s.pct_code) == (5, 3, 1, 2, 2, 50.0)


def test_throughput_and_reports(spark):
    d = docs(spark, ["INFO beat 1\n" * 30, "INFO beat 2\nERROR x", ""])
    found = harness.throughput(d, batches=2, chunk_bytes=1000)
    assert found["files"] == 2 and found["bytes"] == sum(len(t) for t in ("INFO beat 1\n" * 30, "INFO beat 2\nERROR x")) and found["tokens_out"] < found["tokens_in"]
    kept = harness.survivals(harness.reductions(d), spark.createDataFrame([(0, "INFO"), (1, "gone")], "doc_id bigint, needle string")).first()
    assert (kept.kept, kept.total) == (1, 2)
    assert any("p95" in x for x in sinks.throughput_report(found | kept.asDict(), "x"))


def test_analysis_of_a_results_file(spark, tmp_path):
    item = lambda i, j, e: {"doc_id": f"d{i}", "fact_type": "loghub:spark" if i % 2 else "x", "judge": j, "exact": e}
    per_item = {"m@iso3": [item(i, i < 8, True) for i in range(10)], "k@iso3": [item(i, False, i < 5) for i in range(10)], "m@iso5": [item(0, True, True)], "odd": [item(0, True, False)]}
    (tmp_path / "r.json").write_text(json.dumps({"per_item": per_item}))
    results = readers.read_results(spark, str(tmp_path / "r.json"))
    assert {(r.method, r.ratio_key) for r in results.collect()} == {("m", "iso3"), ("k", "iso3"), ("m", "iso5"), ("odd", "")}
    pairs = spark.createDataFrame([("m", "k"), ("m", "absent")], "method_a string, method_b string")
    methods_, domains, tests = harness.method_stats(results, 100), harness.domain_stats(results), harness.pair_tests(results, pairs)
    by = {(r.ratio_key, r.metric): r for r in tests.collect()}
    assert set(by) == {("iso3", "judge"), ("iso3", "exact")} and (by["iso3", "judge"].b, by["iso3", "judge"].c, by["iso3", "exact"].b) == (8, 0, 5)
    one = methods_.where("ratio_key = 'iso3' and method = 'm' and metric = 'judge'").first()
    assert one.n == 10 and one.point == 0.8 and one.lo <= 0.8 <= one.hi
    text = "\n".join(r.line for r in sinks.analysis_report(methods_, domains, tests, "judge").collect())
    assert "A significantly better" in text and "spark n=5" in text
    per_item["k@iso3"][3]["doc_id"] = "other"
    (tmp_path / "s.json").write_text(json.dumps({"per_item": per_item}))
    with pytest.raises(Exception, match="not aligned"):
        harness.pair_tests(readers.read_results(spark, str(tmp_path / "s.json")), pairs).collect()


def test_lines_over_the_bound_raise(spark, tmp_path):
    (tmp_path / "l.txt").write_text("short\n" + "x" * 50 + "\n")
    assert readers.read_lines(spark, str(tmp_path / "l.txt")).count() == 2
    with pytest.raises(Exception, match="exceeds 20 bytes"):
        readers.read_lines(spark, str(tmp_path / "l.txt"), most=20).collect()


def test_shards_are_striped(spark, tmp_path):
    for k in range(5):
        rows = [{"input_ids": [k, i], "tags": [0, 1], "w_semantic": [1.0, 1.0], "w_dependency": [0.0, 0.0], "src_path": f"f{k}"} for i in range(3)] + [{"input_ids": [1], "tags": [], "w_semantic": [], "w_dependency": []}]
        (tmp_path / f"s{k}.json").write_text("\n".join(map(json.dumps, rows)))
    for seed in (None, 3):
        parts = [{r.src_path for r in readers.read_shards(spark, str(tmp_path), seed, w, 2).collect()} for w in (0, 1)]
        assert not parts[0] & parts[1] and parts[0] | parts[1] == {f"f{k}" for k in range(5)}
        assert sum(readers.read_shards(spark, str(tmp_path), seed, w, 2).count() for w in (0, 1)) == 15


def test_summary_line_escapes_controls(spark):
    key = 'a\t"b\\\r\x1b\x7f'
    got = spark.createDataFrame([(key,)], "k string").select(lines.escaped(F.col("k"))).first()[0]
    assert got == 'a\\t\\"b\\\\\\r\\u{1b}\\u{7f}'


def test_self_test_and_demo(spark):
    assert selftest.run(spark) == {}
    assert len(selftest.demo(spark)) == 4 * len(curated.documents())


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from logloom.__main__ import main

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("INFO beat 1\n" * 50 + "ERROR request_id=abc9 status=503\n")
    (tmp_path / "logs" / "needles.txt").write_text("abc9\n")
    pair = {"original": "ERROR request_id=abc9 status=503 here and now", "compressed": "ERROR request_id=abc9", "src_path": "x.log", "chunk_id": 1}
    (tmp_path / "pairs.jsonl").write_text("\n".join(json.dumps(pair | {"chunk_id": i}) for i in range(4)))
    (tmp_path / "triples.json").write_text(json.dumps({"triples": [{"doc_id": "d", "text": "ERROR disk\nplain line", "question": "q", "answer": "ERROR", "fact_type": "severity", "source": "s"}]}))
    item = {"doc_id": "d", "fact_type": "x", "judge": True, "exact": True}
    (tmp_path / "results.json").write_text(json.dumps({"per_item": {"a@1": [item], "b@1": [item]}}))

    def said(*args):
        assert main([*args], spark) == 0
        return capsys.readouterr().out

    assert "survival        : 100.00% (1/1)" in said("bench", f"{tmp_path}/logs", "--batches", "2")
    assert "a vs b" in said("stats", f"{tmp_path}/results.json", "--pairs", "a:b", "--resamples", "20")
    assert "needle in the original: 4" in said("ceiling", f"{tmp_path}/pairs.jsonl")
    assert "keep-severity" in said("survival", f"{tmp_path}/triples.json", "--rates", "0.5")
    assert json.loads(said("triples", f"{tmp_path}/logs").splitlines()[0])["answer"] == "abc9"
    assert "emitted: 4" in said("shards", f"{tmp_path}/pairs.jsonl", f"{tmp_path}/out")
    monkeypatch.setenv("SOME_MODEL", str(tmp_path / "pairs.jsonl"))
    assert api.model_file(None, "SOME_MODEL") == ("found", str(tmp_path / "pairs.jsonl"))
