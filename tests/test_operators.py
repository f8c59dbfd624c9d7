"""Operators on small cases of their own, against step-by-step models."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom import api
from logloom.functions import spans as S
from logloom.functions import text as T
from logloom.operators import arrays, corpus, decode, facts, labels, lines, methods, stats, store, timeline
from logloom.sources import adapters, readers, sinks

quick = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
RUNS = ["", "a", "a\n", "a\r\na\r\n", "x 1\nx 2\nx 3\nx 4\n", "x 1\nx 2\n\nx 3\nx 4\nx 5", "é 1\né 2\né 3", "⟪elided idx=0 lines=1 key=\"x\"⟫\nx 1\nx 2\nx 3", "\n\n\n\n", 'say "hi" 1\nsay "hi" 2\nsay "hi" 3']


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def rebuilt_texts(spark, texts):
    d = docs(spark, texts)
    u, g = lines.units(d)
    rows = lines.rebuild(u, g, d.select("doc_id", F.col("text").endswith("\n").alias("ends_in_newline"))).collect()
    return [r.text for r in sorted(rows)]


def test_dedup_round_trip(spark):
    assert rebuilt_texts(spark, RUNS) == RUNS


@quick
@given(st.lists(st.lists(st.sampled_from(["a 1", "a 2", "b", "", "b\r", "é 0x1F"]), max_size=9).map("\n".join), min_size=1, max_size=4))
def test_dedup_round_trip_random(spark, texts):
    assert rebuilt_texts(spark, texts) == texts


def test_dedup_reduced(spark):
    got = {r.doc_id: r for r in lines.reduced(docs(spark, RUNS)).collect()}
    assert got[4].reduced == 'x 1\n⟪elided idx=0 lines=2 key="x <NUM>"⟫\nx 4\n'
    assert (got[4].n_lines, got[4].n_elided, got[4].n_groups) == (4, 2, 1)
    assert got[0].reduced == "" and got[1].reduced == "a" and got[3].reduced == "a\r\na\r\n"
    assert '\\"hi\\"' in got[9].reduced


@pytest.mark.parametrize(
    ("line", "key"),
    [
        ("2024-01-02T03:04:05.6Z up", "<TS> up"), ("[27/Dec/2037:12:00:00 +0530] GET", "[<TS>] GET"),
        ("id 123e4567-e89b-12d3-a456-426614174000", "id <UUID>"), ("from 10.0.0.1 port 80", "from <IP> port <NUM>"),
        ("at 0XFF and 0x1f", "at <HEX> and <HEX>"), ("obj deadbeefdeadbeef01", "obj <HEX>"), ("took 1.5 s", "took <NUM> s"), ("a1 b", "a1 b"),
    ],
)
def test_normalize(spark, line, key):
    assert spark.createDataFrame([(line,)], "x string").select(T.normalize_line(F.col("x"))).first()[0] == key


def test_random_tokens(spark):
    tokens = ["xK9fQ2mZ7pLw3R", "aGVsbG8gd29ybGQhIQ", "configuration", "authentication", "short1", "bcdfghjklmnpqr"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", T.is_random_token(F.col("t")).alias("r"))
    assert {r.t: r.r for r in rows.collect()} == {"xK9fQ2mZ7pLw3R": True, "aGVsbG8gd29ybGQhIQ": True, "configuration": False, "authentication": False, "short1": False, "bcdfghjklmnpqr": True}


def test_template_key_folds_placeholders(spark):
    one = lambda x: spark.createDataFrame([(x,)], "x string").select(T.template_key(F.col("x"))).first()[0]
    assert one("job run_12 1 2 done") == "job run_<RAND> done"
    assert one("run xK9fQ2mZ7pLw3R ok") == "run <RAND> ok"


def test_match_spans_are_bytes(spark):
    text = "é 10.0.0.1 日本 10.0.0.22"
    rows = spark.createDataFrame([(text,)], "x string").select(S.match_spans(F.col("x"), facts.STRUCTURAL[5]).alias("s")).first().s
    raw = text.encode()
    assert [raw[r.s : r.e].decode() for r in rows] == ["10.0.0.1", "10.0.0.22"]


def merged_model(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_merge_intervals(spark):
    rng = random.Random(3)
    cases = [[], [(0, 2), (2, 4)], [(0, 9), (2, 3)], [(5, 6), (0, 1)]] + [[(s := rng.randrange(20), s + rng.randrange(1, 5)) for _ in range(rng.randrange(8))] for _ in range(30)]
    df = spark.createDataFrame([(i, [{"s": s, "e": e} for s, e in c]) for i, c in enumerate(cases)], f"i int, x {S.SPAN}")
    got = {r.i: [(x.s, x.e) for x in r.m] for r in df.select("i", S.merge(F.col("x")).alias("m")).collect()}
    assert got == {i: merged_model(c) for i, c in enumerate(cases)}


def test_greedy_skips_and_goes_on(spark):
    rng = random.Random(5)
    cases = [([(-0.9, 0, 5), (-0.8, 1, 2), (-0.7, 2, 1)], 3)] + [([(-rng.random(), g, rng.randrange(1, 5)) for g in range(rng.randrange(9))], rng.randrange(9)) for _ in range(30)]
    df = spark.createDataFrame([(i, c, k) for i, (c, k) in enumerate(cases)], "i int, x array<struct<neg:double,g:int,n:int>>, k int")
    got = {r.i: r.g for r in df.select("i", decode.greedy(F.col("x"), F.col("k")).alias("g")).collect()}
    for i, (c, k) in enumerate(cases):
        want, t = [], 0
        for _, g, n in sorted(c):
            if t + n <= k:
                want.append(g)
                t += n
        assert got[i] == want


def test_span_decode_keeps_locks_and_rate(spark):
    d = docs(spark, ["ERROR: disk 10.0.0.1 is full and the node went away quietly tonight"])
    toks = decode.locked(d, S.match_rows(d, facts.STRUCTURAL)).withColumn("prob", F.lit(0.5))
    out = decode.span_decode(toks, 0.5).collect()
    assert sum(r.dropped for r in out) <= round(0.5 * len(out))
    assert not any(r.dropped and r.locked for r in out)


def archive_model(tokens, limit):
    active, out, total = [], {}, 0
    for i, t in enumerate(tokens):
        active.append(i)
        total += t
        while total > limit and len(active) > 1:
            j = active.pop(0)
            total -= tokens[j]
            out[j] = i
    return out


def test_archive_rule(spark):
    rng = random.Random(7)
    cases = [[rng.choice([0, 1, 5, 40, 200]) for _ in range(rng.randrange(1, 15))] for _ in range(60)]
    rows = [(c, i, "user", "", t) for c, case in enumerate(cases) for i, t in enumerate(case)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, tok bigint")
    got = {(r.conv_id, r.turn): r.archived_at for r in timeline.archived(df, 100, F.col("tok")).collect()}
    assert got == {(c, i): archive_model(case, 100).get(i) for c, case in enumerate(cases) for i in range(len(case))}


def test_archive_stream_equals_batch(spark, sf, tmp_path):
    from logloom.streaming.timeline import archive_stream

    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", T.token_count(F.col("text")).cast("bigint").alias("tokens"))
    for k in range(3):  # a third of the turns each batch
        turns.where(f"turn between {k * 3} and {k * 3 + 2 if k < 2 else 10**9}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))
    q = archive_stream(stream, 150).writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.node_id, r.child_count, r.total_tokens) for r in spark.table("steps").collect()}
    batch = timeline.nodes(timeline.archived(spark.read.parquet(f"{sf}/conversations.parquet"), 150))
    assert got == {(r.node_id, r.child_count, r.total_tokens) for r in batch.collect()}


@pytest.mark.parametrize("n", [5, 6, 15, 25, 26, 30, 50])
def test_compress_array_lengths(spark, n):
    df = spark.createDataFrame([(json.dumps(list(range(n))),)], "x string")
    r = arrays.compress_json(df, "x").first()
    if n < 26:
        assert (r.compressed, r.omitted, r.cache_id) == (json.dumps(list(range(n))), 0, None)
    else:
        out = json.loads(r.compressed)
        assert out[:3] == [0, 1, 2] and out[-3:] == [n - 3, n - 2, n - 1] and len(out) == 7
        assert out[3]["omitted_count"] == n - 6 == r.omitted and json.loads(r.middle_json) == list(range(3, n - 3))


@pytest.mark.parametrize("text", ['{"a": 1}', "7", "not json", "[]"])
def test_compress_array_passes_others(spark, text):
    r = arrays.compress_json(spark.createDataFrame([(text,)], "x string"), "x").first()
    assert r.compressed == text and r.omitted == 0


def test_store_round_trip(spark, tmp_path):
    rows = store.entries(spark.createDataFrame([("p1", 1), ("p1", 1), ("p2", 2)], "payload string, omitted_count int"), created_at="2024-01-01 00:00:00")
    store.stash(rows, str(tmp_path / "s"))
    kept = store.read(spark, str(tmp_path / "s"))
    assert kept.count() == 2
    ids = kept.select(F.col("id").alias("cache_id")).unionAll(spark.createDataFrame([("nope",)], "cache_id string"))
    got = {r.cache_id: (r.payload, r.found, r.error) for r in store.retrieve(kept, ids).collect()}
    assert got["nope"] == (None, False, "cache_miss") and sorted(v[0] for k, v in got.items() if k != "nope") == ["p1", "p2"]


def test_facts(spark):
    text = 'ConnectionResetError at 10:00 INC0000040 request_id=1000 status=503 errno=13 error code 0xFF client_ip=10.0.0.9 ERROR root_cause="disk was full" msg="single"'
    row = spark.createDataFrame([(text,)], "x string")
    got = [(c.fact_type, c.answer) for c in row.select(facts.candidates(F.col("x")).alias("c")).first().c]
    assert got == [("exception", "ConnectionResetError"), ("incident", "INC0000040"), ("request_id", "1000"), ("http_status", "503"), ("error_code", "13"), ("error_code", "0xFF"), ("client_ip", "10.0.0.9"), ("severity", "ERROR")]
    assert [(c.fact_type, c.answer) for c in row.select(facts.semantic_candidates(F.col("x")).alias("c")).first().c] == [("semantic:root_cause", "disk was full")]


def test_best_prefers_unique(spark):
    text = "XError XError INC12345"
    b = spark.createDataFrame([(text,)], "x string").select(facts.best(F.col("x"), facts.candidates(F.col("x"))).alias("b")).first().b[0]
    assert (b.fact_type, b.answer) == ("incident", "INC12345")
    text = "XError XError"
    assert spark.createDataFrame([(text,)], "x string").select(facts.best(F.col("x"), facts.candidates(F.col("x"))).alias("b")).first().b[0].answer == "XError"


def test_needles(spark):
    line = "17/06/09 20:10:40 INFO executor.Executor: Finished writing shuffle output for stage 12345"
    df = spark.createDataFrame([("spark", 0, 0, line), ("spark", 0, 1, "17/06/09 20:10:41 ERROR x.Y: short 1"), ("hdfs", 1, 0, "nothing")], "system string, doc_id bigint, line_no int, line string")
    rows = facts.system_triples(df).collect()
    assert [(r.source, r.answer) for r in rows] == [("loghub:spark", "Finished writing shuffle output for stage")]


def test_keep_severity_model(spark):
    rng = random.Random(1)
    words = ["ERROR disk", "info ok then", "WARN slow", "FATAL", "plain line of text", "critical x"]
    texts = ["\n".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(20)]
    count = lambda t: len(__import__("regex").findall(T.WORD_TOKEN, t))
    rank = lambda x: next((i for i, s in enumerate(T.SEVERITIES) if s in x.upper()), 6)
    got = {r.doc_id: r.compressed for r in methods.keep_severity(docs(spark, texts), 0.5).collect()}
    for i, t in enumerate(texts):
        rows, spent, kept = t.split("\n"), 0, []
        budget = max(1, round(0.5 * count(t)))
        for k in sorted(range(len(rows)), key=lambda k: (rank(rows[k]), k)):
            cost = count(rows[k]) + 1
            if spent + cost > budget and kept:
                continue
            kept.append(k)
            spent += cost
            if spent >= budget:
                break
        assert got[i] == "\n".join(rows[k] for k in sorted(kept))


def test_random_drop_rate_and_floor(spark):
    d = docs(spark, ["ERROR at 10.0.0.1 while the request_id=abc went on and on for a long time"])
    half = methods.random_drop(d, 0.5).first().compressed
    assert 0 < len(half) < len(d.first().text) and half == methods.random_drop(d, 0.5).first().compressed
    floor = methods.random_drop(d, 0.9, floor=True).first().compressed
    assert "ERROR" in floor and "10.0.0.1" in floor


def test_mcnemar_vectors(spark):
    df = spark.createDataFrame([(i < 10, False) for i in range(100)], "a boolean, b boolean")
    r = stats.mcnemar(df).first()
    assert (r.b, r.c, round(r.chi2, 9)) == (10, 0, 8.1) and abs(r.p_exact - 2 / 1024) < 1e-12 and abs(r.p_chi2 - 0.004427) < 1e-5
    even = stats.mcnemar(spark.createDataFrame([(True, False), (False, True)], "a boolean, b boolean")).first()
    assert even.chi2 == 0.5 and even.p_exact == 1.0
    none = stats.mcnemar(spark.createDataFrame([(True, True)], "a boolean, b boolean")).first()
    assert (none.chi2, none.p_chi2, none.p_exact, none.a_better) == (0.0, 1.0, 1.0, False)


def test_paired_raises_on_misalignment(spark):
    items = spark.createDataFrame([("x", 0.5, 1, True), ("y", 0.5, 2, True)], "method string, rate double, triple_id int, survived boolean")
    with pytest.raises(Exception, match="aligned"):
        stats.paired(items, "x", "y").collect()


def test_bootstrap_brackets_the_mean(spark):
    df = spark.createDataFrame([(i % 3 == 0,) for i in range(90)], "survived boolean")
    r = stats.bootstrap_ci(df, resamples=300).first()
    assert abs(r.point - 1 / 3) < 1e-9 and 0.2 < r.lo < r.point < r.hi < 0.47 and r.n == 90


def test_ranking_by_hand(spark):
    df = spark.createDataFrame([(0, 0.9, 1), (1, 0.8, 0), (2, 0.7, 1), (3, 0.1, 0)], "i int, prob double, gold int")
    r = stats.ranking(df).first()
    assert abs(r.pr_auc - (1 + 2 / 3) / 2) < 1e-9 and abs(r.roc_auc - 0.75) < 1e-9
    assert abs(r.best_f1 - 0.8) < 1e-9 and r.best_f1_thr == 0.7 and r.f1_at_target == 0.5 and r.argmax_drop_rate == 0.75
    zero = stats.ranking(spark.createDataFrame([(0, 0.2, 0), (1, 0.2, 0)], "i int, prob double, gold int")).first()
    assert (zero.pr_auc, zero.roc_auc, zero.best_f1) == (0.0, 0.0, 0.0)


def water_model(pools, target, share):
    """Slots one round at a time: each open pool gets one while all can, the rest by headroom."""
    cap = {k: min(v, max(1, int(share * target))) for k, v in pools.items()}
    out, left = dict.fromkeys(pools, 0), min(target, sum(cap.values()))
    while left and (open_ := [k for k in sorted(pools) if out[k] < cap[k]]):
        if left < len(open_):
            for k in sorted(open_, key=lambda k: (out[k] - cap[k], k))[:left]:
                out[k] += 1
            break
        for k in open_:
            out[k] += 1
        left -= len(open_)
    return out


def test_water_fill():
    assert corpus.water_fill({"a": 100, "b": 100}, 10, 1.0) == {"a": 5, "b": 5}
    assert corpus.water_fill({"a": 2, "b": 100}, 10, 1.0) == {"a": 2, "b": 8}
    assert corpus.water_fill({"a": 100, "b": 100}, 10, 0.25) == {"a": 2, "b": 2}
    assert corpus.water_fill({}, 10) == {} and corpus.water_fill({"a": 3}, 0) == {"a": 0}
    rng = random.Random(2)
    for _ in range(200):
        pools = {k: rng.randrange(0, 30) for k in "abcdef"[: rng.randrange(1, 7)]}
        target, share = rng.randrange(1, 60), rng.choice([0.25, 0.5, 1.0])
        assert corpus.water_fill(pools, target, share) == water_model(pools, target, share)


def test_pack_model(spark):
    rng = random.Random(4)
    cases = [[rng.randrange(1, 15) for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    got = {r.i: r.q for r in spark.createDataFrame(list(enumerate(cases)), "i int, n array<int>").select("i", corpus.pack(F.col("n"), 10).alias("q")).collect()}
    for i, case in enumerate(cases):
        want, cur, q = [], 0, -1
        for n in case:
            if n > 10:
                q, cur = q + 1, 0
            elif cur == 0 or cur + n > 10:
                q, cur = q + 1, n
            else:
                cur += n
            want.append(q)
        assert got[i] == want


def test_chunks_hold_all_text(spark):
    d = docs(spark, ["one two three\nfour five\n" + "w " * 40 + "\nlast", "short"])
    rows = corpus.chunked(d, 8).collect()
    assert all(r.n_tokens <= 8 or "\n" in r.text for r in rows)
    assert sorted(r.chunk_id for r in rows if r.doc_id == 0) == list(range(sum(r.doc_id == 0 for r in rows)))
    words = [w for r in sorted(rows) if r.doc_id == 0 for w in r.text.split()]
    assert words == d.first().text.split()


def test_sample_is_stable_and_bounded(spark):
    rows = [(c, i, f"{c} service handled request number {i} for customer {'ab'[i % 2]}") for c in ("x", "y") for i in range(40)] + [("x", 99, "zzkq" * 9)]
    df = spark.createDataFrame(rows, "corpus string, ord bigint, line string")
    chosen, counts = corpus.sample(df, 4, 0.5, 64)
    assert chosen.count() <= 4 and sorted(chosen.collect()) == sorted(corpus.sample(df, 4, 0.5, 64)[0].collect())
    assert {r.corpus: (r.raw_lines, r.unique_templates) for r in counts.collect()} == {"x": (41, 3), "y": (40, 2)}


def test_qc_extractive_and_novel(spark):
    df = spark.createDataFrame([("a b c d", "a c"), ("a b", "z"), ("a b", "a a a"), ("", "")], "original string, compressed string")
    got = [(r.vr, r.mr, r.hr, r.ag) for r in labels.qc_metrics(df).collect()]
    assert got == [(0.0, 0.5, 0.5, 0.0), (1.0, 0.0, 0.0, 0.0), (0.0, 0.5, 1.5, 1.0), (0.0, 0.0, 0.0, 0.0)]


def test_best_output(spark):
    rows = [(1, "t1", "a b c d", "a b z"), (1, "t2", "a b c d", "a b c"), (1, "t3", "a b c d", "a b"), (1, "t4", "a b c d", " "), (2, "t1", "x y", "")]
    out = labels.best_output(spark.createDataFrame(rows, "id int, teacher string, original string, compressed string")).collect()
    assert [(r.id, r.teacher) for r in out] == [(1, "t3")]


def test_alignment_labels():
    original = b"alpha beta gamma"
    spans = [(0, 5), (5, 10), (10, 16)]
    assert labels.kept_tokens(original, b"alpha gamma", spans) == [True, False, True]
    assert labels.aligned_bytes(b"abcd", b"abcd") == [(0, 4)] and labels.aligned_bytes(b"ab", b"ab") == []


def test_json_and_python_locks():
    text = '{"ké": [1, true, "x"]}'
    raw = text.encode()
    cut = b"".join(raw[s:e] for s, e in labels.json_locks(text)).decode()
    assert cut == '{"":[1,true,""]}' and labels.json_locks("{bad") == []
    code = "def f(x):\n    '''doc'''\n    return x + 1  # note\n"
    got = [code.encode()[s:e].decode() for s, e in labels.python_locks(code)]
    assert got == ["def", "(", ")", ":", "return", "+", "1"] and labels.python_locks("def (") == []
    assert labels.json_locks("[" * 3000) == []


def test_lock_mask_api(spark):
    d = docs(spark, ['{"key": "free words", "n": 12}'])
    rows = api.lock_mask(d, "json", ["words"]).collect()
    held = "".join(r.token for r in rows if r.locked)
    assert "words" in held and "12" in held and "free" not in held
    for bad in ({"language": "cobol"}, {"keywords": [""]}, {"keywords": ["k"] * 300}):
        with pytest.raises(api.EngineError):
            api.lock_mask(d, **bad)


def test_compress_log_api(spark):
    text = "\n".join(f"beat {i} ok" for i in range(30)) + "\nERROR it broke"
    plain = api.compress_log(docs(spark, [text])).first()
    assert not plain.used_model and plain.ratio > 2 and "ERROR it broke" in plain.compressed
    import pyarrow as pa

    scored = api.compress_log(docs(spark, [text]), keywords=["ERROR"], target_rate=0.5, scorer=lambda toks: pa.array([[0.5] * len(t) for t in toks.to_pylist()], pa.list_(pa.float64()))).first()
    assert scored.used_model and scored.output_tokens < plain.output_tokens and "ERROR" in scored.compressed


def test_compress_ratio_on_repetitive_log(spark):
    """A repetitive log shrinks more than five times and keeps its three odd lines."""
    body = [f"2024-01-01 00:00:{i % 60:02d} INFO heartbeat from 10.0.0.{i % 250} seq {i}" for i in range(6000)]
    for at, odd in ((1000, "FATAL disk melted"), (3000, "quota exceeded for tenant blue"), (5000, "manual override used")):
        body[at] = odd
    r = api.compress_log(docs(spark, ["\n".join(body)])).first()
    assert r.ratio > 5 and all(x in r.compressed for x in ("FATAL disk melted", "tenant blue", "manual override"))


def test_adapters(spark):
    for name, (_, template) in adapters.LINES.items():
        cols = list(dict.fromkeys(adapters.template_columns(template)))
        df = spark.createDataFrame([tuple(f"v{i}\nx" for i in range(len(cols)))], ", ".join(f"`{c}` string" for c in cols))
        line = adapters.render_corpus(df, name).first().line
        assert "v0 x" in line and "\n" not in line and "{" not in line
        assert adapters.render_corpus(df.drop(adapters.required(name)[0]), name).count() == 0
    row = {"Timestamp": "t", "LogLevel": "INFO", "Service": "s", "Message": "a  b", "RequestID": "r", "User": None, "ClientIP": "i", "TimeTaken": "9"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    assert adapters.render_corpus(df, "distsys_synth").first().line == "t INFO [s] a b request_id=r user= client_ip=i time_taken=9"


def test_csv_json_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n3\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "two\nlines"), ("3", "")]
    items = [[1, "u", "k", 'Traceback (most recent call last):\n  File "x"'], [2, "u", "k", "fine"], [3], "no"]
    (tmp_path / "t.json").write_text(json.dumps({"data": items}))
    got = adapters.render_tracebacks(readers.read_json_items(spark, str(tmp_path / "t.json"), "data")).collect()
    assert [r.line for r in got] == ['Traceback (most recent call last): File "x"']
    (tmp_path / "p.jsonl").write_text('{"original":"a","compressed":"b"}\nnot json\n\n{"original":"","compressed":"b"}\n')
    assert readers.read_pairs(spark, str(tmp_path / "p.jsonl")).count() == 1
    assert sinks.write_lines(spark.createDataFrame([("a",), (None,)], "line string"), str(tmp_path / "out")) == (1, 1)


def test_results_triples_and_discovery(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"per_item": {"m@x@3": [{"doc_id": "d", "judge": True}, {}]}}))
    rows = readers.read_results(spark, str(tmp_path / "r.json")).orderBy("ord").collect()
    assert [(r.method, r.ratio_key, r.fact_type, r.judge, r.exact) for r in rows] == [("m@x", "3", "?", True, False), ("m@x", "3", "?", False, False)]
    t = {"doc_id": "1", "text": "t", "question": "q", "answer": "a", "fact_type": "f", "source": "s"}
    (tmp_path / "a.json").write_text(json.dumps({"triples": [t]}))
    (tmp_path / "b.json").write_text(json.dumps([t, t]))
    assert readers.read_triples(spark, str(tmp_path / "a.json")).count() == 1 and readers.read_triples(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "logs/sub").mkdir(parents=True)
    (tmp_path / "logs/sub/x.log").write_bytes(b"bad \xff byte\nERROR a long enough line\n")
    (tmp_path / "logs/sub/y.expected.txt").write_text("needle\n")
    found = readers.discover_logs(spark, str(tmp_path / "logs"))
    assert found.count() == 1 and "�" in found.first().text
    assert [r.needle for r in readers.must_survive(spark, str(tmp_path / "logs"), found).collect()] == ["ERROR a long enough line"]
    with pytest.raises(Exception, match="invalid_utf8"):
        readers.read_log_file(spark, str(tmp_path / "logs/sub/x.log")).collect()
    assert readers.resolve(spark, {"staged_path": "sub/x.log"}, str(tmp_path), str(tmp_path / "logs"))


def test_byte_chunks(spark):
    text = "ab\n" + "é" * 40 + "\n" + "cd\nef"
    rows = sorted(readers.byte_chunks(docs(spark, [text, ""]), 16).collect())
    assert "".join(r.chunk for r in rows) == text and all(len(r.chunk.encode()) <= 16 for r in rows)


def test_windows_end_at_the_last_line(spark):
    rows = facts.windows(docs(spark, ["\n".join("abcdefg"), "x", ""]), 3, 2).collect()
    assert [(r.start, r.chunk) for r in rows if r.doc_id == 0] == [(0, "a\nb\nc"), (2, "c\nd\ne"), (4, "e\nf\ng")]
    assert [(r.start, r.chunk) for r in rows if r.doc_id == 1] == [(0, "x")]


def test_reports(spark):
    rows = spark.createDataFrame([("m", 0.5, 0.25, 2.0, 0.5, 4)], "method string, rate double, survival double, mean_ratio double, mean_drop double, n bigint")
    assert "survival= 25.0%" in sinks.survival_report(rows).first().line


def test_to_ratio(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    d = docs(spark, [words * 2, "ERROR " + words])
    for r in methods.to_ratio(d, "random", 3.0, 6).collect():
        assert 2.4 < r.ratio < 3.7 and 0 < r.rate < 0.99
    fixed = methods.to_ratio(d, "deterministic", 3.0).collect()
    assert {r.rate for r in fixed} == {0.0} and len(fixed) == 2


def test_verdicts(spark):
    rows = [(m, 0.5, i, m == "x" or i < 2) for m in "xy" for i in range(12)]
    items = spark.createDataFrame(rows, "method string, rate double, triple_id int, survived boolean")
    r = methods.verdicts(items, "x", "y").first()
    assert (r.b, r.c, r.verdict) == (10, 0, "better") and methods.verdicts(items, "y", "x").first().verdict == "worse"


def test_held_out_answers_once(spark):
    df = spark.createDataFrame([(0, 'AError reason="went far away"'), (1, "AError again"), (2, "nothing")], "chunk_id int, chunk string")
    out = facts.held_out(df)
    assert sorted((r.chunk_id, r.fact_type) for r in out.collect()) == [(0, "exception"), (0, "semantic:reason")]
    assert {r["class"]: r.n for r in facts.class_counts(out).collect()} == {"semantic": 1, "structural": 1}


def test_split_labels(spark):
    code = "def f(x):\n    return x.a.b\n"
    tree = labels.python_tree(code)
    assert tree[0][2] == "Module" and labels.scaffold_hops(tree, 0, labels.SCAFFOLDS["python"]) == 0
    assert labels.scaffold_hops(tree, code.index("x.a"), labels.SCAFFOLDS["python"]) == 4
    text = '{"k": [1, "é"], "m": {}}'
    kinds = [(text.encode()[s:e].decode(), k, p) for s, e, k, p in labels.json_tree(text)]
    assert kinds == [(text, "object", -1), ('"k": [1, "é"]', "pair", 0), ('"k"', "scalar", 1), ('[1, "é"]', "array", 1), ("1", "scalar", 3), ('"é"', "scalar", 3), ('"m": {}', "pair", 0), ('"m"', "scalar", 6), ("{}", "object", 6)]
    rows = docs(spark, [text, "{bad"]).withColumn("spans", S.token_spans(T.word_tokens(F.col("text"))))
    got = {r.doc_id: r for r in labels.split_labels(rows, "json", "text").collect()}
    assert got[0].is_code and not got[1].is_code and all(abs(a + b - 1) < 1e-12 for a, b in zip(got[0].w_semantic, got[0].w_dependency, strict=True))
    assert set(got[1].w_semantic) == {1.0} and set(labels.split_labels(rows, "text").first().w_dependency) == {0.0}
    assert api.model_file(None)[0] == "unset" and api.model_file("")[0] == "empty" and api.model_file("/no/such")[0] == "missing"
