"""Quality, language and rules: held-out accuracy, and defined results for odd rows."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import op3_quality, op4_language, op10_rules, subword
from logloom.llm.queries import queries

from . import models as M

SF = "/root/testdata/sf0.01"


def table(name, sf=SF):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


M64 = (1 << 64) - 1


def plain_features(text, f):
    """The bucket of each word and character n-gram, one at a time."""
    step, mix = 0x100000001B3, 0x9E3779B97F4A7C15

    def fold(h, kind):
        h = (h + kind) * mix & M64
        return ((h ^ h >> 32) * mix & M64) >> 64 - f.bits

    words = re.findall(r"[^\W\d_]+" if f.letters else r"\S+", text)
    if f.letters:
        words = ["".join(g) for k, g in itertools.groupby(text, str.isalpha) if k]
    out, hashes = [], []
    for w in words:
        c = [0, *[ord(x) + 1 for x in w], 0]
        for k in range(1, f.high + 1):
            for i in range(len(c) - k + 1):
                gram = c[i : i + k]
                if k == 1 and gram == [0] or 0 in gram[1:-1]:
                    continue
                h = 0
                for x in gram:
                    h = (h * step + x) & M64
                out.append(fold(h, k))
        hashes.append(sum((ord(x) + 1) * pow(step, i, 1 << 64) for i, x in enumerate(w, 1)) & M64)
        out.append(fold(hashes[-1], 0))
    if f.words > 1:
        out += [fold(a ^ b, f.high + 1) for a, b in itertools.pairwise(hashes)]
    return out


def test_features_equal_a_plain_model():
    for f in (op3_quality.FEATURES, op4_language.FEATURES, subword.Features(bits=10, high=2)):
        for t in [t or "" for t in M.TEXTS if len(t or "") < 3000] + [r["text"] for r in table("documents")[:15]]:
            text = t.lower() if f.letters else t
            assert sorted(f.of(t).tolist()) == sorted(plain_features(text, f)), repr(t[:60])


def test_quality_scores_equal_a_plain_model(spark):
    labels = {r["doc_id"]: r["quality"] for r in table("labels")}
    docs, truth = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = op3_quality.train_quality(docs, truth, held_out=op3_quality.held_out)
    rows = {r.doc_id: r for r in queries()["op3_quality"](spark, SF).collect()}
    for r in table("documents")[:150]:
        own = plain_features(r["text"], op3_quality.FEATURES)
        z = [float(model["bias"][k]) + sum(float(model["scores"][b, k]) for b in own) / max(1, len(own)) for k in (0, 1)]
        score = 1 / (1 + math.exp(z[0] - z[1]))
        assert abs(rows[r["doc_id"]].score - score) < 1e-6 and rows[r["doc_id"]].predicted == (rows[r["doc_id"]].score >= 0.5)
    assert labels


def test_features_equal_model():
    """The bucket of each n-gram depends on the n-gram alone, and words are cut as stated."""
    f = subword.Features(bits=12, high=3)
    one = sorted(f.of("ab cd").tolist())
    assert one == sorted(f.of("ab").tolist() + f.of(" \n cd ").tolist())
    assert len(f.of("ab")) == 2 + 3 + 2 + 1  # a b, <a ab b>, <ab ab>, the word
    assert len(f.of("")) == len(f.of(" \t")) == 0
    letters = subword.Features(bits=12, high=2, letters=True)
    assert sorted(letters.of("Ab1é!").tolist()) == sorted(letters.of("ab").tolist() + letters.of("É").tolist())


def test_training_separates():
    f = subword.Features(bits=12, high=3)
    rng = random.Random(0)
    texts = ["".join(rng.choice("abcde ") for _ in range(60)) for _ in range(60)] + ["".join(rng.choice("vwxyz ") for _ in range(60)) for _ in range(60)]
    y = [0] * 60 + [1] * 60
    model = subword.train([subword.bag(t, f) for t in texts], y, 2, f)
    assert np.mean([subword.probabilities(t, model).argmax() == k for t, k in zip(texts, y, strict=True)]) > 0.98
    assert abs(subword.probabilities("", model).sum() - 1) < 1e-9


def test_quality_held_out(spark):
    rows = queries()["op3_quality"](spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in table("labels")}
    assert len(rows) == len(table("documents")) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.93


def test_quality_of_odd_rows(spark):
    d = M.table(spark)
    labels = spark.createDataFrame([(6, 1), (9, 0), (9, 1), (17, 0), (None, 1), (15, None)], "doc_id bigint, quality int")
    rows = op3_quality.quality_scores(d, labels).collect()
    assert len(rows) == len(M.TEXTS) and all(0 <= r.score <= 1 for r in rows)
    none = op3_quality.quality_scores(d, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert op3_quality.quality_scores(d.limit(0), labels).count() == 0
    again = op3_quality.quality_scores(d, labels).collect()
    assert sorted(rows) == sorted(again)


def test_language_held_out(spark):
    rows = queries()["op4_language"](spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in table("documents")}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.98
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows)


def test_language_of_odd_rows(spark):
    d = M.table(spark, lang=lambda i: None if i % 5 == 0 else "de" if i % 2 else "en")
    rows = {r.doc_id: r for r in op4_language.languages(d).collect()}
    for i, t in enumerate(M.TEXTS):
        bare = not any(c.isalpha() for c in t or "")
        assert (rows[i].lang_pred == "und") == bare and rows[i].lang_pred in ("und", "de", "en")
        assert not bare or rows[i].rejected
    assert op4_language.languages(d.limit(0)).count() == 0
    unlabelled = op4_language.languages(M.table(spark, lang=lambda i: None)).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


#: Sentences of languages that the tables don't hold, repeated to the length of a document.
FOREIGN = [
    "A gyors barna róka átugrik a lusta kutya fölött, és a kertben alszik egész délután.", "Бързата кафява лисица прескача мързеливото куче и спи цял следобед в градината.",
    "素早い茶色の狐はのろまな犬を飛び越え、午後はずっと庭で眠っている。", "Nopea ruskea kettu hyppää laiskan koiran yli ja nukkuu puutarhassa koko iltapäivän.",
    "Szybki brązowy lis przeskakuje nad leniwym psem i śpi w ogrodzie przez całe popołudnie.", "Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί και κοιμάται στον κήπο.",
]


def test_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(1_000_000 + i, " ".join([t] * 12), None) for i, t in enumerate(FOREIGN)], "doc_id bigint, text string, lang string")
    rows = op4_language.languages(docs.unionByName(more)).collect()
    assert all(r.rejected and r.lang_pred in ("de", "en", "es", "fr") for r in rows if r.doc_id >= 1_000_000)
    assert np.mean([r.rejected for r in rows if r.doc_id < 1_000_000]) < 0.005


def test_language_predictions_equal_a_plain_model(spark):
    """Scores from the features one by one, at the temperature that a plain search finds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    known = docs.where(~op4_language.held_out("doc_id")).select(F.col("doc_id").alias("id"), "text", "lang")
    counts = op4_language.language_counts(known, "lang")
    model = op4_language.train_language(known, counts)
    names = model["names"]
    z = {r["doc_id"]: [float(model["bias"][k]) + float(np.mean([model["scores"][b, k] for b in plain_features(r["text"].lower(), op4_language.FEATURES)], dtype=np.float64)) for k in range(len(names) + 1)] for r in table("documents")[:120]}
    for r in table("documents")[:120]:
        assert np.allclose(z[r["doc_id"]], subword.logits(r["text"], model), atol=1e-6)
    told = spark.createDataFrame([(x, names.index(r["lang"])) for r in table("documents")[:120] for x in [z[r["doc_id"]]]], "z array<double>, truth int")

    def loss(t):
        return sum(math.log(sum(math.exp(v / t) for v in r.z)) - r.z[r.truth] / t for r in told.collect())

    t = op4_language.temperature_of(told)
    assert t in op4_language.TEMPERATURES and loss(t) <= min(map(loss, op4_language.TEMPERATURES)) + 1e-9
    got = spark.createDataFrame([(i, x) for i, x in z.items()], "i bigint, z array<double>").select("i", op4_language.best_of(F.col("z"), len(names), t).alias("p")).collect()
    for r in got:
        e = [math.exp((v - max(z[r.i])) / t) for v in z[r.i]]
        assert abs(r.p - max(e[:-1]) / sum(e)) < 1e-9


def test_language_calibration(spark):
    rows = [(0.3, False), (0.32, False), (0.35, True), (0.9, True), (0.95, True)] * 3
    df = spark.createDataFrame(rows, "score double, wanted boolean")
    odds = lambda p: math.log(p / (1 - p))
    assert odds(0.32) < op4_language.calibrate(df) < odds(0.35)
    assert op4_language.calibrate(df.where("wanted")) == op4_language.calibrate(df.limit(0)) == -math.inf


def test_noise_moves_letters_only():
    texts = ["Some words, and 12 numbers!", "", "éàü ß " * 50]
    for t in texts:
        n = op4_language.noise(t)
        assert n == op4_language.noise(t) and len(n) == len(t.lower())
        assert [c.isalpha() for c in n] == [c.isalpha() for c in t.lower()]


def test_statistics_equal_model():
    rng = random.Random(3)
    texts = [t or "" for t in M.TEXTS] + ["".join(rng.choice(["a ", "b ", "c\n", "a b c ", "#", "\t", "é "]) for _ in range(rng.randrange(40))) for _ in range(300)]
    for t in texts:
        assert op10_rules.statistics(t)[:5] == M.statistics(t), repr(t[:80])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_rules_query(spark, sf):
    rows = queries()["op10_rules"](spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in table("documents", sf)}
    good = {r["doc_id"] for r in table("labels", sf) if r["quality"] == 1}
    assert len(rows) == len(docs)
    for r in rows:
        s = M.statistics(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and not (r.kept and r.base_failed)
    ours = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert np.mean([r.kept for r in ours]) >= 0.99
    bad = [r for r in rows if not r.base_failed and r.n_symbols > 0.08 * r.word_chars]
    assert bad and np.mean([r.kept for r in bad]) < 0.3


@pytest.mark.parametrize("labels", [[], [(6, 1), (16, 1), (16, 0), (None, 1)]])
def test_rules_of_odd_rows(spark, labels):
    d = M.table(spark)
    rows = op10_rules.quality_rules(d, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert len(rows) == len(M.TEXTS) and not any(r.kept for r in rows if r.n_words < 50)
    assert op10_rules.quality_rules(d.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int")).count() == 0


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    s = op10_rules.Forest(x).scores(x)
    assert s.argmax() == 500 and ((0 < s) & (s < 1)).all()
    same = op10_rules.Forest(np.ones((5, 2))).scores(np.ones((2, 2)))
    assert same[0] == same[1]


def test_forest_draws_of_all_rows(spark):
    """Each tree's rows are the least of all rows by its hash, and tails are counted over all rows."""
    n = 12_000  # more than any pool of 8,192
    stats = [F.expr(e).alias(c) for c, e in zip(op10_rules.STATS, ("50 + id % 997", "id", "id % 7", "id % 11", "id % 13", "id % 5", "id % 3"), strict=True)]
    rows = spark.range(n).select(F.xxhash64("id").alias("h"), *stats).cache()
    every = rows.collect()
    h, x = np.array([r.h for r in every]), np.array([tuple(r)[1:] for r in every], np.int64)
    got = op10_rules.drawn(rows, n, trees=128)
    for t, own in enumerate(got):
        least = np.argsort(op10_rules.tree_hash(h, t))[: op10_rules.ROWS]
        assert np.array_equal(own, x[least])
    assert len({r for own in got for r in own[:, 1].tolist()}) > 10_000  # the trees' rows come from everywhere
    varied = op10_rules.shares(x)[:, op10_rules.VARIED]
    at = int(op10_rules.TAIL * (n - 1))
    assert np.array_equal(op10_rules.ordinary(rows, n), np.sort(varied, axis=0)[[at, n - 1 - at]])
    same = spark.range(600).select(F.lit(5).cast("long").alias("h"), *[F.lit(60).cast("long").alias(c) for c in op10_rules.STATS])
    assert [len(own) for own in op10_rules.drawn(same, 600, trees=3)] == [256] * 3
