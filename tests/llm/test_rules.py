"""The forest's threshold: bad rows are caught where labels are few."""

import math

import numpy as np
import pytest

from logloom.llm import op10_rules
from logloom.llm.queries import queries

from .test_models import SF, table


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_bad_rows_are_caught(spark, sf):
    kept = {r.doc_id: r.kept for r in queries()["op10_rules"](spark, sf).collect() if not r.base_failed}
    labels = [(kept[r["doc_id"]], r["quality"]) for r in table("labels", sf) if r["doc_id"] in kept]
    bad, good = ([k for k, q in labels if q == want] for want in (0, 1))
    assert len(bad) > 20 and sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.99 * len(good)


def plain_score(forest, row):
    """The score of one row by walking each tree from its root."""
    total = 0.0
    for feature, split, left, path in forest.trees:
        at = 0
        while feature[at] >= 0:
            at = left[at] + (1 if row[feature[at]] > split[at] else 0)
        total += path[at]
    return 2.0 ** (-total / len(forest.trees) / forest.usual)


def plain_features(s, usual):
    words, chars, letters = max(s[0], 1), max(s[1], 1), max(s[6], 1)
    out = [s[2] / chars, s[2] / words, s[1] / words, s[5] / letters]
    for k, v in enumerate((s[4] / words, s[3] / words, math.log(words))):
        out.append(v - min(max(v, usual[0][k]), usual[1][k]))
    return out


def test_verdicts_equal_a_plain_model(spark):
    """Scores by plain walks, the threshold by trying all of them, verdicts from both."""
    docs, labels = table("documents"), {r["doc_id"]: r["quality"] for r in table("labels")}
    stats = {r["doc_id"]: op10_rules.statistics(r["text"] or "") for r in docs}
    good = {i: s for i, s in stats.items() if not (s[0] < 50 or 100 * s[4] > 50 * s[0])}
    some = np.array(sorted(good.values()))  # fewer than the sample's bound, so all of them
    usual = op10_rules.ordinary(op10_rules.shares(some))
    forest = op10_rules.Forest(op10_rules.features(some, usual))
    score = {i: plain_score(forest, plain_features(s, usual)) for i, s in good.items()}
    ours = [(score[i], labels[i]) for i in score if i in labels]
    n = [sum(q == k for _, q in ours) for k in (0, 1)]
    gain = lambda t: sum(x >= t and q == 0 for x, q in ours) / n[0] - 5 * sum(x >= t and q == 1 for x, q in ours) / n[1]
    limit = max((k / op10_rules.BINS for k in range(op10_rules.BINS + 2)), key=lambda t: (round(gain(t), 9), t))
    rows = {r.doc_id: r for r in queries()["op10_rules"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for i, r in rows.items():
        assert r.kept == (i in good and score[i] < limit)
        assert i not in good or abs(r.score - score[i]) < 1e-9


def test_threshold_of_both_labels(spark):
    rows = [(0.4, 1)] * 90 + [(0.6, 1)] * 2 + [(0.55, 0)] * 10 + [(0.3, 0)]
    df = spark.createDataFrame(rows, "score double, quality int")
    assert op10_rules.calibrate(df, 1) == pytest.approx(0.55, abs=1e-3)
    assert op10_rules.calibrate(df.where("quality = 1")) == op10_rules.calibrate(df.where("quality = 0")) == 2.0
