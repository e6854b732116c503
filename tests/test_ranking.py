import numpy as np
import pandas as pd
import pytest

from tidemark.operators import bootstrap as B
from tidemark.operators import ranking as R
from tidemark.plans import gate as G


def frame(spark, y, p, **more):
    return spark.createDataFrame(pd.DataFrame({"y": y, "p": p, **more}))


def average_precision(y, p, w=None):
    w = np.ones(len(y)) if w is None else w
    total, ap, tp, fp = (w * (y == 1)).sum(), 0.0, 0.0, 0.0
    for s in sorted(set(p), reverse=True):
        pos, neg = (w * ((p == s) & (y == 1))).sum(), (w * ((p == s) & (y == 0))).sum()
        tp, fp = tp + pos, fp + neg
        if tp + fp:
            ap += pos / total * tp / (tp + fp)
    return ap


def roc_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    y = (rng.random(3_000) < 0.1).astype(int)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    p[rng.random(3_000) < 0.34] = 0.5
    return y, p


@pytest.mark.parametrize("rows_per_range", [20, 400, 10**9])
def test_metrics_equal_brute_force_over_any_ranges(spark, sample, rows_per_range):
    y, p = sample
    df = frame(spark, y, p).repartition(4)
    cuts = R.score_cuts(df, "p", rows_per_range)
    row = R.ranking_metrics(df, "p", "y", cuts=cuts).first()
    assert row["pr_auc"] == pytest.approx(average_precision(y, p), abs=1e-12)
    assert row["roc_auc"] == pytest.approx(roc_auc(y, p), abs=1e-12)
    best = R.best_f1(df, "p", "y", cuts=cuts).first()
    scored = []
    for t in sorted(set(p)):
        tp, fp, fn = ((p >= t) & (y == 1)).sum(), ((p >= t) & (y == 0)).sum(), ((p < t) & (y == 1)).sum()
        scored.append((2 * tp / (2 * tp + fp + fn), -t))
    f1, t = max(scored)
    assert best["f1"] == pytest.approx(f1, abs=1e-9)


def test_hand_counted_confusion(spark):
    row = R.confusion(frame(spark, [0, 0, 1, 1, 1], [0.1, 0.6, 0.4, 0.8, 0.9]), "p", "y", 0.5).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (2, 1, 1, 1)
    assert row["precision"] == row["recall"] == row["f1"] == pytest.approx(2 / 3)
    none = R.confusion(frame(spark, [0, 1], [0.1, 0.2]), "p", "y", 0.9).first()
    assert none["precision"] == none["recall"] == none["f1"] == 0.0


def test_perfect_and_useless_rankings(spark):
    y = np.array([0] * 90 + [1] * 10)
    assert R.ranking_metrics(frame(spark, y, y * 0.8), "p", "y").first()["pr_auc"] == 1.0
    flat = R.ranking_metrics(frame(spark, y, y * 0 + 0.5), "p", "y").first()
    assert flat["pr_auc"] == pytest.approx(0.1) and flat["roc_auc"] == 0.5 and flat["lift"] == pytest.approx(1.0)


def test_degenerate_labels_are_refused(spark):
    one_class = R.ranking_metrics(frame(spark, [0, 0], [0.1, 0.2]), "p", "y")
    assert one_class.first()["pr_auc"] is None
    with pytest.raises(R.DegenerateLabelsError):
        R.require_two_classes(one_class)
    with pytest.raises(R.DegenerateLabelsError):
        R.positive_weight(frame(spark, [0, 0], [0.1, 0.2]), "y")


def test_ties_take_the_lowest_threshold(spark):
    assert R.best_f1(frame(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.6]), "p", "y").first()["threshold"] == 0.7


def paired(spark, n=1_500, hot=True):
    rng = np.random.default_rng(21)
    y = (rng.random(n) < 0.1).astype(int)
    a, b = (np.round(np.clip(rng.normal(0.4 + d * y, 0.2), 0, 1), 3) for d in (0.1, 0.25))
    if hot:
        a[rng.random(n) < 0.4] = 0.25
        b[rng.random(n) < 0.35] = 0.625
    ids = np.arange(n) * 13 + 5
    return ids, y, a, b, spark.createDataFrame(pd.DataFrame({"id": ids, "y": y, "p_champion": a, "p_challenger": b})).repartition(3)


@pytest.mark.parametrize("rows_per_range", [50, 400, 10**9])
def test_bootstrap_equals_brute_force_with_hot_scores(spark, rows_per_range):
    ids, y, a, b, df = paired(spark)
    if rows_per_range < 1_000:
        long = G.long_scores(df, ["y"])
        assert B.score_plan(long, rows_per_range)[1], "the fixture should have hot scores"
    w = B.draw_weights(ids.astype(np.int64), np.arange(12), 42)
    got = {(r["model"], r["b"]): r["ap"] for r in B.bootstrap_average_precision(df, 12, rows_per_range=rows_per_range).collect()}
    assert len(got) == 24
    for name, p in (("p_champion", a), ("p_challenger", b)):
        for k in range(12):
            assert got[(name, k)] == pytest.approx(average_precision(y, p, w[:, k]), abs=1e-9)


def test_drawn_weights_take_a_byte_and_follow_the_written_rule():
    ids, draws = np.array([0, 1, B.MODULUS - 1, B.MODULUS, 2**40 + 3, -5], dtype=np.int64), np.arange(40_000)
    w = B.draw_weights(ids, draws, 42)
    assert w.nbytes == w.size
    for i, key in enumerate(ids.tolist()):
        for b in range(0, 40_000, 97):
            x = (((key % B.MODULUS) * 48_271 + 42 * 69_621 + 1) % B.MODULUS) ^ (b * 1_640_531_527 % B.MODULUS)
            x = x * 48_271 % B.MODULUS
            x = (x ^ (x >> 15)) * 69_621 % B.MODULUS
            x = (x ^ (x >> 13)) * 16_807 % B.MODULUS
            assert w[i, b] == sum(x >= step for step in B.POISSON_STEPS)


@pytest.mark.parametrize("block", [1, 36, 10**6])
def test_runs_of_equal_scores_may_cross_blocks(monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK_CELLS", block)
    rng = np.random.default_rng(4)
    ids, y, score = np.arange(300), rng.random(300) < 0.2, np.round(rng.random(300), 2)
    rows = pd.DataFrame({"id": ids, "y": y.astype(int), "score": score})
    offset = pd.DataFrame({"above_pos": [np.arange(12.0)], "above_neg": [np.zeros(12)]})
    got = B._parts(12, 42)(("m", 0.0), rows, offset)["part"][0]
    w, want = B.draw_weights(ids, np.arange(12), 42).astype(float), np.zeros(12)
    for s in np.unique(score):
        tp = np.arange(12.0) + w[(score >= s) & y].sum(axis=0)
        total = tp + w[(score >= s) & ~y].sum(axis=0)
        want += w[(score == s) & y].sum(axis=0) * np.divide(tp, total, out=np.zeros(12), where=total > 0)
    assert np.allclose(got, want, rtol=1e-12)


def test_bootstrap_weights_are_poisson():
    w = B.draw_weights(np.arange(20_000, dtype=np.int64), np.arange(20), 42)
    assert w.mean() == pytest.approx(1.0, abs=0.01) and w.var() == pytest.approx(1.0, abs=0.02)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03


def test_self_comparison_has_no_error_and_one_positive_does_not_fail(spark):
    _, _, a, _, df = paired(spark, hot=False)
    same = df.withColumn("p_challenger", df.p_champion)
    assert B.paired_bootstrap(same, 50).first()["standard_error"] == 0.0
    rare = spark.createDataFrame([(i, int(i == 0), i / 100, 1 - i / 100) for i in range(100)],
                                 "id long, y int, p_champion double, p_challenger double")
    row = B.paired_bootstrap(rare, 40).first()
    assert 2 <= row["resamples_used"] < 40


def test_bootstrap_error_is_near_the_index_drawn_one(spark):
    ids, y, a, b, df = paired(spark, hot=False)
    rng = np.random.default_rng(0)
    deltas = []
    for _ in range(200):
        i = rng.integers(0, len(y), len(y))
        deltas.append(average_precision(y[i], b[i]) - average_precision(y[i], a[i]))
    got = B.paired_bootstrap(df, 300).first()["standard_error"]
    assert got == pytest.approx(np.std(deltas, ddof=1), rel=0.25)
