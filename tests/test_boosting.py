"""The booster that continues, against a plain version, refits and other layouts; attribution against enumeration."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking as R
from tidemark.plans import boosting as B
from tidemark.plans import explain as XP
from tidemark.plans import training as TR
from tidemark.plans import trees

SETTINGS = TR.BoostSettings(depth=3, step=0.3, ceiling=30, patience=4, block=5, row_share=1.0, column_share=1.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 1_500
    signal, noise, code = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 4, n).astype(float)
    label = (signal + 0.5 * (code == 2) + rng.normal(0, 0.7, n) > 1.3).astype(int)
    frame = pd.DataFrame({"id": range(n), "label": label, "weight": np.where(label == 1, 3.5, 1.0), "inputs": [list(x) for x in zip(signal, noise, code, np.ones(n))]})
    return spark.createDataFrame(frame, "id long, label int, weight double, inputs array<double>").persist(), frame


def plain_tree(x, g, h, depth):
    """Node values of one tree by direct search over the same bins."""
    out = np.zeros(len(x))

    def split(mask, level):
        G, H = g[mask].sum(), h[mask].sum()
        best = (1e-12, None)
        if level < depth:
            for f in range(x.shape[1]):
                for cut in range(B.BINS - 1):
                    left = mask & (x[:, f] <= cut)
                    hl, hr = h[left].sum(), H - h[left].sum()
                    if hl < B.LEAST_HESSIAN or hr < B.LEAST_HESSIAN:
                        continue
                    gl = g[left].sum()
                    gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (hr + 1) - G**2 / (H + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
        if best[1] is None:
            out[mask] = -SETTINGS.step * G / (H + 1)
            return
        f, cut = best[1]
        split(mask & (x[:, f] <= cut), level + 1)
        split(mask & (x[:, f] > cut), level + 1)

    split(np.ones(len(x), bool), 0)
    return out


def test_trees_equal_a_plain_search(rows):
    df, frame = rows
    growth = B.Growth.start(df, SETTINGS).grow(3)
    x = np.array(frame["inputs"].tolist())
    bins = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(growth.edges)])
    y, w, margin = frame["label"].to_numpy(), frame["weight"].to_numpy(), np.zeros(len(frame))
    for tree in growth.trees:
        p = 1 / (1 + np.exp(-margin))
        want = plain_tree(bins, w * (p - y), w * p * (1 - p), SETTINGS.depth)
        assert np.allclose(tree.of_bins(bins), want, atol=1e-6) and np.allclose(tree.of_inputs(x), want, atol=1e-6)
        margin = margin + want
    growth.close()


def same(a, b):
    return all(np.array_equal(getattr(s, f), getattr(t, f)) for s, t in zip(a, b, strict=True) for f in ("feature", "cut", "threshold", "value", "cover"))


def test_going_on_equals_a_longer_fit_in_any_layout(rows, monkeypatch):
    df, _ = rows
    drawn = SETTINGS.override(row_share=0.7, column_share=0.6)
    whole = B.Growth.start(df, drawn).grow(13)
    parts = B.Growth.start(df, drawn).grow(4).grow(9)
    monkeypatch.setattr(B, "ROWS_PER_TASK", 200)
    monkeypatch.setattr(B, "CARRY", 3)
    spread = B.Growth.start(df.repartition(7, "inputs"), drawn).grow(13)
    assert spread.tasks == 8 and same(whole.trees, parts.trees) and same(whole.trees, spread.trees)
    used = {int(f) for t in whole.trees for f in t.feature if f >= 0}
    assert 3 not in used and len(used) >= 2  # a constant input is never cut


def test_history_equals_scores_of_every_prefix(spark, rows):
    df, _ = rows
    fit, stop = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    stopped = TR.fit_early_stopping(fit, stop, SETTINGS)
    assert [k for k, _ in stopped.history] == list(range(1, len(stopped.history) + 1))
    assert len(stopped.history) == stopped.best_round + SETTINGS.patience == stopped.model.getNumTrees + SETTINGS.patience
    longer = B.Growth.start(fit, SETTINGS).grow(len(stopped.history))
    for k, value in stopped.history[::3]:
        scored = TR.positive_probability(longer.model.prefix(k), stop, k, ["label"])
        assert R.ranking_metrics(scored, "score", "label").first()["pr_auc"] == pytest.approx(value, abs=1e-12)
    assert same(stopped.model.trees, longer.trees[: stopped.best_round])


def test_one_class_stops_at_once(rows):
    df, _ = rows
    stopped = TR.fit_early_stopping(df, df.where("label = 0"), SETTINGS)
    assert stopped.best_round == 0 and stopped.history == [] and stopped.model.getNumTrees == 0


def test_saved_model_scores_alike(spark, rows, tmp_path):
    df, _ = rows
    model = B.Growth.start(df, SETTINGS).grow(4).model
    model.save(spark, str(tmp_path / "model"))
    again = B.BoostedTrees.load(spark, str(tmp_path / "model"))
    assert same(model.trees, again.trees)
    both = again.append(model.append(df, "one"), "two")
    assert both.where("one <> two").count() == 0
    with pytest.raises(ValueError):
        TR.positive_probability(model, df, trees=3)


def enumerated(leaf, x, scale, phi, owner):
    m = len(leaf.features)
    inside = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi in zip(leaf.features, leaf.low, leaf.high)]
    for j in range(m):
        others = [i for i in range(m) if i != j]
        total = np.zeros(len(x))
        for size in range(m):
            for chosen in combinations(others, size):
                term = np.full(len(x), factorial(size) * factorial(m - size - 1) / factorial(m))
                for i in others:
                    term *= inside[i] if i in chosen else leaf.share[i]
                total += term
        phi[:, owner[leaf.features[j]]] += scale * leaf.value * (inside[j] - leaf.share[j]) * total


@pytest.mark.parametrize("m", [1, 4, 8])
def test_recurrence_equals_enumeration(m):
    rng = np.random.default_rng(m)
    x = rng.normal(size=(300, m))
    for share in (rng.uniform(0.01, 1, m), np.where(np.arange(m) % 3 == 1, 0.0, 0.4), np.ones(m)):
        low = np.where(rng.random(m) < 0.5, -np.inf, -0.5)
        leaf = trees.Leaf(1.7, tuple(range(m)), tuple(low), tuple(low + 2.0), tuple(share))
        got, want = np.zeros((300, m)), np.zeros((300, m))
        base = trees._leaf_attribution(leaf, x, 2.0, got, np.arange(m))
        enumerated(leaf, x, 2.0, want, np.arange(m))
        assert np.abs(got - want).max() < 1e-9
        assert base == pytest.approx(2.0 * 1.7 * np.prod(share))


def test_deep_boosted_trees_add_up(spark, rows):
    df, _ = rows
    model = B.Growth.start(df, SETTINGS.override(depth=8, column_share=0.9)).grow(3).model
    explained = trees.attributions(model.tables(), model.append(df, "score"), [0, 1, 2, 3], ["id", "score"])
    assert XP.additivity(explained, "score").first()["max_error"] < 1e-9
    assert explained.where(F.abs(F.col("score") - F.col("probability")) > 1e-12).count() == 0


def test_equal_rows_are_stored_once_and_drawn_one_by_one(spark):
    n = 3_000
    frame = pd.DataFrame({"id": range(n), "label": [i % 7 == 0 for i in range(n)], "inputs": [[float(i % 5), float(i % 3)] for i in range(n)]})
    df = spark.createDataFrame(frame, "id long, label boolean, inputs array<double>").select("id", F.col("label").cast("int").alias("label"), F.lit(1.0).alias("weight"), "inputs")
    growth = B.Growth.start(df, SETTINGS.override(row_share=0.7))
    stored = growth.rows.agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum("d3").alias("drawn")).first()
    rid = df.select(F.xxhash64("id")).toPandas().to_numpy()[:, 0].view(np.uint64)
    salt = np.random.default_rng([SETTINGS.seed, 3]).integers(0, 1 << 63, dtype=np.uint64)
    assert stored["n"] == n and stored["rows"] <= 60
    assert stored["drawn"] == (B._mix(rid ^ salt).astype(float) < 0.7 * 2.0**64).sum()
    growth.close()


def test_trees_by_cells_equal_leaf_by_leaf(spark, rows):
    df, frame = rows
    tables = B.Growth.start(df, SETTINGS).grow(4).model.tables()
    x, owner = np.array(frame["inputs"].tolist()), np.array([0, 1, 2, 0])
    known = trees.cells(tables, x.shape[1], owner)
    assert all(c is not None for c in known)
    x[0, 0] = known[0].cuts[0][0]
    for one, other in zip(trees.evaluate(tables, x, owner, known), trees.evaluate(tables, x, owner)):
        assert np.abs(one - other).max() < 1e-12
