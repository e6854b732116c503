import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking as R
from tidemark.plans import forest as FO
from tidemark.plans import training as TR
from tidemark.plans.boosting import GrownTree, _mix, _salt

SETTINGS = TR.BoostSettings(column_share=1.0, row_share=0.8, forest_trees=3, forest_depth=3, seed=7)


def table(spark, n=400, times=3, parts=2):
    rng = np.random.default_rng(2)
    x = np.stack([rng.integers(0, 6, n), rng.integers(0, 4, n)], axis=1).astype(float)
    label = ((x[:, 0] >= 3) ^ (rng.random(n) < 0.2)).astype(int)
    x, label = np.repeat(x, times, axis=0), np.repeat(label, times)
    rows = pd.DataFrame({"id": range(len(x)), "label": label, "weight": np.where(label == 1, 1.5, 1.0), "inputs": list(x)})
    return rows, spark.createDataFrame(rows).repartition(parts)


def plain(x, label, weight, times, cuts, depth):
    """{node: (share of positives, cover)} of a tree grown row by row over the rows as they are drawn."""
    out, pending = {}, [(0, np.ones(len(x), bool), 0)]
    w = weight * times
    while pending:
        i, here, level = pending.pop()
        pos, all_ = (w * (label == 1))[here].sum(), w[here].sum()
        out[i] = (pos / all_, all_)
        if level == depth or pos in (0, all_):
            continue
        best = (1e-12, None)
        for f in range(x.shape[1]):
            for cut in cuts[f]:
                left = here & (x[:, f] <= cut)
                right = here & ~left
                a, b = w[left].sum(), w[right].sum()
                if not a or not b:
                    continue
                p, q, r = (w * (label == 1))[left].sum(), (w * (label == 1))[right].sum(), pos
                gain = ((p**2 + (a - p) ** 2) / a + (q**2 + (b - q) ** 2) / b - (r**2 + (all_ - r) ** 2) / all_) / all_
                if gain > best[0] + 1e-12:
                    best = (gain, (left, right))
        if best[1]:
            pending += [(2 * i + 1, best[1][0], level + 1), (2 * i + 2, best[1][1], level + 1)]
    return out


def test_trees_are_those_of_the_single_rows(spark):
    rows, df = table(spark)
    x, label, weight = np.stack(rows["inputs"]), rows["label"].to_numpy(), rows["weight"].to_numpy()
    rid = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    rid = np.array([rid[i] for i in rows["id"]], np.int64).view(np.uint64)
    model = FO.fit_forest(df, SETTINGS)
    assert model.getNumTrees == 3
    cuts = [np.unique(np.quantile(x[:, f], [k / 64 for k in range(1, 64)])) for f in range(2)]
    for t, tree in enumerate(model.trees):
        want = plain(x, label, weight, FO.poisson_counts(rid, _salt(7, t), 0.8), cuts, 3)
        got = {i: (tree.value[i], tree.cover[i]) for i in range(len(tree.cover)) if tree.cover[i]}
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_layout_and_groups_of_trees_do_not_matter(spark, monkeypatch):
    one = FO.fit_forest(table(spark)[1], SETTINGS)
    monkeypatch.setattr(FO, "TREES_PER_TASK", 1)
    monkeypatch.setattr(FO, "DRAWS_HELD", 1)
    monkeypatch.setattr(FO, "ROWS_PER_TASK", 10)
    two = FO.fit_forest(table(spark, parts=5)[1], SETTINGS)
    for a, b in zip(one.trees, two.trees):
        assert all(np.array_equal(getattr(a, n), getattr(b, n)) for n in ("feature", "cut", "threshold", "value", "cover"))


def test_draws_are_poisson():
    rid = _mix(np.arange(200_000, dtype=np.uint64))
    counts = FO.poisson_counts(rid, _salt(1, 5), 0.8)
    assert abs(counts.mean() - 0.8) < 0.01 and abs(counts.var() - 0.8) < 0.02 and counts.max() < 12


def test_no_split_without_two_classes_or_gain(spark):
    rows = [(i, 0, 1.0, [float(i)]) for i in range(20)]
    model = FO.fit_forest(spark.createDataFrame(rows, "id int, label int, weight double, inputs array<double>"), SETTINGS)
    assert all((t.feature == -1).all() and t.value[0] == 0.0 for t in model.trees)


def test_equal_rows_scored_once_give_the_same_numbers(spark):
    df = spark.createDataFrame([(0, 0.1, 0.3, 4), (1, 0.9, 0.8, 2), (0, 0.8, 0.2, 1), (1, 0.4, 0.9, 3)], "label int, a double, b double, n int")
    each = df.withColumn("_", F.explode(F.sequence(F.lit(1), "n")))
    m = spark.createDataFrame([("a", 0.5), ("b", 0.6), ("ensemble", 0.7)], "model string, pr_auc double")
    one, two = (TR.ensemble_summary(d, "a", "b", m, t).first() for d, t in ((df, "n"), (each, None)))
    assert one["correlation"] == pytest.approx(two["correlation"], abs=1e-12) == pytest.approx(each.agg(F.corr("a", "b")).first()[0], abs=1e-12)
    g = df.withColumn("g", F.lit(1))
    first, second = (R.metric_block(d, "a", "label", ["g"], times=t).first().asDict() for d, t in ((g, "n"), (each.withColumn("g", F.lit(1)), None)))
    assert first == pytest.approx(second)
    assert GrownTree.bare(1).of_inputs(np.zeros((2, 1))).tolist() == [0.0, 0.0]
