import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking as R
from tidemark.plans import explain as XP
from tidemark.plans import training as TR
from tidemark.plans.trees import attributions, staged_probabilities, tree_tables
from tidemark.session import small_table

SETTINGS = TR.BoostSettings(depth=3, step=0.3, ceiling=6, patience=2, block=2, forest_trees=3, forest_depth=3)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(4)
    n = 900
    signal, sparse = rng.normal(size=n), np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n))
    label = (signal + np.nan_to_num(sparse) + rng.normal(0, 0.5, n) > 1.2).astype(int)
    raw = spark.createDataFrame(pd.DataFrame({"id": range(n), "label": label, "signal": signal, "sparse": sparse,
                                              "code": rng.integers(0, 3, n).astype(float)}))
    encoded = raw.withColumn("sparse", F.expr("nullif(sparse, double('NaN'))"))
    inputs = TR.TreeInputs.fit(encoded, ["signal", "sparse", "code"])
    ready = inputs.apply(encoded, ["id", "label"])
    train = TR.fixed_layout(TR.with_weights(ready), ["id"]).persist()
    return inputs, train, TR.boosted(SETTINGS, 5).fit(train)


def test_missing_inputs_get_a_flag_and_a_fill(fitted):
    inputs, train, _ = fitted
    assert inputs.columns == ["signal", "sparse", "code", "sparse__missing"] and inputs.owner() == [0, 1, 2, 1]
    assert all(len(r["inputs"]) == 4 for r in train.limit(3).collect())


def test_staged_scores_equal_shorter_models(fitted):
    _, train, model = fitted
    staged = staged_probabilities(tree_tables(model), train, 0, 5)
    for k in (2, 5):
        shorter = TR.boosted(SETTINGS, k).fit(train)
        want = sorted(r["score"] for r in TR.positive_probability(shorter, train, k).collect())
        got = sorted(r["score"] for r in staged.where(F.col("round") == k).collect())
        assert np.allclose(got, want, atol=1e-12)


def test_attributions_add_up_and_equal_subset_enumeration(fitted):
    inputs, train, model = fitted
    tables = tree_tables(model)
    rows = attributions(tables, train, inputs.owner(), ["id"])
    assert XP.additivity(rows).first()["max_error"] < 1e-9
    own = {r["id"]: r["score"] for r in TR.positive_probability(model, train, keep=["id"]).collect()}
    assert all(abs(own[r["id"]] - r["probability"]) < 1e-9 for r in rows.collect())


def test_wrong_tree_count_is_refused(fitted):
    _, train, model = fitted
    with pytest.raises(ValueError):
        TR.positive_probability(model, train, trees=4)


def test_patience_keeps_the_first_best_round():
    assert TR.first_best([(1, 0.5), (2, 0.6), (3, 0.6), (4, 0.55)], 2) == (2, True)
    assert TR.first_best([(1, 0.5), (2, 0.6)], 2) == (2, False)


def test_early_stopping_keeps_a_prefix(fitted):
    _, train, _ = fitted
    stopped = TR.fit_early_stopping(train, train, SETTINGS)
    assert stopped.model.getNumTrees == stopped.best_round == max(stopped.history, key=lambda h: (h[1], -h[0]))[0]


def test_loss_attribution_is_suppressed_when_implausible(spark):
    rows = small_table(spark, [("a", 0.53, 0.51), ("b", 0.9, 0.5)], "k string, probe double, now double")
    a, b = TR.attribute_loss(rows, "probe", "now", 0.5477).orderBy("k").collect()
    assert a["carve_delta"] == pytest.approx(-0.0177) and a["stopping_delta"] == pytest.approx(-0.02)
    assert b["suppressed"] and b["stopping_delta"] is None


def test_sweep_picks(spark):
    rows = small_table(spark, [("x", 4, 10, 0.5, 0.8), ("y", 6, 9, 0.52, 0.9)],
                       "config string, depth int, trees int, val_pr_auc double, train_pr_auc double")
    got = {r["config"]: (r["best_score"], r["smallest_gap"]) for r in TR.sweep_table(rows, 0.5).collect()}
    assert got == {"x": (False, True), "y": (True, False)}


def test_top_factors_and_breakdown(spark):
    df = small_table(spark, [(1, [0.1, -0.5, 0.3], 0.2, 0.5)], "id int, phi array<double>, base double, probability double")
    names = ["a", "b", "c"]
    row = df.select(XP.top_factors(F.col("phi"), names, 2).alias("t"), XP.remainder(F.col("phi"), names, 2).alias("r")).first()
    assert [(f["feature"], f["direction"]) for f in row["t"]] == [("b", "toward legitimate"), ("c", "toward fraud")]
    assert row["r"] == pytest.approx(0.1)
    lines = XP.breakdown(df, names, {}, ["id"], 2, 0.4).collect()
    assert [x["term"] for x in lines] == ["base", "b", "c", "+ 1 other features", "margin"]
    assert lines[-1]["contribution"] == pytest.approx(0.1) and lines[0]["decision"] == "BLOCK"
    with pytest.raises(XP.AdditivityError):
        XP.require_additive(df.withColumn("probability", F.lit(0.9)))


def test_a_sweep_scores_equal_rows_once_and_counts_them_all(spark, monkeypatch):
    rows = [(i, float(i), int((i % 5 >= 3) != (i % 11 == 0)), float(i % 5), float(i % 3)) for i in range(1_200)]
    df = spark.createDataFrame(rows, "id long, dt double, label int, a double, b double")
    train, val, given, plain = df.where("id < 1000"), df.where("id >= 1000"), [], TR.positive_probability

    def scored(model, df, trees=None, keep=()):
        given.append((model, df.toPandas()))
        return plain(model, df, trees, keep)

    monkeypatch.setattr(TR, "positive_probability", scored)
    got = TR.config_sweep(train, val, "dt", ["id", "dt"], "label", [], SETTINGS, {"one": {}, "two": {"depth": 1}}, 0.5).collect()
    assert len(given) == 2 and [r["config"] for r in got] == ["one", "two"]
    for row, (model, equal) in zip(got, given):
        assert len(equal) <= 60 and equal.groupby("slice")["n"].sum().to_dict() == {"train": 850, "val": 200}
        for name, part in equal.groupby("slice"):
            each = part.loc[part.index.repeat(part["n"])]
            scores = spark.createDataFrame(pd.DataFrame({"score": model.prefix(row["trees"]).append(spark.createDataFrame(each[["inputs"]]), "s").toPandas()["s"], "label": each["label"].to_numpy()}))
            assert R.ranking_metrics(scores, "score", "label").first()["pr_auc"] == pytest.approx(row[f"{name}_pr_auc"], abs=1e-12)
