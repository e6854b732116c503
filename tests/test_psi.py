import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalar import psi_band
from tidemark.operators import psi as P
from tidemark.plans.monitor import decision_document, monitor_window, run_monitor
from tidemark.session import small_table


def one(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def psi(spark, reference, current, kind="string", **options):
    return P.drift_table(one(spark, reference, kind), one(spark, current, kind), **options).first()


def levels(**counts):
    return [None if k == "NULL" else k for k, n in counts.items() for _ in range(n)]


def test_hand_computed_five_buckets(spark):
    ref = levels(a=350, b=300, c=200, d=100, e=50)
    cur = levels(a=200, b=250, c=250, d=200, e=100)
    assert psi(spark, ref, cur)["psi_all"] == pytest.approx(0.2082, abs=5e-4)
    assert psi(spark, ref, ref)["psi_all"] == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("values", [[5.0] * 100, [None] * 100])
def test_constant_or_empty_numeric_is_unmeasurable(spark, values):
    row = psi(spark, values, values, "double")
    assert row["psi_all"] is None and row["psi_non_null"] is None and row["band"] == "unmeasurable"


def test_missing_is_a_bucket(spark):
    row = psi(spark, levels(x=9000, y=1000), levels(x=5000, y=1000, NULL=4000))
    assert row["psi_all"] > 1.0
    assert row["na_rate_delta"] == pytest.approx(0.4)


def test_coverage_change_is_not_value_drift(spark):
    rng = np.random.default_rng(0)

    def sample(missing):
        return pd.DataFrame({"x": np.where(rng.random(30_000) < missing, np.nan, rng.normal(size=30_000))})

    row = P.drift_table(spark.createDataFrame(sample(0.76)), spark.createDataFrame(sample(0.10))).first()
    assert row["psi_all"] > 0.20 and row["psi_non_null"] < 0.10
    typed = P.classify_drift(P.drift_table(spark.createDataFrame(sample(0.76)), spark.createDataFrame(sample(0.10))))
    assert typed.first()["drift_type"] == "missingness"


def test_new_level_counts_and_falls_with_epsilon(spark):
    ref, cur = levels(chrome=8000, firefox=2000), levels(chrome=6000, firefox=2000, brave=2000)
    small, large = (psi(spark, ref, cur, epsilon=e)["psi_all"] for e in (1e-6, 1e-3))
    assert small > 1.0 and small > large


def test_boolean_routes(spark):
    ref, cur = [True] * 700 + [False] * 300, [True] * 300 + [False] * 700
    assert psi(spark, ref, cur, "boolean")["psi_all"] == pytest.approx(0.6778, abs=1e-3)
    as_number = P.psi_numeric(one(spark, ref, "boolean"), one(spark, cur, "boolean"), "x").first()["psi"]
    assert as_number == pytest.approx(0.6778, abs=1e-3)
    ref, cur = [True] * 950 + [False] * 50, [True] * 50 + [False] * 950
    row = psi(spark, ref, cur, "boolean")
    assert row["kind"] == "categorical" and row["psi_all"] == pytest.approx(5.30, abs=0.01)
    assert P.psi_numeric(one(spark, ref, "boolean"), one(spark, cur, "boolean"), "x").first()["psi"] is None


def test_bands(spark):
    values = [0.0, 0.099, 0.10, 0.20, 0.201, None]
    bands = [r[0] for r in one(spark, values, "double").select(psi_band(F.col("x"))).collect()]
    assert bands == ["stable", "stable", "moderate", "moderate", "major", "unmeasurable"]


def test_contributions_sum_to_the_scalar_and_have_open_ends(spark):
    rng = np.random.default_rng(1)
    ref = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=4000)}))
    cur = spark.createDataFrame(pd.DataFrame({"x": np.append(rng.normal(0.4, 1, 3000), [np.nan] * 100)}))
    rows = P.psi_contributions(ref, cur, "x").collect()
    assert sum(r["contribution"] for r in rows) == pytest.approx(P.drift_table(ref, cur).first()["psi_all"])
    assert all(r["contribution"] >= 0 for r in rows)
    labels = {r["bucket"] for r in rows}
    assert "missing" in labels and any(x.startswith("(-inf,") for x in labels) and any(x.endswith("inf]") for x in labels)


def test_report_order_and_exclusion(spark):
    rng = np.random.default_rng(2)
    ref = spark.createDataFrame(pd.DataFrame({"id": range(2000), "a": rng.normal(size=2000), "b": rng.normal(size=2000), "c": 1.0}))
    cur = spark.createDataFrame(pd.DataFrame({"id": range(2000), "a": rng.normal(size=2000), "b": rng.normal(2, 1, 2000), "c": 1.0}))
    assert [r["feature"] for r in P.psi_report(ref, cur, exclude=["id"]).collect()] == ["b", "a", "c"]


def test_two_types_split_on_recorded_decomposition(spark):
    rows = [("id_31", 1.5254, 7.5787), ("id_13", 0.5661, 2.4739), ("M8", 0.5303, 0.0001),
            ("D11", 0.4496, 0.0735), ("V3", 0.4131, 0.0066), ("quiet", 0.05, 0.05), ("gone", 0.9, None)]
    df = spark.createDataFrame(rows, "feature string, psi_all double, psi_non_null double")
    for cut in (0.01, 0.05, 0.07):
        got = {r["feature"]: r["drift_type"] for r in P.classify_drift(df, residual=cut).collect()}
        assert {f for f, t in got.items() if t == "value"} == {"id_31", "id_13", "D11"}
        assert {f for f, t in got.items() if t == "missingness"} == {"M8", "V3", "gone"}
    undecomposed = P.classify_drift(df.withColumn("decomposed", F.lit(False)))
    assert {r["drift_type"] for r in undecomposed.where("psi_all >= 0.2").collect()} == {"value"}
    assert {r["feature"] for r in P.missingness_driven_majors(df).collect()} == {"M8", "D11", "V3"}


def test_monitor_end_to_end(spark):
    rng = np.random.default_rng(5)
    n = 6_000
    ref = spark.createDataFrame(pd.DataFrame({"dt": np.arange(n) * 100.0, "moved": rng.normal(size=n), "still": rng.normal(size=n)}))
    cur = spark.createDataFrame(pd.DataFrame({"dt": (n + np.arange(n)) * 100.0, "moved": rng.normal(3, 1, n), "still": rng.normal(size=n)}))
    assert monitor_window(cur, "dt", window_rows=100).count() == 100
    result = run_monitor(ref, cur, "dt", exclude=["dt"], window_rows=3_000)
    row = result.alert.first()
    assert row["verdict"] == "RETRAIN" and row["overall_psi_feature"] == "moved" and row["window_rows"] == 3_000
    assert row["value_drift_feature_list"] == ["moved"] and row["missingness_psi"] == 0.0
    document = decision_document(result.alert).first()
    assert document["value_drift"]["count"] == 1 and document["bands"]["major"] == 1


def test_band_counts_include_zero(spark):
    report = small_table(spark, [("a", "major")], "feature string, band string")
    assert {r["band"]: r["features"] for r in P.band_counts(report).collect()} == {
        "stable": 0, "moderate": 0, "major": 1, "unmeasurable": 0}


def test_features_of_few_values_need_no_counting_pass(spark, monkeypatch):
    rng = np.random.default_rng(8)

    def side(n, shift):
        few = rng.integers(0, 40, n) + shift
        return spark.createDataFrame(pd.DataFrame({"few": np.where(rng.random(n) < 0.1, np.nan, few), "many": rng.normal(size=n)})).repartition(3)

    reference, current = side(3_000, 0).cache(), side(2_000, 7).cache()
    whole = {r["feature"]: r for r in P.drift_table(reference, current).collect()}
    values = [df.toPandas()["few"].to_numpy() for df in (reference, current)]
    edges = np.unique(np.quantile(values[0][~np.isnan(values[0])], np.arange(11) / 10))
    shares = []
    for v in values:
        bins = np.bincount(np.searchsorted(edges[1:-1], v[~np.isnan(v)]), minlength=len(edges) - 1)
        shares.append(np.maximum(np.append(bins, np.isnan(v).sum()) / len(v), 1e-6))
    assert whole["few"]["psi_all"] == pytest.approx(float(((shares[1] - shares[0]) * np.log(shares[1] / shares[0])).sum()), abs=1e-9)
    assert whole["many"]["psi_all"] is not None
    monkeypatch.setattr(P, "histogram", None)
    alone = P.drift_table(reference, current, features=["few"]).collect()
    assert alone[0]["psi_all"] == pytest.approx(whole["few"]["psi_all"], abs=1e-12)
