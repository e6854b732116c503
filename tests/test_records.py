import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators.splits import split_boundaries
from tidemark.plans import gate as G
from tidemark.plans import registry as RG
from tidemark.plans import views as V
from tidemark.session import small_table
from tidemark.sources import manifest as MF
from tidemark.sources import tables as TB


def decide(spark, rows=10_000, positives=340, delta=0.02, se=0.01, trained=(0.0, 1.0), judged=(10.0, 20.0), **options):
    row = small_table(spark, [(rows, positives, delta, se, *judged, *(trained or (None, None)))],
                      "rows bigint, positives bigint, pr_auc_delta double, bootstrap_std_error double, judged_from double, "
                      "judged_to double, trained_from double, trained_to double")
    return G.decide(row, **options).first()


def test_verdicts(spark):
    assert decide(spark)["verdict"] == S.GATE_PROMOTE
    assert decide(spark, delta=0.01, se=0.01)["promote"], "the margin boundary is inclusive"
    assert decide(spark, delta=0.009)["verdict"] == S.GATE_NOISE
    assert decide(spark, delta=-0.02)["verdict"] == S.GATE_BEHIND
    assert decide(spark, rows=4_999)["verdict"] == S.GATE_INSUFFICIENT
    assert "4,999" in decide(spark, rows=4_999)["reason"]
    assert decide(spark, positives=99)["verdict"] == S.GATE_INSUFFICIENT
    assert decide(spark, se=0.0)["verdict"] == S.GATE_NOISE
    assert decide(spark, trained=(0.0, 15.0), rows=10)["verdict"] == S.GATE_LEAKED, "leakage is judged first"


def test_unknown_training_window_is_said(spark):
    row = decide(spark, trained=None)
    assert row["leakage_overlap"] is None and not row["leakage_checked"] and row["verdict"] == S.GATE_PROMOTE


@pytest.mark.parametrize("judged,expected", [((10, 20), 1.0), ((300, 400), 0.0), ((95, 105), 0.5), ((50, 50), 1.0), ((500, 500), 0.0)])
def test_overlap(spark, judged, expected):
    row = small_table(spark, [(float(judged[0]), float(judged[1]), 0.0, 100.0)], "a double, b double, c double, d double")
    got = row.select(S.overlap_fraction(*[F.col(c) for c in "abcd"])).first()[0]
    assert got == pytest.approx(expected)


def test_registry_promotes_only_on_the_verdict(spark, tmp_path):
    registry = RG.Registry(TB.TableStore(spark, str(tmp_path)))
    one = registry.register("run-1", "Production", "champion")
    two = registry.register("run-2", origin="drift_retrain")
    with pytest.raises(RG.PromotionRefusedError):
        registry.register("run-3", "Production", origin="drift_retrain")
    with pytest.raises(RG.PromotionRefusedError):
        registry.promote(two, one, S.GATE_NOISE)
    registry.promote(two, one, S.GATE_PROMOTE)
    state = {r["version"]: (r["stage"], r["aliases"]) for r in registry.state().collect()}
    assert state == {1: ("Archived", []), 2: ("Production", ["champion", "staging"])}
    assert RG.resolve_champion(registry.state()).first()["version"] == 2


def test_manifest_round_trip_and_contradictions(spark, tmp_path):
    df = spark.range(6_000).select((F.col("id") * 1.0).alias("dt"), (F.col("id") % 30 == 0).cast("int").alias("label"))
    manifest = MF.build_manifest(df, "dt", "label", split_boundaries(df, "dt"))
    path = tmp_path / "m.json"
    text = manifest.toJSON().first()
    path.write_bytes(b"\xef\xbb\xbf" + text.encode())
    loaded = MF.read_manifest(spark, str(path))
    MF.verify_manifest(loaded, df, "dt", "label")
    with pytest.raises(MF.ManifestError):
        MF.verify_manifest(loaded, df.where("dt > 10"), "dt", "label")
    path.write_text(text.replace('"total_rows"', '"rows_in_total"'))
    with pytest.raises(MF.ManifestError):
        MF.read_manifest(spark, str(path))


def test_empty_store_and_ids(spark, tmp_path):
    store = TB.TableStore(spark, str(tmp_path))
    schema = "id bigint, x double"
    assert store.read("alerts", schema).isEmpty()
    row = small_table(spark, [(1.5,)], "x double")
    assert [store.append_numbered("alerts", row, schema) for _ in range(3)] == [1, 2, 3]


def test_triggers_ignore_pipeline_alerts_and_resolve_once(spark):
    alerts = small_table(spark, [(1, True), (2, False), (3, True)], "id bigint, retrain_triggered boolean")
    answered = small_table(spark, [(1, 5.0, "r", "v2")], "alert_id bigint, resolved_s double, run_id string, model_version string")
    assert [r["id"] for r in V.open_triggers(alerts, answered).collect()] == [3]
    assert V.retrain_due(alerts, answered).first()["alert_id"] == 3
    tries = small_table(spark, [(3, 9.0, "b", "v4"), (3, 8.0, "a", "v3"), (1, 9.0, "c", "v5")],
                        "alert_id bigint, resolved_s double, run_id string, model_version string")
    assert [r["run_id"] for r in V.resolve(answered, tries).where("accepted").collect()] == ["a"]


def test_newest_rows_are_exactly_as_many_as_asked(spark):
    df = spark.range(5_000).selectExpr("id * 3 AS id")
    assert sorted(r["id"] for r in V.newest_rows(df, "id", 700).collect()) == [i * 3 for i in range(4_300, 5_000)]
    close = spark.range(40).selectExpr("id + 1152921504606846976 AS id", "id % 5 AS k")
    assert sorted(r["id"] - (1 << 60) for r in V.newest_rows(close, "id", 7).collect()) == list(range(33, 40))
    tied = V.newest_rows(close, "k", 11).collect()
    assert len(tied) == 11 and sorted(r["k"] for r in tied) == [3, 3, 3] + [4] * 8
    assert V.newest_rows(close, "k", 41).count() == 40 and V.newest_rows(close, "k", 0).count() == 0


@pytest.mark.parametrize("kind", ["bigint", "int", "date", "timestamp", "timestamp_ntz", "double", "string"])
def test_newest_rows_of_any_type_and_crowd(spark, kind, monkeypatch):
    monkeypatch.setattr(V, "LAST_KEYS", 5)
    monkeypatch.setattr(V, "KEY_RANGES", 4)
    far = {"bigint": 1 << 60, "int": 1 << 28, "date": 20_000, "timestamp": 1 << 40, "timestamp_ntz": 1 << 40, "double": 1 << 40, "string": 7_000}[kind]
    # crowded near the top, a third of all rows on one key, gaps, and one key far away
    days = F.when(F.col("id") % 3 == 0, 50).when(F.col("id") == 7, -far).when(F.col("id") % 50 == 1, None).otherwise(60 + F.col("id") % 40)
    made = {"bigint": days.cast("bigint"), "int": days.cast("int"), "date": F.date_from_unix_date(days.cast("int")), "timestamp": F.timestamp_micros(days.cast("bigint")),
            "timestamp_ntz": F.timestamp_micros(days.cast("bigint")).cast("timestamp_ntz"), "double": days.cast("double"), "string": F.lpad((days + far).cast("string"), 9, "0")}
    df = spark.range(600).select("id", made[kind].alias("k"))
    order = sorted((r["k"] for r in df.collect()), key=lambda v: (v is not None, v if v is not None else 0), reverse=True) if kind != "string" else \
        sorted((r["k"] for r in df.collect()), key=lambda v: (v is not None, v or ""), reverse=True)
    for n in (1, 4, 37, 200, 395, 420, 590, 599, 600, 700):
        got = [r["k"] for r in V.newest_rows(df, "k", n).collect()]
        assert len(got) == min(n, 600) and sorted(map(str, got)) == sorted(map(str, order[:n]))


def test_newest_rows_spread_over_the_whole_range(spark):
    ends = spark.createDataFrame([(-(1 << 63),), ((1 << 63) - 1,), (0,), (5,), (None,)], "id bigint").union(spark.range(20_000).selectExpr("id * 3"))
    assert sorted(r["id"] for r in V.newest_rows(ends, "id", 4).collect()) == [59_991, 59_994, 59_997, (1 << 63) - 1]
    assert V.newest_rows(ends, "id", 20_004).where("id IS NULL").count() == 0


def test_newest_rows_shuffles_no_rows(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "id % 7 AS x").repartition(8).write.parquet(str(tmp_path / "audit"))
    audit = spark.read.parquet(str(tmp_path / "audit"))
    newest = V.newest_rows(audit, "id", 500)
    assert newest.agg(F.min("id"), F.count("*")).first()[:] == (199_500, 500)
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,199500)" in plan and "rangepartitioning" not in plan.split("TakeOrdered")[0]


def test_unseen_aggregate(spark):
    rows = [("id_31", "chrome 65.0", 12), ("id_31", "opera", 3), ("id_30", "Android 9", 5)]
    df = spark.createDataFrame(rows, "feature string, value string, occurrences bigint").withColumn("observed_at", F.current_timestamp())
    out = {r["feature"]: (r["distinct_values"], r["occurrences"], r["examples"]) for r in V.unseen_summary(df).collect()}
    assert out["id_31"] == (2, 15, "chrome 65.0 (12), opera (3)") and out["id_30"][1] == 5


def test_verdict_words(spark):
    cases = {"PROMOTE": "promoted", S.GATE_LEAKED: "refused", S.GATE_NOISE: "rejected",
             "PROMOTE (rolled back later)": "rolled back", None: "rejected"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert [r[0] for r in df.select(S.verdict_outcome(F.col("v"))).collect()] == list(cases.values())


def test_flatten_drops_what_is_no_metric(spark):
    df = spark.sql("SELECT 1 AS a, true AS flag, named_struct('x', 2.5D, 'bad', double('NaN'), 'big', double('Infinity'), 'none', CAST(NULL AS DOUBLE)) AS b, 'text' AS t")
    assert {r["key"]: r["value"] for r in TB.flatten_metrics(df, []).collect()} == {"a": 1.0, "b.x": 2.5}
