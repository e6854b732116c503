"""Time bounds in the stored type: right rows, and a filter inside the scan."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark.operators import splits as SP
from tidemark.plans import gate as G
from tidemark.plans import monitor as M
from tidemark.plans import registry as RG
from tidemark.plans import training as TR
from tidemark.plans import views as V
from tidemark.session import small_table
from tidemark.sources.tables import ALERT_SCHEMA, RESOLUTION_SCHEMA, TableStore, record_run

DAY = 86_400
KINDS = {
    "bigint": lambda d: d * DAY,
    "int": lambda d: (d * DAY).cast("int"),
    "date": lambda d: F.date_from_unix_date(d.cast("int")),
    "timestamp": lambda d: F.timestamp_seconds(d * DAY),
    "timestamp_ntz": lambda d: F.timestamp_seconds(d * DAY).cast("timestamp_ntz"),
    "double": lambda d: (d * DAY).cast("double"),
}


@pytest.mark.parametrize("kind", KINDS)
def test_bounds_reach_the_scan(spark, tmp_path, kind):
    spark.range(1_000).select(KINDS[kind](F.col("id")).alias("t")).write.parquet(str(tmp_path / kind))
    df = spark.read.parquet(str(tmp_path / kind))
    for days, later in ((500.0, 500), (500.4, 499), (-3.0, 1_000), (2_000.5, 0)):
        at = SP.moment(df, "t", days * DAY)
        above = df.where(F.col("t") >= at)
        assert (above.count(), df.where(F.col("t") < at).count()) == (later, 1_000 - later)
    plan = df.where(F.col("t") >= SP.moment(df, "t", 500.4 * DAY))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t," in plan.split("PushedFilters:")[1]
    assert SP.time_extent(df, "t") == (0.0, 999.0 * DAY)


def test_registry_state_keeps_tags_and_registers_the_newest_run(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    registry = RG.Registry(store)
    record_run(store, "run-a", {"start_time": 10})
    record_run(store, "run-b", {"start_time": 20})
    one, two = registry.register("run-a"), registry.register()
    registry.promote(two, one, RG.GATE_PROMOTE, {"shadow_rows": 9})
    view = {r["version"]: (r["stage"], r["aliases"], r["note"]) for r in RG.registry_view(registry.state()).collect()}
    assert view == {1: ("Archived", "", "replaced by v2"), 2: ("Production", "champion, staging", RG.GATE_PROMOTE)}
    assert {r["version"]: r["run_id"] for r in registry.state().collect()} == {1: "run-a", 2: "run-b"}


def test_an_alert_is_stored_whole_and_resolved_once(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    rows = [(i, float(i % 7) + (3.0 if i > 1_500 else 0.0)) for i in range(2_000)]
    table = spark.createDataFrame(rows, "t bigint, v double")
    unseen = small_table(spark, [("f", "x", 3)], "feature string, value string, occurrences bigint")
    result = M.run_monitor(table.where("t < 1000"), table.where("t >= 1000"), "t", ["t"], window_rows=400, unseen=unseen)
    assert M.record_monitor(store, result) == 1
    stored = store.read("drift_alerts", ALERT_SCHEMA).first()
    assert stored["retrain_triggered"] and stored["window_rows"] == 400 and '"feature":"f"' in stored["unseen_categories"]
    assert spark.read.json(f"{store.path('decisions')}/alert-1").first()["retrain_triggered"]
    assert V.alert_history(store.read("drift_alerts", ALERT_SCHEMA)).count() == 1
    attempt = lambda run: small_table(spark, [(1, None, run, "2")], RESOLUTION_SCHEMA)
    assert TR.resolve_once(store, attempt("first")) and not TR.resolve_once(store, attempt("second"))
    assert [r["run_id"] for r in store.read("alert_resolutions", RESOLUTION_SCHEMA).collect()] == ["first"]


def test_the_gate_records_and_promotes_on_an_audit_table(spark, tmp_path):
    registry = RG.Registry(TableStore(spark, str(tmp_path / "store")))
    record_run(registry.store, "run-1", {"start_time": 1})
    record_run(registry.store, "run-2", {"start_time": 2, "retrain.window_start_dt": 0.0, "retrain.window_end_dt": 10.0})
    registry.register("run-1", "Production", "champion")
    registry.register(tags={"trigger_alert_id": "7"}, origin="drift_retrain")
    audit = spark.range(8_000).selectExpr(
        "id", "CAST(100 + id AS DOUBLE) AS transaction_dt", "CAST(id % 20 = 0 AS INT) AS true_label",
        "'v1' AS model_version", "'v2' AS challenger_version", "0.5D AS threshold", "0.5D AS challenger_threshold",
        "(pmod(xxhash64(id), 1000) + IF(id % 20 = 0, 200, 0)) / 1200D AS fraud_probability",
        "(pmod(xxhash64(id, 1), 1000) + IF(id % 20 = 0, 700, 0)) / 1700D AS challenger_probability")
    row = G.compare_and_record(audit, registry, promote=True, resamples=60).first()
    assert (row["id"], row["from_version"], row["to_version"], row["trigger_alert_id"]) == (1, "1", "2", 7)
    assert row["verdict"] == RG.GATE_PROMOTE and row["leakage_checked"]
    state = {r["version"]: (r["stage"], r["aliases"], r["tags"].get("shadow_rows")) for r in registry.state().collect()}
    assert state == {1: ("Archived", [], None), 2: ("Production", ["champion", "staging"], "8000")}


def test_one_of_many_claims_wins(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda _: store.claim("answers/1"), range(24)))
    assert won.count(True) == 1
    store.release("answers/1")
    assert store.claim("answers/1") and not store.claim("answers/1")


def test_writers_at_the_same_time_get_different_ids(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    row = small_table(spark, [("a",)], "name string")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: store.append_numbered("alerts", row, "id bigint, name string"), range(4)))
    stored = sorted(r["id"] for r in store.read("alerts", "id bigint, name string").collect())
    assert sorted(got) == stored and len(set(stored)) == 4


def test_a_retrain_asks_first_and_gives_back_what_it_could_not_answer(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "store"))
    alert = small_table(spark, [(5,)], "id bigint")
    fitted = []
    gate = threading.Barrier(2, timeout=60)

    def answer(window, alert, key, label, exclude, settings, store, run_id, register):
        fitted.append(run_id)
        if run_id == "breaks":
            raise RuntimeError("no rows")
        gate.wait()
        return run_id

    monkeypatch.setattr(TR, "_answer", answer)
    job = lambda run: TR.retrain_job(None, alert, [], "label", [], None, store, run)
    with pytest.raises(RuntimeError):
        job("breaks")

    def attempt(run):
        try:
            return job(run)
        except TR.AlertAnsweredError:
            gate.wait()  # the winner is still at work
            return None

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(attempt, ["one", "two"]))
    assert sorted(map(bool, got)) == [False, True] and len(fitted) == 2
    TR.resolve_once(store, small_table(spark, [(5, None, "by hand", None)], RESOLUTION_SCHEMA))
    store.release("answers/5")
    with pytest.raises(TR.AlertAnsweredError):
        job("late")
    with pytest.raises(LookupError):
        TR.retrain_job(None, alert.where("id > 5"), [], "label", [], None, store, "none")
