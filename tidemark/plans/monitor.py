"""The drift monitor: recent window against the reference, one alert row out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import psi as P
from tidemark.operators.splits import recent_days, recent_rows, seconds_of
from tidemark.sources.tables import ALERT_SCHEMA, TableStore, write_json_report

VALUE_REMEDY = "Fit a new model: recorded values follow another distribution."
MISSINGNESS_REMEDY = "Repair the source first: what changed is how often a value is present, not the values."


@dataclass(frozen=True)
class MonitorResult:
    """The classified drift table and the one-row alert made from it."""

    drift: DataFrame
    alert: DataFrame


def monitor_window(stream: DataFrame, time: str, window_days: float | None = 30.0,
                   window_rows: int | None = None) -> DataFrame:
    if window_rows is not None:
        return recent_rows(stream, time, window_rows)
    return recent_days(stream, time, window_days)


def top_features(drift: DataFrame, n: int) -> DataFrame:
    """The worst ``n`` measured features with their type, residual and missing rates."""
    kind = F.when(F.col("drift_type") == "none", "unclassified").otherwise(F.col("drift_type"))
    return (
        drift.where(F.col("psi_all").isNotNull())
        .select("feature", F.col("psi_all").alias("psi"), kind.alias("type"), "psi_non_null",
                "na_rate_reference", "na_rate_current")
        .orderBy(F.desc("psi"), "feature")
        .limit(n)
    )


def summarise_drift(drift: DataFrame, threshold: float = S.MAJOR_ABOVE, top: int = 15) -> DataFrame:
    """The alert's measured fields from a classified drift table, one aggregate."""
    c = F.col
    worst = F.max(F.when(c("psi_all").isNotNull(), F.struct("psi_all", "feature")))
    ranked = F.array_sort(
        F.collect_list(
            F.when(
                c("psi_all").isNotNull(),
                F.struct(
                    (-c("psi_all")).alias("rank"), "feature", F.round("psi_all", 6).alias("psi"),
                    F.when(c("drift_type") == "none", "unclassified").otherwise(c("drift_type")).alias("type"),
                    F.round("psi_non_null", 6).alias("psi_non_null"),
                    F.round("na_rate_reference", 6).alias("na_rate_reference"),
                    F.round("na_rate_current", 6).alias("na_rate_current"),
                ),
            )
        )
    )

    def of_type(kind: str):
        return c("drift_type") == kind

    def names(kind: str):
        listed = F.array_sort(F.collect_list(
            F.when(of_type(kind), F.struct((-c("psi_all")).alias("rank"), "feature"))))
        return F.transform(listed, lambda x: x["feature"])

    def band(name: str):
        return F.count_if(c("band") == name)

    sums = drift.agg(
        worst.alias("worst"),
        F.coalesce(F.max(F.when(of_type("value"), c("psi_all"))), F.lit(0.0)).alias("value_drift_psi"),
        F.count_if(of_type("value")).alias("value_drift_features"),
        F.coalesce(F.max(F.when(of_type("missingness"), c("psi_all"))), F.lit(0.0)).alias("missingness_psi"),
        F.count_if(of_type("missingness")).alias("missingness_features"),
        band("major").alias("n_major"), band("moderate").alias("n_moderate"),
        band("stable").alias("n_stable"), band("unmeasurable").alias("n_unmeasurable"),
        ranked.alias("ranked"),
        names("value").alias("value_drift_feature_list"),
        names("missingness").alias("missingness_feature_list"),
    )
    retrain = c("value_drift_psi") >= threshold
    pipeline = c("missingness_psi") >= threshold
    return sums.select(
        F.coalesce(c("worst.psi_all"), F.lit(0.0)).alias("overall_psi"),
        c("worst.feature").alias("overall_psi_feature"),
        "value_drift_psi", "value_drift_features", "missingness_psi", "missingness_features",
        "n_major", "n_moderate", "n_stable", "n_unmeasurable",
        F.lit(float(threshold)).alias("threshold"),
        retrain.alias("retrain_triggered"), pipeline.alias("investigate_pipeline"),
        S.drift_verdict(retrain, pipeline).alias("verdict"),
        F.transform(F.slice("ranked", 1, top), lambda x: x.dropFields("rank")).alias("top_features"),
        "value_drift_feature_list", "missingness_feature_list",
    )


def run_monitor(
    reference: DataFrame,
    stream: DataFrame,
    time: str,
    exclude: Iterable[str] = (),
    window_days: float | None = 30.0,
    window_rows: int | None = None,
    threshold: float = S.MAJOR_ABOVE,
    unseen: DataFrame | None = None,
) -> MonitorResult:
    """Window, sweep, decompose, classify, verdict."""
    window = monitor_window(stream, time, window_days, window_rows)
    drift = P.classify_drift(P.drift_table(reference, window, exclude=exclude), threshold)
    extent = window.agg(
        F.min(time).alias("low"), F.max(time).alias("high"), F.count("*").alias("window_rows")
    ).select(
        seconds_of("low", window, time).alias("window_start_dt"),
        seconds_of("high", window, time).alias("window_end_dt"), "window_rows",
    ).first()
    label = f"newest {window_rows} rows" if window_rows is not None else f"last {window_days:g} days"
    alert = summarise_drift(drift, threshold).select(
        F.current_timestamp().alias("created_at"),
        F.lit(label).alias("window_label"),
        F.lit(extent["window_start_dt"]).alias("window_start_dt"),
        F.lit(extent["window_end_dt"]).alias("window_end_dt"),
        F.lit(extent["window_rows"]).cast("bigint").alias("window_rows"),
        F.lit(reference.count()).cast("bigint").alias("reference_rows"),
        "*",
    )
    if unseen is not None:
        # One row per feature: bounded by the schema, so it may ride on the alert.
        listed = unseen.agg(F.collect_list(F.struct("*")).alias("u")).select("u").scalar()
        alert = alert.withColumn("unseen_categories", listed)
    return MonitorResult(drift, alert)


def record_monitor(store: TableStore, result: MonitorResult) -> int:
    """Append the alert row under the next id and write its decision document beside it; returns the id."""
    alert = result.alert
    listed = F.to_json("unseen_categories") if "unseen_categories" in alert.columns else F.lit(None).cast("string")
    number = store.append_numbered("drift_alerts", alert.withColumn("unseen_categories", listed), ALERT_SCHEMA)
    stored = store.read("drift_alerts", ALERT_SCHEMA).where(F.col("id") == number)
    write_json_report(decision_document(stored), f"{store.path('decisions')}/alert-{number}")
    return number


def decision_document(alert: DataFrame, top: int = 20) -> DataFrame:
    """The alert as one nested document, ready for ``write.json``."""
    c = F.col

    def block(kind: str, features: str, count: str, psi: str, remedy: str):
        return F.struct(
            c(features).alias("features"), c(count).alias("count"), c(psi).alias("max_psi"),
            F.lit(remedy).alias("remedy"),
        ).alias(kind)

    return alert.select(
        S.iso_utc(c("created_at")).alias("created_at"),
        F.struct(
            c("window_label").alias("label"), c("window_rows").alias("rows"),
            c("window_start_dt").alias("start_transaction_dt"),
            c("window_end_dt").alias("end_transaction_dt"),
        ).alias("window"),
        "threshold",
        F.lit(S.VALUE_DRIFT_RESIDUAL).alias("value_drift_residual_cut"),
        F.struct(
            c("n_stable").alias("stable"), c("n_moderate").alias("moderate"),
            c("n_major").alias("major"), c("n_unmeasurable").alias("unmeasurable"),
        ).alias("bands"),
        "overall_psi", "overall_psi_feature",
        block("value_drift", "value_drift_feature_list", "value_drift_features", "value_drift_psi", VALUE_REMEDY),
        block("missingness_drift", "missingness_feature_list", "missingness_features", "missingness_psi",
              MISSINGNESS_REMEDY),
        "verdict", "retrain_triggered", "investigate_pipeline",
        F.slice("top_features", 1, top).alias("top_features"),
        *(["unseen_categories"] if "unseen_categories" in alert.columns else []),
    )
