"""Queries over the record tables: audit, unseen, alerts, verdicts, registry."""

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.plans import registry as RG
from tidemark.plans import views as V
from tidemark.session import small_table
from tidemark.workload.base import query, r6, table
from tidemark.workload.fixtures import (
    ALERTS_SQL,
    AUDIT_SQL,
    COMPARISONS_SQL,
    REGISTRY_SQL,
    UNSEEN_SQL,
    alerts_view,
    audit_view,
    comparisons_view,
    resolutions_view,
    runs_view,
    unseen_view,
    versions_view,
)

AUDIT = "WITH " + AUDIT_SQL
UNSEEN = "WITH " + UNSEEN_SQL
ALERTS = "WITH " + ALERTS_SQL
REGISTRY = "WITH " + REGISTRY_SQL

SUMMARY_SQL = """
s AS (SELECT count(*) AS rows, count(*) FILTER (decision = 'BLOCK') AS blocked, count(*) FILTER (len(unseen_categories) > 0) AS with_unseen,
  count(challenger_probability) AS shadowed, min(epoch(scored_at)) AS first_scored, max(epoch(scored_at)) AS last_scored, avg(latency_ms) AS avg_latency_ms FROM audit)"""


@query("agg_1_scoring_summary", AUDIT + "," + SUMMARY_SQL + """
SELECT rows, blocked, with_unseen, shadowed, first_scored, last_scored, round(avg_latency_ms, 6) + 0.0 AS avg_latency_ms,
  round(blocked / rows, 6) + 0.0 AS flag_rate, round(with_unseen / rows, 6) + 0.0 AS unseen_rate,
  round(rows / (last_scored - first_scored), 6) + 0.0 AS throughput_per_s FROM s""")
def scoring_summary(spark, sf_dir):
    row = V.scoring_summary(audit_view(spark, sf_dir))
    rates = ("avg_latency_ms", "flag_rate", "unseen_rate", "throughput_per_s")
    return row.select("rows", "blocked", "with_unseen", "shadowed", "first_scored", "last_scored",
                      *[r6(c).alias(c) for c in rates])


@query("agg_2_rows_by_version", AUDIT + "SELECT model_version, count(*) AS rows, count(*) FILTER (decision = 'BLOCK') AS blocked FROM audit GROUP BY 1")
def rows_by_version(spark, sf_dir):
    return V.rows_by_version(audit_view(spark, sf_dir))


@query("agg_25_run_statistics", AUDIT + """
SELECT model_version, count(*) AS scored, count(*) FILTER (decision = 'BLOCK') AS blocked, count(*) FILTER (decision = 'ALLOW') AS allowed,
  count(*) FILTER (len(unseen_categories) > 0) AS unseen_rows, count(challenger_probability) AS shadow_scored,
  count(*) FILTER (challenger_probability IS NOT NULL AND decision <> challenger_decision) AS disagreements,
  round(100.0 * count(*) FILTER (challenger_probability IS NOT NULL AND decision <> challenger_decision) / count(challenger_probability), 6) + 0.0 AS disagreement_pct
FROM audit GROUP BY 1""")
def run_statistics(spark, sf_dir):
    return V.run_statistics(audit_view(spark, sf_dir), ("model_version",)).withColumn(
        "disagreement_pct", r6("disagreement_pct"))


BUCKETS_SQL = """
n AS (SELECT * FROM audit ORDER BY id DESC LIMIT 500),
bk AS (SELECT floor(epoch(scored_at) / 10) * 10.0 AS bucket_start, count(*) AS scored, count(*) FILTER (decision = 'BLOCK') AS blocked FROM n GROUP BY 1)"""


@query("str_8_recent_buckets", AUDIT + "," + BUCKETS_SQL + "SELECT bucket_start, scored, blocked FROM bk")
def recent_buckets(spark, sf_dir):
    return V.recent_buckets(audit_view(spark, sf_dir))


@query("vw_3_scoring_activity", AUDIT + "," + SUMMARY_SQL + "," + BUCKETS_SQL + """,
v AS (SELECT model_version, count(*) AS rows, count(*) FILTER (decision = 'BLOCK') AS blocked FROM audit GROUP BY 1)
SELECT metric, key, round(value, 6) + 0.0 AS value FROM (
  SELECT 'total' AS metric, k AS key, v AS value FROM s CROSS JOIN LATERAL (VALUES ('rows', rows::DOUBLE), ('blocked', blocked::DOUBLE),
    ('with_unseen', with_unseen::DOUBLE), ('shadowed', shadowed::DOUBLE), ('avg_latency_ms', avg_latency_ms), ('flag_rate', blocked / rows),
    ('unseen_rate', with_unseen / rows), ('throughput_per_s', rows / (last_scored - first_scored)), ('live', 1.0::DOUBLE)) t(k, v)
  UNION ALL SELECT 'version.rows', model_version, rows FROM v UNION ALL SELECT 'version.blocked', model_version, blocked FROM v
  UNION ALL SELECT 'recent', 'buckets', count(*) FROM bk UNION ALL SELECT 'recent', 'busiest', max(scored) FROM bk)""")
def scoring_activity(spark, sf_dir):
    audit = audit_view(spark, sf_dir)
    now = audit.agg(F.max(S.epoch_seconds(F.col("scored_at"))) + 30.0).scalar()
    return V.scoring_activity(audit, now).withColumn("value", r6("value"))


# --- unseen ------------------------------------------------------------------------------

BY_FEATURE_SQL = """
SELECT feature, count(DISTINCT value) AS distinct_values, sum(occurrences)::BIGINT AS occurrences,
  min(epoch(observed_at)) AS first_seen, max(epoch(observed_at)) AS last_seen FROM unseen"""


@query("agg_3_unseen_by_feature", UNSEEN + BY_FEATURE_SQL + " WHERE epoch(observed_at) >= 1704499200.0 GROUP BY 1")
def unseen_by_feature(spark, sf_dir):
    rows = V.unseen_by_feature(unseen_view(spark, sf_dir), 1704499200.0)
    return rows.withColumns({c: S.epoch_seconds(F.col(c)) for c in ("first_seen", "last_seen")})


TOP_VALUES_SQL = """,
val AS (SELECT feature, value, sum(occurrences)::BIGINT AS n FROM unseen GROUP BY 1, 2),
topv AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS position FROM val QUALIFY position <= 5)"""


@query("win_4_top_values", UNSEEN + TOP_VALUES_SQL + "SELECT feature, value, n, position FROM topv")
def top_values(spark, sf_dir):
    return V.top_values(unseen_view(spark, sf_dir))


@query("jn_6_feature_examples", UNSEEN + TOP_VALUES_SQL + """,
f AS (""" + BY_FEATURE_SQL + """ GROUP BY 1)
SELECT feature, distinct_values, occurrences, string_agg(value || ':' || n, ';' ORDER BY position) AS top_values
FROM f JOIN topv USING (feature) GROUP BY ALL""")
def feature_examples(spark, sf_dir):
    rows = V.unseen_summary(unseen_view(spark, sf_dir))
    text = F.transform("top_values", lambda v: F.concat(v["value"], F.lit(":"), v["n"].cast("string")))
    return rows.select("feature", "distinct_values", "occurrences", F.array_join(text, ";").alias("top_values"))


EXAMPLES_SQL = UNSEEN + TOP_VALUES_SQL + """
SELECT feature, string_agg(value || ' (' || n || ')', ', ' ORDER BY position) FILTER (position <= 3) AS examples FROM topv GROUP BY 1"""


@query("vw_4_unseen_summary", EXAMPLES_SQL)
def unseen_summary(spark, sf_dir):
    return V.unseen_summary(unseen_view(spark, sf_dir)).select("feature", "examples")


@query("fn_14_examples_text", EXAMPLES_SQL)
def examples_text(spark, sf_dir):
    ranked = V.top_values(unseen_view(spark, sf_dir)).groupBy("feature").agg(
        F.sort_array(F.collect_list(F.struct("position", "value", "n"))).alias("v"))
    return ranked.select("feature", S.examples_text(F.col("v")).alias("examples"))


@query("agg_23_unseen_totals", UNSEEN + ", f AS (" + BY_FEATURE_SQL + """ GROUP BY 1)
SELECT count(*) AS features, sum(occurrences)::BIGINT AS observations, sum(distinct_values)::BIGINT AS distinct_levels,
  max_by(feature, occurrences) AS worst_feature FROM f""")
def unseen_totals(spark, sf_dir):
    return V.unseen_totals(unseen_view(spark, sf_dir))


# --- alerts --------------------------------------------------------------------------------

OPEN_SQL = ALERTS + """,
opened AS (SELECT a.* FROM alerts a ANTI JOIN resolutions r ON a.id = r.alert_id WHERE retrain_triggered)"""


@query("flt_8_open_triggers", OPEN_SQL + "SELECT id, value_drift_psi, verdict FROM opened")
def open_triggers(spark, sf_dir):
    return V.open_triggers(alerts_view(spark, sf_dir), resolutions_view(spark, sf_dir)).select(
        "id", "value_drift_psi", "verdict")


@query("gate_5_retrain_due", OPEN_SQL + "SELECT count(*) > 0 AS due, count(*) AS open_triggers, max(id) AS alert_id FROM opened")
def retrain_due(spark, sf_dir):
    return V.retrain_due(alerts_view(spark, sf_dir), resolutions_view(spark, sf_dir))


@query("mdl_14_resolve_once", ALERTS + """,
att AS (SELECT id AS alert_id, created_s + k * 60.0 AS resolved_s, 'try-' || CAST(k AS VARCHAR) AS run_id
        FROM alerts, (VALUES (2), (1), (3)) t(k) WHERE retrain_triggered)
SELECT alert_id, run_id, alert_id NOT IN (SELECT alert_id FROM resolutions) AND run_id = 'try-1' AS accepted FROM att""")
def resolve_once(spark, sf_dir):
    """Three answers per trigger: the first wins, unless the alert was answered before."""
    tries = F.explode(F.array(*[F.lit(k) for k in (2, 1, 3)]))
    attempts = alerts_view(spark, sf_dir).where("retrain_triggered").select("id", "created_s", tries.alias("k")).select(
        F.col("id").alias("alert_id"), (F.col("created_s") + F.col("k") * 60.0).alias("resolved_s"),
        F.concat(F.lit("try-"), F.col("k").cast("string")).alias("run_id"),
    )
    return V.resolve(resolutions_view(spark, sf_dir), attempts).select("alert_id", "run_id", "accepted")


@query("vw_1_alert_history", ALERTS + "SELECT id, created_s, value_drift_psi, missingness_psi, verdict, retrain_triggered FROM alerts")
def alert_history(spark, sf_dir):
    return V.alert_history(alerts_view(spark, sf_dir))


@query("vw_2_latest_alert", ALERTS + """
SELECT id, verdict, retrain_triggered AND r.model_version IS NULL AS open_trigger, coalesce(r.model_version, '-') AS answered_by
FROM (SELECT * FROM alerts ORDER BY id DESC LIMIT 1) a LEFT JOIN resolutions r ON a.id = r.alert_id""")
def latest_alert(spark, sf_dir):
    rows = V.latest_alert(alerts_view(spark, sf_dir), resolutions_view(spark, sf_dir))
    return rows.select("id", "verdict", "open_trigger", F.coalesce("answered_by", F.lit("-")).alias("answered_by"))


# --- verdict records and registry --------------------------------------------------------------

HISTORY_SQL = "WITH " + COMPARISONS_SQL + "," + REGISTRY_SQL + """,
h AS (SELECT 'v' || to_version AS version, 'v' || from_version AS from_version, verdict, pr_auc_delta, margin_in_ses AS margin_ses,
    comparison_rows AS rows, 'model_promotions' AS source FROM comparisons
  UNION ALL SELECT 'v' || CAST(version AS VARCHAR), '', shadow_verdict, shadow_delta, NULL, shadow_rows, 'registry tags'
  FROM versions WHERE shadow_verdict IS NOT NULL),
hist AS (SELECT *, CASE WHEN contains(lower(verdict), 'rolled back') THEN 'rolled back' WHEN starts_with(lower(verdict), 'promote') THEN 'promoted'
  WHEN contains(lower(verdict), 'no verdict') THEN 'refused' ELSE 'rejected' END AS outcome FROM h)"""

HISTORY_COLUMNS = "SELECT version, from_version, verdict, round(pr_auc_delta, 6) + 0.0 AS pr_auc_delta, margin_ses, rows, source, outcome FROM hist"


def _history(spark, sf_dir):
    return V.promotion_history(comparisons_view(spark, sf_dir), versions_view(spark, sf_dir))


@query("set_3_verdict_union", HISTORY_SQL + HISTORY_COLUMNS)
def verdict_union(spark, sf_dir):
    return _history(spark, sf_dir).withColumn("pr_auc_delta", r6("pr_auc_delta"))


@query("agg_22_outcome_counts", HISTORY_SQL + """
SELECT outcome, CASE WHEN outcome = 'promoted' THEN 'promoted' ELSE 'declined' END AS side, count(*) AS n FROM hist GROUP BY 1, 2""")
def outcome_counts(spark, sf_dir):
    return V.outcome_counts(_history(spark, sf_dir))


@query("vw_5_promotion_history", HISTORY_SQL + """
SELECT version, source, outcome, count(*) AS records, round(max(pr_auc_delta), 6) + 0.0 AS best_delta FROM hist GROUP BY ALL""")
def promotion_history(spark, sf_dir):
    return _history(spark, sf_dir).groupBy("version", "source", "outcome").agg(
        F.count("*").alias("records"), r6(F.max("pr_auc_delta")).alias("best_delta"))


@query("jn_8_training_window", REGISTRY + """
SELECT version, v.run_id, max(value) FILTER (key = 'retrain.window_start_dt') AS trained_from, max(value) FILTER (key = 'retrain.window_end_dt') AS trained_to
FROM versions v LEFT JOIN runs r ON v.run_id = r.run_id GROUP BY 1, 2""")
def training_window(spark, sf_dir):
    return RG.training_windows(versions_view(spark, sf_dir), runs_view(spark, sf_dir))


@query("jn_9_threshold", REGISTRY + """,
own AS (SELECT run_id, value FROM runs WHERE key = 'val.at_best_f1_threshold.threshold'),
role AS (SELECT * FROM (VALUES ('Production', 0.8018::DOUBLE), ('Staging', 0.75)) t(stage, fb))
SELECT version, coalesce(value, fb) AS threshold, CASE WHEN value IS NOT NULL THEN 'run ' || v.run_id
  WHEN fb IS NOT NULL THEN 'role fallback' ELSE 'none' END AS threshold_source
FROM versions v LEFT JOIN own USING (run_id) LEFT JOIN role USING (stage)""")
def version_threshold(spark, sf_dir):
    fallback = small_table(spark, [("Production", 0.8018), ("Staging", 0.75)], "stage string, fallback_threshold double")
    return RG.thresholds(versions_view(spark, sf_dir), runs_view(spark, sf_dir), fallback)


CHAMPION_SQL = """
champ AS (SELECT version, run_id, stage, al AS alias FROM (SELECT version, run_id, stage, unnest(aliases) AS al FROM versions)
  WHERE al IN ('champion', 'staging') ORDER BY CASE al WHEN 'champion' THEN 1 ELSE 2 END, version DESC LIMIT 1)"""


@query("jn_10_champion", REGISTRY + "," + CHAMPION_SQL + "SELECT version, run_id, stage, alias FROM champ")
def champion(spark, sf_dir):
    return RG.resolve_champion(versions_view(spark, sf_dir))


@query("jn_11_lineage", "WITH " + COMPARISONS_SQL + "," + ALERTS_SQL + """
SELECT c.id AS comparison_id, to_version, trigger_alert_id, c.verdict, coalesce(a.verdict, '-') AS alert_verdict, a.value_drift_psi,
  coalesce(r.run_id, '-') AS run_id, coalesce(r.model_version, '-') AS model_version
FROM comparisons c LEFT JOIN alerts a ON trigger_alert_id = a.id LEFT JOIN resolutions r ON trigger_alert_id = r.alert_id""")
def lineage(spark, sf_dir):
    rows = RG.lineage(comparisons_view(spark, sf_dir), alerts_view(spark, sf_dir), resolutions_view(spark, sf_dir))
    dash = F.lit("-")
    return rows.withColumns({c: F.coalesce(c, dash) for c in ("alert_verdict", "run_id", "model_version")})


@query("jn_12_evidence", "WITH " + COMPARISONS_SQL + """,
pool AS (SELECT to_version AS version, 'promotion' AS source, 0 AS rank, id, challenger_pr_auc AS pr_auc, pr_auc_delta AS delta, comparison_rows AS rows FROM comparisons WHERE verdict = 'PROMOTE'
  UNION ALL SELECT to_version, 'challenger', 1, id, challenger_pr_auc, pr_auc_delta, comparison_rows FROM comparisons
  UNION ALL SELECT from_version, 'champion', 2, id, champion_pr_auc, pr_auc_delta, comparison_rows FROM comparisons)
SELECT version, source, id, round(pr_auc, 6) + 0.0 AS pr_auc, round(delta, 6) + 0.0 AS delta, rows FROM pool
QUALIFY row_number() OVER (PARTITION BY version ORDER BY rank, id DESC) = 1""")
def evidence(spark, sf_dir):
    return RG.evidence(comparisons_view(spark, sf_dir)).withColumns({"pr_auc": r6("pr_auc"), "delta": r6("delta")})


@query("gate_3_registry_view", REGISTRY + """
SELECT version, stage, array_to_string(aliases, ', ') AS aliases, coalesce(origin, 'baseline') AS origin,
  coalesce(archived_reason, promotion_rolled_back, shadow_verdict, '') AS note FROM versions""")
def registry_view(spark, sf_dir):
    return RG.registry_view(versions_view(spark, sf_dir))


@query("gate_4_champion_card", REGISTRY + "," + CHAMPION_SQL + "," + ALERTS_SQL + """,
kv AS (SELECT run_id, max(value) FILTER (key = 'val.pr_auc') AS pr_auc, max(value) FILTER (key = 'val.at_best_f1_threshold.threshold') AS threshold,
  max(value) FILTER (key = 'trigger.alert_id') AS trigger_alert_id FROM runs GROUP BY 1)
SELECT version, stage, alias, c.run_id, round(pr_auc, 6) + 0.0 AS pr_auc, round(threshold, 6) + 0.0 AS threshold, trigger_alert_id,
  coalesce(verdict, '-') AS trigger_verdict FROM champ c LEFT JOIN kv USING (run_id) LEFT JOIN alerts a ON a.id = trigger_alert_id""")
def champion_card(spark, sf_dir):
    row = RG.champion_card(versions_view(spark, sf_dir), runs_view(spark, sf_dir), alerts_view(spark, sf_dir))
    return row.withColumns({"pr_auc": r6("pr_auc"), "threshold": r6("threshold"),
                            "trigger_verdict": F.coalesce("trigger_verdict", F.lit("-"))})


EVENTS_SQL = """
WITH ev AS (
  SELECT s_suppkey * 10 + k AS event_id, CASE WHEN k = 7 THEN s_suppkey - 1 ELSE s_suppkey END AS version, kind, value
  FROM supplier, (VALUES (1, 'registered', ''), (2, 'stage', 'Staging'), (3, 'alias_set', 'challenger'),
    (4, 'stage', 'Production'), (5, 'alias_set', 'champion'), (6, 'alias_removed', 'challenger'), (7, 'stage', 'Archived')) t(k, kind, value)
  WHERE (k <= 3 OR s_nationkey % 3 = 0) AND (k <> 7 OR s_suppkey > 0)),
st AS (SELECT version, max_by(value, event_id) FILTER (kind = 'stage') AS stage FROM ev GROUP BY 1),
al AS (SELECT value AS alias, max_by(version, event_id) AS version, max_by(kind, event_id) AS kind FROM ev WHERE kind LIKE 'alias%' GROUP BY 1),
ag AS (SELECT version, string_agg(alias, ',' ORDER BY alias) AS aliases FROM al WHERE kind = 'alias_set' GROUP BY 1)
SELECT version, stage, coalesce(aliases, '') AS aliases FROM st LEFT JOIN ag USING (version)"""


def _events(spark, sf_dir):
    """Every supplier registers as a challenger; some are promoted, archiving the one before."""
    steps = [(1, "registered", ""), (2, "stage", "Staging"), (3, "alias_set", "challenger"), (4, "stage", "Production"),
             (5, "alias_set", "champion"), (6, "alias_removed", "challenger"), (7, "stage", "Archived")]
    c, s = F.col, F.col("s_suppkey")
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(v).alias("value")) for k, kind, v in steps])
    rows = table(spark, sf_dir, "supplier").select(s, "s_nationkey", F.inline(entries)).where(
        ((c("k") <= 3) | (c("s_nationkey") % 3 == 0)) & ((c("k") != 7) | (s > 0)))
    return rows.select(
        (s * 10 + c("k")).alias("event_id"), F.when(c("k") == 7, s - 1).otherwise(s).alias("version"),
        F.concat(F.lit("run-"), s.cast("string")).alias("run_id"), "kind", "value")


@query("gate_2_registry_state", EVENTS_SQL)
def registry_state(spark, sf_dir):
    return RG.registry_state(_events(spark, sf_dir)).select(
        "version", "stage", F.array_join("aliases", ",").alias("aliases"))


@query("gate_6_newest_run", """
SELECT s_nationkey::BIGINT AS model, 'run-' || CAST(max_by(s_suppkey, s_acctbal) AS VARCHAR) AS run_id,
  max(s_suppkey) + 1 AS next_version FROM supplier GROUP BY 1""")
def newest_run(spark, sf_dir):
    runs = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("bigint").alias("model"), F.concat(F.lit("run-"), F.col("s_suppkey").cast("string")).alias("run_id"),
        F.col("s_acctbal").alias("start_time"), "s_suppkey")
    nexts = runs.groupBy("model").agg((F.max("s_suppkey") + 1).alias("next_version"))
    return RG.newest_run(runs).join(nexts, "model")
