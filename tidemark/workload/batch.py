"""Batch queries: sources, sinks, projections, filters, joins, splits, encoding."""

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import encoding as E
from tidemark.operators import splits as X
from tidemark.operators.ordering import ordered_index
from tidemark.plans import views as V
from tidemark.session import scratch_path, small_table
from tidemark.sources import manifest as MF
from tidemark.sources import tables as TB
from tidemark.workload.base import query, r6, table
from tidemark.workload.fixtures import (
    ALERTS_SQL,
    AUDIT_SQL,
    COMPARISONS_SQL,
    DRIFT_KEY,
    DRIFT_SQL,
    PAIRED_SQL,
    alerts_view,
    audit_view,
    comparisons_view,
    drift_view,
    line_bounds,
    paired_view,
)

LATEST_ORDERS = "SELECT max(epoch(o_orderdate)) AS hi, min(epoch(o_orderdate)) AS lo FROM orders"

# --- sources --------------------------------------------------------------------------


@query("src_1_parquet_split", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY 1")
def parquet_split(spark, sf_dir):
    lines = TB.read_split(spark, f"{sf_dir}/lineitem.parquet", "l_quantity double, l_returnflag string")
    return lines.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("qty")
    )


@query("src_2_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def first_rows(spark, sf_dir):
    return TB.read_split(spark, f"{sf_dir}/orders.parquet", sample=100,
                         order=["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("src_3_csv_scan", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) + 0.0 AS balance FROM customer GROUP BY 1")
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "customer-csv")
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    rows = TB.read_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return rows.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), (F.round(F.sum("c_acctbal"), 2) + 0.0).alias("balance")
    )


MANIFEST_SQL = "WITH " + DRIFT_SQL + """
SELECT split, count(*) AS rows, round(avg(label) * 100, 3) + 0.0 AS fraud_rate_pct FROM drift GROUP BY split"""


def _labelled_lines(spark, sf_dir):
    hit = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
    return table(spark, sf_dir, "lineitem").withColumn("label", F.when(hit, 1).otherwise(0))


def _manifest(spark, sf_dir):
    lines = _labelled_lines(spark, sf_dir)
    return lines, MF.build_manifest(lines, "l_shipdate", "label", line_bounds(spark, sf_dir))


@query("src_4_manifest_scan", MANIFEST_SQL)
def manifest_scan(spark, sf_dir):
    """Write the manifest, read it back under its schema, list its splits."""
    _, manifest = _manifest(spark, sf_dir)
    path = scratch_path(spark, "manifest")
    TB.write_json_report(manifest, path)
    loaded = MF.read_manifest(spark, path)
    return loaded.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("split"), F.col(f"splits.{s}.rows").alias("rows"),
                 F.col(f"splits.{s}.fraud_rate_pct").alias("fraud_rate_pct")) for s in MF.SPLITS
    ])))


@query("src_6_alert_scan", "WITH " + ALERTS_SQL + """
SELECT id, verdict, value_drift_psi, missingness_psi FROM alerts ORDER BY id DESC LIMIT 12""")
def alert_scan(spark, sf_dir):
    return TB.latest(alerts_view(spark, sf_dir), 12).select("id", "verdict", "value_drift_psi", "missingness_psi")


@query("src_7_audit_newest", "WITH " + AUDIT_SQL + "SELECT id, decision, model_version FROM audit ORDER BY id DESC LIMIT 500")
def audit_newest(spark, sf_dir):
    return TB.latest(audit_view(spark, sf_dir), 500).select("id", "decision", "model_version")


@query("src_8_promotion_scan", "WITH " + COMPARISONS_SQL + "SELECT id, from_version, to_version, verdict FROM comparisons ORDER BY id")
def promotion_scan(spark, sf_dir):
    return comparisons_view(spark, sf_dir).orderBy("id").select("id", "from_version", "to_version", "verdict")


@query("src_9_missing_store", """
SELECT 'absent' AS store, 0::BIGINT AS rows UNION ALL SELECT 'present', count(*) FROM supplier""")
def missing_store(spark, sf_dir):
    store = TB.TableStore(spark, scratch_path(spark, "store"))
    schema = "s_suppkey bigint, s_acctbal double"
    absent = store.read("suppliers", schema)
    store.append("suppliers", table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"))
    present = TB.TableStore(spark, store.root).read("suppliers", schema)

    def size(df, name):
        return df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("store"), "rows")

    return size(absent, "absent").unionByName(size(present, "present"))


# --- sinks ----------------------------------------------------------------------------


@query("snk_1_split_sink", MANIFEST_SQL)
def split_sink(spark, sf_dir):
    """Partitioned write, then the statistics of what was written."""
    path = scratch_path(spark, "splits")
    TB.write_splits(_labelled_lines(spark, sf_dir), "l_shipdate", line_bounds(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("split").agg(
        F.count("*").alias("rows"), (F.round(F.avg("label") * 100, 3) + 0.0).alias("fraud_rate_pct")
    )


@query("snk_4_alert_sink", "WITH " + ALERTS_SQL + """
SELECT 1::BIGINT AS id, max(value_drift_psi) AS value_drift_psi, sum(window_rows)::BIGINT AS window_rows FROM alerts UNION ALL
SELECT 2, max(missingness_psi), count(*) FROM alerts""")
def alert_sink(spark, sf_dir):
    """Two one-row appends receive consecutive ids."""
    store = TB.TableStore(spark, scratch_path(spark, "alerts"))
    alerts = alerts_view(spark, sf_dir)
    schema = "id bigint, value_drift_psi double, window_rows bigint"
    store.append_numbered("alerts", alerts.agg(
        F.max("value_drift_psi").alias("value_drift_psi"), F.sum("window_rows").alias("window_rows")), schema)
    store.append_numbered("alerts", alerts.agg(
        F.max("missingness_psi").alias("value_drift_psi"), F.count("*").alias("window_rows")), schema)
    return store.read("alerts", schema)


@query("snk_5_unseen_sink", """
SELECT event_type AS feature, CAST(user_id % 23 AS VARCHAR) AS value, count(*) AS occurrences, 'v1' AS model_version FROM events GROUP BY ALL""")
def unseen_sink(spark, sf_dir):
    store = TB.TableStore(spark, scratch_path(spark, "unseen"))
    counts = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("feature"), (F.col("user_id") % 23).cast("string").alias("value")
    ).agg(F.count("*").alias("occurrences"))
    TB.record_unseen(store, counts, "v1", "batch")
    return store.read("unseen_observations", TB.UNSEEN_SCHEMA).select(
        "feature", "value", "occurrences", "model_version"
    )


@query("snk_6_verdict_sink", "WITH " + COMPARISONS_SQL + "SELECT verdict, count(*) AS n, CAST(max(id) AS BIGINT) AS newest FROM comparisons GROUP BY 1")
def verdict_sink(spark, sf_dir):
    """Every verdict is written, promotions or not."""
    store = TB.TableStore(spark, scratch_path(spark, "comparisons"))
    rows = comparisons_view(spark, sf_dir)
    store.append("comparisons", rows)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return store.read("comparisons", schema).groupBy("verdict").agg(
        F.count("*").alias("n"), F.max("id").alias("newest")
    )


@query("snk_7_csv_report", "SELECT p_brand AS feature, count(*) AS n, round(avg(p_size), 6) + 0.0 AS mean_size FROM part GROUP BY 1")
def csv_report(spark, sf_dir):
    path = scratch_path(spark, "report-csv")
    TB.write_csv_report(
        table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(
            F.count("*").alias("n"), r6(F.avg("p_size")).alias("mean_size")), path)
    return TB.read_csv(spark, path, "feature string, n bigint, mean_size double")


@query("snk_8_json_report", "WITH " + AUDIT_SQL + """
SELECT model_version, count(*) AS rows, count(*) FILTER (decision = 'BLOCK') AS blocked FROM audit GROUP BY 1""")
def json_report(spark, sf_dir):
    path = scratch_path(spark, "report-json")
    counts = audit_view(spark, sf_dir).groupBy("model_version").agg(
        F.count("*").alias("rows"), F.count_if(F.col("decision") == "BLOCK").alias("blocked"))
    TB.write_json_report(counts.select("model_version", F.struct("rows", "blocked").alias("serving")), path)
    return spark.read.schema("model_version string, serving struct<rows: bigint, blocked: bigint>").json(path).select(
        "model_version", "serving.rows", "serving.blocked"
    )


RUN_ROWS_SQL = """
SELECT r_name AS run, key, round(value, 6) + 0.0 AS value FROM (
  SELECT r_name, count(*)::DOUBLE AS a, avg(c_acctbal) AS b, max(c_acctbal) AS c
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
CROSS JOIN LATERAL (VALUES ('rows', a), ('balance.mean', b), ('balance.max', c)) t(key, value)"""


def _nested_metrics(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return customers.groupBy(F.col("r_name").alias("run")).agg(
        F.count("*").alias("rows"),
        F.struct(F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("max"),
                 (F.max("c_acctbal") > 0).alias("flag"), F.lit(float("nan")).alias("undefined")).alias("balance"),
    )


@query("fn_15_flatten_metrics", RUN_ROWS_SQL)
def flatten_metrics(spark, sf_dir):
    return TB.flatten_metrics(_nested_metrics(spark, sf_dir), ["run"]).withColumn("value", r6("value"))


@query("snk_9_run_records", RUN_ROWS_SQL)
def run_records(spark, sf_dir):
    """Metrics of every run appended as rows and read back."""
    store = TB.TableStore(spark, scratch_path(spark, "runs"))
    rows = TB.flatten_metrics(_nested_metrics(spark, sf_dir), ["run"])
    store.append("runs", rows.select(
        F.col("run").alias("run_id"), F.lit("metric").alias("kind"), "key", F.col("value").cast("string").alias("value")))
    stored = store.read("runs", TB.RUN_SCHEMA)
    return stored.select(F.col("run_id").alias("run"), "key", r6(F.col("value").cast("double")).alias("value"))


# --- projections ------------------------------------------------------------------------


@query("prj_1_feature_projection", "SELECT c_mktsegment, c_acctbal, c_nationkey::BIGINT AS c_nationkey FROM customer")
def feature_projection(spark, sf_dir):
    kept = E.feature_frame(table(spark, sf_dir, "customer"), None, ["c_custkey", "c_name"])
    return kept.withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))


@query("prj_2_label", "SELECT quality, count(*) AS n FROM (SELECT quality::BIGINT AS quality FROM labels) GROUP BY 1")
def label_projection(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.select(E.label_column(labels, "quality").alias("quality")).groupBy(
        F.col("quality").cast("bigint").alias("quality")
    ).agg(F.count("*").alias("n"))


@query("prj_3_categorical_columns", """
SELECT feature, n FROM (VALUES
  ('l_returnflag', (SELECT count(DISTINCT l_returnflag) FROM lineitem)),
  ('l_linestatus', (SELECT count(DISTINCT l_linestatus) FROM lineitem))) t(feature, n)""")
def categorical_selection(spark, sf_dir):
    """Text is categorical, a flag is not."""
    lines = table(spark, sf_dir, "lineitem").drop("l_shipdate").withColumn("bulk", F.col("l_quantity") > 40)
    columns = E.categorical_columns(lines)
    return E.distinct_levels(lines, columns).groupBy("feature").agg(F.count("*").alias("n"))


@query("prj_6_float_cast", "SELECT doc_id, CAST(CAST(quality AS FLOAT) AS DOUBLE) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def float_cast(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.col("quality").cast("float").cast("double").alias("quality"))


@query("prj_7_schema_contract", "WITH " + DRIFT_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dt, l_extendedprice,
  CAST(f_stable AS DOUBLE) AS f_stable FROM
  (SELECT *, CAST(CAST(f_stable AS FLOAT) AS DOUBLE) AS s FROM drift) WHERE split = 'val'""")
def schema_contract(spark, sf_dir):
    """A frame with shuffled and extra columns is put back into fitted order."""
    train = drift_view(spark, sf_dir, "train").select("f_stable", "f_cat")
    model = E.FeatureEncoder().fit(train)
    other = drift_view(spark, sf_dir, "val").select("f_cat", "split", *DRIFT_KEY, "f_stable")
    encoded = model.transform(other, keep=DRIFT_KEY)
    return encoded.select(
        *DRIFT_KEY, F.round(F.col("f_stable").cast("double"), 2).alias("f_stable")
    ).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


# --- filters ----------------------------------------------------------------------------


@query("flt_1_temporal_routing", "WITH " + DRIFT_SQL + "SELECT split, count(*) AS rows, min(dt) AS first_dt, max(dt) AS last_dt FROM drift GROUP BY 1")
def temporal_routing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    t = S.epoch_seconds(F.col("l_shipdate"))
    return lines.groupBy(X.split_name(lines, "l_shipdate", line_bounds(spark, sf_dir)).alias("split")).agg(
        F.count("*").alias("rows"), F.min(t).alias("first_dt"), F.max(t).alias("last_dt")
    )


@query("flt_2_left_bound", "SELECT count(*) AS rows, min(epoch(o_orderdate)) AS first_dt FROM orders WHERE epoch(o_orderdate) >= 883612800.0")
def left_bound(spark, sf_dir):
    kept = X.starting_at(table(spark, sf_dir, "orders"), "o_orderdate", 883612800.0)
    return kept.agg(F.count("*").alias("rows"), F.min(S.epoch_seconds(F.col("o_orderdate"))).alias("first_dt"))


@query("flt_3_right_bound", "SELECT count(*) AS rows, max(epoch(o_orderdate)) AS last_dt FROM orders WHERE epoch(o_orderdate) < 883612800.0")
def right_bound(spark, sf_dir):
    kept = X.ending_before(table(spark, sf_dir, "orders"), "o_orderdate", 883612800.0)
    return kept.agg(F.count("*").alias("rows"), F.max(S.epoch_seconds(F.col("o_orderdate"))).alias("last_dt"))


@query("flt_4_recent_days", "WITH e AS (" + LATEST_ORDERS + """)
SELECT o_orderkey, o_totalprice FROM orders, e WHERE epoch(o_orderdate) >= hi - least(90 * 86400.0, hi - lo)""")
def recent_days(spark, sf_dir):
    return X.recent_days(table(spark, sf_dir, "orders"), "o_orderdate", 90).select("o_orderkey", "o_totalprice")


@query("flt_5_recent_rows", """
SELECT o_orderkey FROM (SELECT o_orderkey, rank() OVER (ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r <= 1000""")
def recent_rows(spark, sf_dir):
    return X.recent_rows(table(spark, sf_dir, "orders"), "o_orderdate", 1000).select("o_orderkey")


NEWEST_PAIR_SQL = "WITH " + AUDIT_SQL + """,
usable AS (SELECT * FROM audit WHERE challenger_probability IS NOT NULL AND true_label IS NOT NULL),
newest AS (SELECT model_version AS mv, challenger_version AS cv FROM usable ORDER BY id DESC LIMIT 1)"""


@query("flt_7_joint_rows", NEWEST_PAIR_SQL + """
SELECT id, model_version, challenger_version, fraud_probability, challenger_probability
FROM usable, newest WHERE model_version = mv AND challenger_version = cv""")
def joint_rows(spark, sf_dir):
    rows = V.paired_rows(audit_view(spark, sf_dir))
    return rows.select("id", "model_version", "challenger_version", "fraud_probability", "challenger_probability")


@query("win_7_newest_pair", NEWEST_PAIR_SQL + "SELECT mv AS model_version, cv AS challenger_version FROM newest")
def newest_pair(spark, sf_dir):
    return V.newest_pair(audit_view(spark, sf_dir))


@query("flt_9_since", """
SELECT event_type, count(*) AS n FROM events WHERE epoch(ts) >= 1705276800.0 GROUP BY 1""")
def since(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return V.since(events, "ts", 1705276800.0).groupBy("event_type").agg(F.count("*").alias("n"))


@query("flt_10_non_empty_list", "WITH " + AUDIT_SQL + "SELECT id FROM audit WHERE len(unseen_categories) > 0")
def non_empty_list(spark, sf_dir):
    return audit_view(spark, sf_dir).where(F.size("unseen_categories") > 0).select("id")


@query("flt_11_flagged_or_ranked", "WITH " + PAIRED_SQL + """,
f AS (SELECT 'cleared' AS cut, id, p_champion FROM paired WHERE p_champion >= 0.9 UNION ALL
      SELECT 'fallback', id, p_champion FROM paired)
SELECT cut, id, p_champion FROM f QUALIFY row_number() OVER (PARTITION BY cut ORDER BY p_champion DESC, id) <= 5""")
def flagged_or_ranked(spark, sf_dir):
    """One threshold some rows clear, one that none does."""
    rows = paired_view(spark, sf_dir).select("id", "p_champion")
    parts = [
        V.flagged_or_ranked(rows, "p_champion", at, ["id"], 5).withColumn("cut", F.lit(name))
        for name, at in (("cleared", 0.9), ("fallback", 1.5))
    ]
    return parts[0].unionByName(parts[1])


# --- predicates -------------------------------------------------------------------------


@query("prd_1_decision", "WITH " + PAIRED_SQL + "SELECT id, CASE WHEN p_champion >= 0.5 THEN 'BLOCK' ELSE 'ALLOW' END AS decision FROM paired")
def decisions(spark, sf_dir):
    return paired_view(spark, sf_dir).select("id", S.decision(F.col("p_champion"), F.lit(0.5)).alias("decision"))


@query("prd_2_missing", """
SELECT source, count(*) FILTER (q IS NULL) AS null_quality,
  count(*) FILTER (trim(CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE lang END) = '') AS blank_text
FROM (SELECT d.*, l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def missing_states(spark, sf_dir):
    from pyspark.sql import types as T

    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    quality = F.coalesce(F.col("quality").cast("double"), F.lit(float("nan")))
    text = F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.col("lang"))
    return docs.groupBy("source").agg(
        F.count_if(S.is_missing(quality, T.DoubleType())).alias("null_quality"),
        F.count_if(S.is_missing(text, T.StringType())).alias("blank_text"),
    )


@query("prd_3_numeric_coercion", """
SELECT count(*) AS rows, count(n) AS numeric_rows, CAST(sum(n) AS BIGINT) AS total
FROM (SELECT TRY_CAST(CASE WHEN event_id % 3 = 0 THEN props ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS n FROM events)""")
def numeric_coercion(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(S.to_number(text).alias("n")).agg(
        F.count("*").alias("rows"), F.count("n").alias("numeric_rows"), F.sum("n").cast("bigint").alias("total")
    )


@query("prd_5_verdict_outcome", "WITH " + COMPARISONS_SQL + """
SELECT id, CASE WHEN contains(lower(verdict), 'rolled back') THEN 'rolled back'
  WHEN starts_with(lower(verdict), 'promote') THEN 'promoted'
  WHEN contains(lower(verdict), 'no verdict') THEN 'refused' ELSE 'rejected' END AS outcome FROM comparisons""")
def verdict_outcome(spark, sf_dir):
    return comparisons_view(spark, sf_dir).select("id", S.verdict_outcome(F.col("verdict")).alias("outcome"))


@query("prd_6_drift_verdict", "WITH " + ALERTS_SQL + "SELECT id, verdict FROM alerts")
def drift_verdict(spark, sf_dir):
    retrain, pipeline = F.col("value_drift_psi") >= 0.2, F.col("missingness_psi") >= 0.2
    return alerts_view(spark, sf_dir).select("id", S.drift_verdict(retrain, pipeline).alias("verdict"))


@query("prd_7_gate_verdict", "WITH " + COMPARISONS_SQL + """
SELECT id, CASE WHEN id % 11 = 0 THEN 'NO VERDICT -- evaluation rows overlap the challenger''s training window'
  WHEN id % 7 = 0 THEN 'NO PROMOTION -- insufficient data'
  WHEN pr_auc_delta > 0 AND margin_in_ses >= 1.0 THEN 'PROMOTE'
  WHEN pr_auc_delta <= 0 THEN 'NO PROMOTION -- challenger is not ahead'
  ELSE 'no promotion, difference within noise' END AS verdict FROM comparisons""")
def gate_verdict(spark, sf_dir):
    c = F.col
    leaked = S.leaked(F.when(c("id") % 11 == 0, 0.5).when(c("id") % 13 == 0, None).otherwise(0.0))
    return comparisons_view(spark, sf_dir).select(
        "id", S.gate_verdict(leaked, c("id") % 7 != 0, c("pr_auc_delta"), c("margin_in_ses")).alias("verdict")
    )


@query("prd_8_manifest_bounds", "WITH " + DRIFT_SQL + """
SELECT rule, holds FROM bounds CROSS JOIN LATERAL (VALUES ('span_positive', hi > lo),
  ('month3_end_on_sixth', abs(m3 - (lo + (hi - lo) / 6 * 3)) <= 1), ('month4_end_on_sixth', abs(m4 - (lo + (hi - lo) / 6 * 4)) <= 1),
  ('strictly_increasing', lo < m3 AND m3 < m4 AND m4 < hi)) t(rule, holds)""")
def manifest_bounds(spark, sf_dir):
    return MF.boundary_checks(_manifest(spark, sf_dir)[1])


@query("prd_9_split_identity", "WITH " + DRIFT_SQL + """,
s AS (SELECT split, count(*) AS n, round(avg(label) * 100, 3) + 0.0 AS rate FROM drift GROUP BY 1)
SELECT split, n AS recorded_rows, n AS rows, rate AS recorded_rate_pct, rate AS fraud_rate_pct,
  CAST(round(n * rate / 100.0) AS BIGINT) AS implied_positives, TRUE AS rows_match, TRUE AS rate_matches FROM s""")
def split_identity(spark, sf_dir):
    lines, manifest = _manifest(spark, sf_dir)
    return MF.split_identity(manifest, lines, "l_shipdate", "label")


@query("fn_17_implied_positives", "WITH " + DRIFT_SQL + """,
s AS (SELECT split, count(*) AS n, round(avg(label) * 100, 3) AS rate, sum(label)::BIGINT AS positives FROM drift GROUP BY 1)
SELECT split, positives, CAST(round(n * rate / 100.0) AS BIGINT) AS implied FROM s""")
def implied_positives(spark, sf_dir):
    sums = drift_view(spark, sf_dir).groupBy("split").agg(
        F.count("*").alias("n"), F.round(F.avg("label") * 100, 3).alias("rate"), F.sum("label").alias("positives"))
    return sums.select("split", "positives", S.implied_positives(F.col("n"), F.col("rate")).alias("implied"))


@query("prd_10_live_flag", "WITH " + AUDIT_SQL + """
SELECT model_version, (SELECT max(epoch(scored_at)) FROM audit) + 60.0 - max(epoch(scored_at)) < 120 AS live FROM audit GROUP BY 1""")
def live_flag(spark, sf_dir):
    audit = audit_view(spark, sf_dir)
    now = audit.agg(F.max(S.epoch_seconds(F.col("scored_at"))) + 60.0).scalar()
    return audit.groupBy("model_version").agg(V.live(F.max(S.epoch_seconds(F.col("scored_at"))), now).alias("live"))


@query("prd_11_score_match", "WITH " + COMPARISONS_SQL + """
SELECT id, CASE WHEN round(abs(challenger_pr_auc - champion_pr_auc), 9) <= 0.01 THEN 'MATCH' ELSE 'DIVERGED' END AS status
FROM comparisons""")
def score_match(spark, sf_dir):
    """Run scores against the scores on record, joined by version."""
    rows = comparisons_view(spark, sf_dir)
    scores = rows.select("id", F.col("challenger_pr_auc").alias("score"))
    recorded = rows.select("id", F.col("champion_pr_auc").alias("expected"))
    return scores.join(recorded, "id").select(
        "id", S.match_flag(F.col("score"), F.col("expected")).alias("status")
    )


# --- joins and encoding -----------------------------------------------------------------


@query("jn_1_left_join", """
SELECT source, count(*) AS rows, count(quality) AS labelled, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def left_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("rows"), F.count("quality").alias("labelled"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )


VOCAB_SQL = "WITH " + DRIFT_SQL + """,
levels AS (SELECT 'f_cat' AS feature, f_cat AS level FROM drift WHERE split = 'train' AND f_cat IS NOT NULL UNION
           SELECT 'f_catmiss', f_catmiss FROM drift WHERE split = 'train' AND f_catmiss IS NOT NULL),
vocab AS (SELECT feature, level, CAST(row_number() OVER (PARTITION BY feature ORDER BY level) - 1 AS BIGINT) AS code FROM levels),
stream AS (SELECT 'f_cat' AS feature, f_cat AS level FROM drift WHERE split = 'stream' UNION ALL
           SELECT 'f_catmiss', f_catmiss FROM drift WHERE split = 'stream'),
looked AS (SELECT s.feature, s.level, code, CASE WHEN s.level IS NULL THEN 'missing' WHEN code IS NULL THEN 'unseen' ELSE 'seen' END AS state
           FROM stream s LEFT JOIN vocab v ON s.feature = v.feature AND s.level = v.level)"""

CATEGORIES = ["f_cat", "f_catmiss"]


def _vocabulary(spark, sf_dir):
    train = drift_view(spark, sf_dir, "train").select(*CATEGORIES)
    return E.FeatureEncoder().fit(train)


def _stream_long(spark, sf_dir):
    return E.levels_long(drift_view(spark, sf_dir, "stream"), CATEGORIES)


@query("enc_1_fit_vocabulary", VOCAB_SQL + "SELECT feature, level, code FROM vocab")
def fit_vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir).vocabulary.withColumn("code", F.col("code").cast("bigint"))


@query("win_3_level_numbers", VOCAB_SQL + "SELECT feature, level, code FROM vocab")
def level_numbers(spark, sf_dir):
    """The same numbering over range partitions, as large vocabularies get it."""
    train = drift_view(spark, sf_dir, "train")
    return E.number_levels(E.distinct_levels(train, CATEGORIES), window_levels=0).withColumn(
        "code", F.col("code").cast("bigint")
    )


@query("agg_7_distinct_levels", VOCAB_SQL + "SELECT feature, level FROM levels")
def distinct_levels(spark, sf_dir):
    return E.distinct_levels(drift_view(spark, sf_dir, "train"), CATEGORIES)


@query("agg_10_cardinality", VOCAB_SQL + "SELECT feature, count(*) AS levels FROM vocab GROUP BY 1")
def cardinality(spark, sf_dir):
    return _vocabulary(spark, sf_dir).cardinality()


@query("jn_2_vocabulary_lookup", VOCAB_SQL + """
SELECT feature, coalesce(level, '<null>') AS level, state, CAST(coalesce(code, -1) AS BIGINT) AS code, count(*) AS n FROM looked GROUP BY ALL""")
def vocabulary_lookup(spark, sf_dir):
    looked = E.vocabulary_lookup(_stream_long(spark, sf_dir), _vocabulary(spark, sf_dir).vocabulary)
    return looked.groupBy(
        "feature", F.coalesce("level", F.lit("<null>")).alias("level"), "state",
        F.coalesce("code", F.lit(-1)).cast("bigint").alias("code"),
    ).agg(F.count("*").alias("n"))


@query("jn_3_unseen_levels", VOCAB_SQL + "SELECT feature, level, count(*) AS occurrences FROM looked WHERE state = 'unseen' GROUP BY 1, 2")
def unseen_levels(spark, sf_dir):
    return E.unseen_levels(_stream_long(spark, sf_dir), _vocabulary(spark, sf_dir).vocabulary)


@query("agg_9_state_tally", VOCAB_SQL + """
SELECT l.feature, max(n) AS levels, count(*) FILTER (state = 'unseen') AS unknown_rows,
  round(100.0 * count(*) FILTER (state = 'unseen') / count(*), 6) + 0.0 AS unknown_pct,
  round(100.0 * count(*) FILTER (state = 'missing') / count(*), 6) + 0.0 AS missing_pct
FROM looked l JOIN (SELECT feature, count(*) AS n FROM vocab GROUP BY 1) USING (feature) GROUP BY 1""")
def state_tally(spark, sf_dir):
    tally = E.state_tally(_stream_long(spark, sf_dir), _vocabulary(spark, sf_dir).vocabulary)
    return tally.select("feature", "levels", "unknown_rows", r6("unknown_pct").alias("unknown_pct"),
                        r6("missing_pct").alias("missing_pct"))


ENCODED_SQL = VOCAB_SQL + """,
enc AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dt, l_extendedprice, f_cover,
    CASE WHEN f_cat IS NOT NULL THEN coalesce((SELECT code FROM vocab WHERE feature = 'f_cat' AND level = f_cat), -1) END AS cat,
    CASE WHEN f_catmiss IS NOT NULL THEN coalesce((SELECT code FROM vocab WHERE feature = 'f_catmiss' AND level = f_catmiss), -1) END AS catmiss,
    f_cat
  FROM drift WHERE split = 'stream')"""


def _encoded_stream(spark, sf_dir, states=False):
    names = ["f_cat", "f_catmiss", "f_cover"]
    model = E.FeatureEncoder().fit(drift_view(spark, sf_dir, "train").select(*names))
    return model, model.transform(drift_view(spark, sf_dir, "stream"), keep=DRIFT_KEY, states=states)


@query("enc_2_apply", ENCODED_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dt, l_extendedprice, CAST(cat AS DOUBLE) AS f_cat,
  CAST(catmiss AS DOUBLE) AS f_catmiss, round(f_cover, 6) + 0.0 AS f_cover FROM enc""")
def apply_vocabulary(spark, sf_dir):
    _, encoded = _encoded_stream(spark, sf_dir)
    return encoded.select(*DRIFT_KEY, F.col("f_cat").cast("double").alias("f_cat"),
                          F.col("f_catmiss").cast("double").alias("f_catmiss"),
                          r6(F.col("f_cover").cast("double")).alias("f_cover"))


@query("enc_3_fit_and_apply", """
WITH v AS (SELECT o_orderpriority AS level, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
           FROM (SELECT DISTINCT o_orderpriority FROM orders)),
s AS (SELECT o_orderstatus AS level, row_number() OVER (ORDER BY o_orderstatus) - 1 AS code
      FROM (SELECT DISTINCT o_orderstatus FROM orders))
SELECT CAST(v.code AS DOUBLE) AS o_orderpriority, CAST(s.code AS DOUBLE) AS o_orderstatus, count(*) AS n,
  CAST(sum(CASE WHEN o_custkey % 30 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS positives
FROM orders JOIN v ON o_orderpriority = v.level JOIN s ON o_orderstatus = s.level GROUP BY 1, 2""")
def fit_and_apply(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("label", F.when(F.col("o_custkey") % 30 == 0, 1).otherwise(0))
    X_, _ = E.build_features(orders, "label", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    return X_.groupBy(
        F.col("o_orderpriority").cast("double").alias("o_orderpriority"),
        F.col("o_orderstatus").cast("double").alias("o_orderstatus"),
    ).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("positives"))


@query("enc_4_saved_vocabulary", VOCAB_SQL + "SELECT feature, level, code FROM vocab")
def saved_vocabulary(spark, sf_dir):
    path = scratch_path(spark, "encoder")
    _vocabulary(spark, sf_dir).save(path)
    return E.EncoderModel.load(spark, path).vocabulary.withColumn("code", F.col("code").cast("bigint"))


@query("enc_5_row_states", ENCODED_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dt, l_extendedprice,
  concat_ws(',', CASE WHEN cat = -1 THEN 'f_cat' END, CASE WHEN catmiss = -1 THEN 'f_catmiss' END) AS unseen,
  concat_ws(',', CASE WHEN cat IS NULL THEN 'f_cat' END, CASE WHEN catmiss IS NULL THEN 'f_catmiss' END,
    CASE WHEN f_cover IS NULL THEN 'f_cover' END) AS missing FROM enc""")
def row_states(spark, sf_dir):
    _, encoded = _encoded_stream(spark, sf_dir, states=True)
    return encoded.select(*DRIFT_KEY, F.array_join("unseen", ",").alias("unseen"),
                          F.array_join("missing", ",").alias("missing"))


@query("enc_6_decode", ENCODED_SQL + """
SELECT CASE WHEN cat IS NULL THEN '<missing>' WHEN cat = -1 THEN '<unseen>' ELSE f_cat END AS label, count(*) AS n FROM enc GROUP BY 1""")
def decode(spark, sf_dir):
    model, encoded = _encoded_stream(spark, sf_dir)
    return encoded.groupBy(model.decode("f_cat", F.col("f_cat")).alias("label")).agg(F.count("*").alias("n"))


# --- temporal ----------------------------------------------------------------------------


@query("tmp_1_sixths", "WITH " + DRIFT_SQL + "SELECT lo AS low, hi AS high, m3 AS month3_end, m4 AS month4_end FROM bounds")
def sixth_boundaries(spark, sf_dir):
    b = line_bounds(spark, sf_dir)
    return small_table(spark, [(b.low, b.high, b.month3_end, b.month4_end)],
                       "low double, high double, month3_end double, month4_end double")


HOLDOUT_SQL = "WITH q AS (SELECT quantile_cont(epoch(o_orderdate), 0.85) AS cut FROM orders)"


@query("tmp_2_holdout", HOLDOUT_SQL + """
SELECT CASE WHEN epoch(o_orderdate) < cut THEN 'earlier' ELSE 'later' END AS part, count(*) AS rows,
  min(epoch(o_orderdate)) AS first_dt, max(epoch(o_orderdate)) AS last_dt FROM orders, q GROUP BY 1""")
def holdout(spark, sf_dir):
    earlier, later, _ = X.temporal_holdout(table(spark, sf_dir, "orders"), "o_orderdate", 0.15)
    t = S.epoch_seconds(F.col("o_orderdate"))

    def extent(df, name):
        return df.agg(F.count("*").alias("rows"), F.min(t).alias("first_dt"), F.max(t).alias("last_dt")).select(
            F.lit(name).alias("part"), "*")

    return extent(earlier, "earlier").unionByName(extent(later, "later"))


@query("agg_6_quantile_cut", "SELECT quantile_cont(epoch(o_orderdate), 0.85) AS cutoff FROM orders")
def quantile_cut(spark, sf_dir):
    cut = X.quantile_cut(table(spark, sf_dir, "orders"), "o_orderdate", 0.85)
    return small_table(spark, [(cut,)], "cutoff double")


@query("tmp_3_retrain_window", "WITH " + DRIFT_SQL + """,
u AS (SELECT * FROM drift WHERE split IN ('val', 'stream')),
w AS (SELECT * FROM u, (SELECT min(dt) AS a, max(dt) AS b FROM u) WHERE dt >= b - least(600 * 86400.0, b - a)),
c1 AS (SELECT quantile_cont(dt, 0.85) AS cut FROM w),
h AS (SELECT w.* FROM w, c1 WHERE dt < cut),
c2 AS (SELECT quantile_cont(dt, 0.85) AS cut2 FROM h)
SELECT part, count(*) AS rows, min(dt) AS first_dt, max(dt) AS last_dt, count(DISTINCT split) AS sources FROM (
  SELECT split, dt, CASE WHEN dt >= cut THEN 'evaluation' WHEN dt >= cut2 THEN 'stop' ELSE 'fit' END AS part FROM w, c1, c2) GROUP BY 1""")
def retrain_window(spark, sf_dir):
    bounds = line_bounds(spark, sf_dir)
    sources = {s: drift_view(spark, sf_dir, s, bounds) for s in ("val", "stream")}
    w = X.recent_training_window(sources, "dt", 600)

    def extent(df, name):
        return df.agg(F.count("*").alias("rows"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"),
                      F.countDistinct("source").alias("sources")).select(F.lit(name).alias("part"), "*")

    return extent(w.fit, "fit").unionByName(extent(w.stop, "stop")).unionByName(extent(w.evaluation, "evaluation"))


@query("tmp_4_day_offset", "WITH " + DRIFT_SQL + """
SELECT CAST(floor((dt - lo) / 86400) AS BIGINT) AS day, count(*) AS n FROM drift, bounds GROUP BY 1""")
def day_offset(spark, sf_dir):
    bounds = line_bounds(spark, sf_dir)
    day = F.floor(S.day_offset(S.epoch_seconds(F.col("l_shipdate")), bounds.low))
    return table(spark, sf_dir, "lineitem").groupBy(day.alias("day")).agg(F.count("*").alias("n"))


# --- sorts, limits, sets -------------------------------------------------------------------


@query("srt_1_replay_order", """
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS position FROM orders""")
def replay_positions(spark, sf_dir):
    """Positions in replay order, numbered over range partitions."""
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return ordered_index(orders, ["o_orderdate", "o_orderkey"], output="position").select(
        "o_orderkey", F.col("position").cast("bigint").alias("position")
    )


@query("srt_2_earliest_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE epoch(o_orderdate) >= 852076800.0 ORDER BY o_orderdate, o_orderkey LIMIT 250")
def earliest_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return X.replay_order(orders, "o_orderdate", ["o_orderkey"], 250, 852076800.0).select("o_orderkey", "o_totalprice")


@query("win_6_rank_numbers", "SELECT p_brand AS brand, CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS BIGINT) AS position FROM part GROUP BY 1")
def rank_numbers(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    ranked = ordered_index(counts.withColumn("k", -F.col("n")), ["k", "brand"])
    return ranked.select("brand", (F.col("index") + 1).cast("bigint").alias("position"))


@query("win_5_percent_share", "SELECT event_type, round(100.0 * sum(value) / sum(sum(value)) OVER (), 6) + 0.0 AS share_pct FROM events GROUP BY 1")
def percent_share(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    total = sums.agg(F.sum("v")).scalar()
    return sums.select("event_type", r6(F.lit(100.0) * F.col("v") / total).alias("share_pct"))


@query("set_1_union_sources", "WITH " + DRIFT_SQL + """
SELECT split AS source, count(*) AS rows, count(f_cover) AS covered FROM drift WHERE split <> 'val' GROUP BY 1""")
def union_sources(spark, sf_dir):
    """Aligned by name; the train source lacks one column, which arrives as NULL."""
    bounds = line_bounds(spark, sf_dir)
    train = drift_view(spark, sf_dir, "train", bounds).select("f_cover", "label", "dt")
    stream = drift_view(spark, sf_dir, "stream", bounds).select("dt", "label", "f_cover", "f_cat")
    return X.union_sources({"train": train, "stream": stream}).groupBy("source").agg(
        F.count("*").alias("rows"), F.count("f_cover").alias("covered"))


@query("set_4_partition_check", HOLDOUT_SQL + """
SELECT count(*) AS whole_rows, count(*) FILTER (epoch(o_orderdate) < cut) AS earlier_rows,
  count(*) FILTER (epoch(o_orderdate) >= cut) AS later_rows, 0::BIGINT AS mismatched_rows, 0::BIGINT AS keys_in_both,
  TRUE AS is_partition FROM orders, q""")
def partition_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    earlier, later, _ = X.temporal_holdout(orders, "o_orderdate", 0.15)
    return X.partition_check(orders, earlier, later, ["o_orderkey"])
