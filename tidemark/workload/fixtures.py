"""Views over the given tables that play the roles of the engine's own tables.

Each view exists twice, as a DataFrame and as SQL text, written independently so
that the two sides check each other. All are row-wise or grouped derivations, so
they grow with the tables they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import epoch_seconds
from tidemark.operators.splits import SplitBoundaries, split_boundaries, split_name, take_split
from tidemark.workload.base import table

DRIFT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "dt", "l_extendedprice"]
DRIFT_FEATURES = ["f_value", "f_cover", "f_cat", "f_catmiss", "f_stable", "f_bool", "f_const"]
DRIFT_EXCLUDE = [*DRIFT_KEY, "label", "split", "l_shipdate"]
#: Parts that may be broadcast, about 64 bytes each on the driver. Spark goes by the bytes of the file, a tenth of these.
BROADCAST_PARTS = 250_000

# --- drift view: lineitem with its part, known drift injected after the stream cut ----

DRIFT_SQL = """
li AS (
  SELECT l.*, epoch(l_shipdate) AS dt, p_brand,
         CAST(l_returnflag = 'R' AND l_quantity > 45 AS INTEGER) AS label
  FROM lineitem l LEFT JOIN part ON l_partkey = p_partkey
),
bounds AS (
  SELECT lo, hi, lo + (hi - lo) / 6 * 3 AS m3, lo + (hi - lo) / 6 * 4 AS m4
  FROM (SELECT min(epoch(l_shipdate)) AS lo, max(epoch(l_shipdate)) AS hi FROM lineitem)
),
cut AS (SELECT li.*, m3, m4, dt >= m4 AS late FROM li, bounds),
drift AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, dt, label, l_shipdate,
    CASE WHEN dt < m3 THEN 'train' WHEN dt < m4 THEN 'val' ELSE 'stream' END AS split,
    CASE WHEN late THEN l_quantity * 1.5 ELSE l_quantity END AS f_value,
    CASE WHEN late AND l_partkey % 10 = 0 THEN NULL
         WHEN NOT late AND l_partkey % 4 <> 0 THEN NULL ELSE l_tax END AS f_cover,
    CASE WHEN late AND l_partkey % 5 = 0 THEN p_brand || ' v2' ELSE p_brand END AS f_cat,
    CASE WHEN late AND l_suppkey % 10 = 0 THEN NULL
         WHEN NOT late AND l_suppkey % 3 <> 0 THEN NULL ELSE l_linestatus END AS f_catmiss,
    l_discount AS f_stable,
    CASE WHEN late THEN l_quantity > 48 ELSE l_quantity > 2 END AS f_bool,
    CAST(1.0 AS DOUBLE) AS f_const
  FROM cut
)"""


def line_bounds(spark: SparkSession, sf_dir: str) -> SplitBoundaries:
    return split_boundaries(table(spark, sf_dir, "lineitem"), "l_shipdate")


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, p_brand); many of them are merged with the lines, so that the driver never holds them.

    Keys that are found to be unique are grouped: a pass that reads no brand then needs no join.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    if part.count() <= BROADCAST_PARTS:
        return part
    if part.groupBy("p_partkey").count().where("count > 1").isEmpty():
        part = part.groupBy("p_partkey").agg(F.first("p_brand").alias("p_brand"))
    return part.hint("merge")


def drift_view(spark: SparkSession, sf_dir: str, split: str | None = None,
               bounds: SplitBoundaries | None = None) -> DataFrame:
    """One split (or all) of the drift view; the split bound reaches the scan."""
    bounds = bounds or line_bounds(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem")
    route = split_name(lines, "l_shipdate", bounds)
    if split is not None:
        lines = take_split(lines, "l_shipdate", bounds, split)
    part = _brands(spark, sf_dir)
    late = route == "stream"
    c = F.col
    return lines.join(part, c("l_partkey") == c("p_partkey"), "left").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        epoch_seconds(c("l_shipdate")).alias("dt"),
        F.when((c("l_returnflag") == "R") & (c("l_quantity") > 45), 1).otherwise(0).alias("label"),
        "l_shipdate",
        route.alias("split"),
        F.when(late, c("l_quantity") * 1.5).otherwise(c("l_quantity")).alias("f_value"),
        F.when(late & (c("l_partkey") % 10 == 0), None)
        .when(~late & (c("l_partkey") % 4 != 0), None).otherwise(c("l_tax")).alias("f_cover"),
        F.when(late & (c("l_partkey") % 5 == 0), F.concat("p_brand", F.lit(" v2")))
        .otherwise(c("p_brand")).alias("f_cat"),
        F.when(late & (c("l_suppkey") % 10 == 0), None)
        .when(~late & (c("l_suppkey") % 3 != 0), None).otherwise(c("l_linestatus")).alias("f_catmiss"),
        c("l_discount").alias("f_stable"),
        F.when(late, c("l_quantity") > 48).otherwise(c("l_quantity") > 2).alias("f_bool"),
        F.lit(1.0).alias("f_const"),
    )


def drift_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bounds = line_bounds(spark, sf_dir)
    return (drift_view(spark, sf_dir, "train", bounds), drift_view(spark, sf_dir, "stream", bounds))


# The whole drift reading of the view in SQL, per feature.
PSI_SQL = DRIFT_SQL + """,
long_num AS (
  SELECT split, feature, value FROM (
    SELECT split, 'f_value' AS feature, f_value AS value FROM drift UNION ALL
    SELECT split, 'f_cover', f_cover FROM drift UNION ALL
    SELECT split, 'f_stable', f_stable FROM drift UNION ALL
    SELECT split, 'f_const', f_const FROM drift)
  WHERE split IN ('train', 'stream')
),
q AS (
  SELECT feature, list_sort(list_distinct(
    quantile_cont(value, [0,.1,.2,.3,.4,.5,.6,.7,.8,.9,1]))) AS e
  FROM long_num WHERE split = 'train' AND value IS NOT NULL GROUP BY feature
),
edges AS (SELECT feature, e, e[2:len(e)-1] AS inner_e FROM q WHERE len(e) >= 3),
bin_num AS (
  SELECT split, l.feature, CASE WHEN value IS NULL THEN NULL
    ELSE CAST(len(list_filter(inner_e, lambda x: value > x)) AS VARCHAR) END AS bucket
  FROM long_num l JOIN edges USING (feature)
),
bin_cat AS (
  SELECT split, 'f_cat' AS feature, f_cat AS bucket FROM drift WHERE split <> 'val' UNION ALL
  SELECT split, 'f_catmiss', f_catmiss FROM drift WHERE split <> 'val' UNION ALL
  SELECT split, 'f_bool', CAST(f_bool AS VARCHAR) FROM drift WHERE split <> 'val'
),
binned AS (SELECT * FROM bin_num UNION ALL SELECT * FROM bin_cat),
cnt AS (
  SELECT feature, bucket, count(*) FILTER (split = 'train') AS r, count(*) FILTER (split = 'stream') AS c
  FROM binned GROUP BY feature, bucket
),
tot AS (
  SELECT feature, sum(r) AS nr, sum(c) AS nc,
         sum(r) FILTER (bucket IS NOT NULL) AS pr, sum(c) FILTER (bucket IS NOT NULL) AS pc
  FROM cnt GROUP BY feature
),
sh AS (
  SELECT feature, bucket, r, c,
    greatest(r / nr, 1e-6) AS ra, greatest(c / nc, 1e-6) AS ca,
    greatest(r / pr, 1e-6) AS rp, greatest(c / pc, 1e-6) AS cp, nr, nc, pr, pc
  FROM cnt JOIN tot USING (feature)
),
measured AS (
  SELECT feature, sum((ca - ra) * ln(ca / ra)) AS psi_all,
    sum((cp - rp) * ln(cp / rp)) FILTER (bucket IS NOT NULL) AS psi_non_null,
    1 - max(pr) / max(nr) AS na_ref, 1 - max(pc) / max(nc) AS na_cur
  FROM sh GROUP BY feature
),
feats AS (
  SELECT * FROM (VALUES ('f_value', 'numeric'), ('f_cover', 'numeric'), ('f_cat', 'categorical'),
    ('f_catmiss', 'categorical'), ('f_stable', 'numeric'), ('f_bool', 'categorical'),
    ('f_const', 'numeric')) t(feature, kind)
),
drift_rows AS (
  SELECT f.feature, kind, psi_all, psi_non_null, coalesce(na_ref, 0) AS na_rate_reference,
    coalesce(na_cur, 0) AS na_rate_current,
    CASE WHEN psi_all IS NULL THEN 'unmeasurable' WHEN psi_all < 0.10 THEN 'stable'
         WHEN psi_all <= 0.20 THEN 'moderate' ELSE 'major' END AS band
  FROM feats f LEFT JOIN measured m USING (feature)
),
typed AS (
  SELECT *, CASE WHEN psi_all IS NULL OR psi_all < 0.20 THEN 'none'
                 WHEN coalesce(psi_non_null >= 0.05, FALSE) THEN 'value' ELSE 'missingness' END AS drift_type
  FROM drift_rows
)"""

# --- paired view: orders as transactions scored by two models ---------------------

PAIRED_SQL = """
hashed AS (
  SELECT o_orderkey AS id, epoch(o_orderdate) AS dt, o_orderdate,
    ((o_orderkey % 1000003) * 7919 + (o_custkey % 1000003) * 104729) % 1000 AS h1,
    ((o_orderkey % 1000003) * 15485863 + (o_custkey % 1000003) * 32452843) % 1000 AS h2,
    ((o_orderkey % 1000003) * 611953 + (o_custkey % 1000003) * 2750159) % 1000 AS h3,
    year(o_orderdate) AS yr, o_orderstatus
  FROM orders
),
paired AS (
  SELECT id, dt, yr, o_orderstatus, CAST(h3 % 30 = 0 AS INTEGER) AS y, h1, h2, h3,
    ((600 * h1 + CASE WHEN h3 % 30 = 0 THEN 330000 ELSE 0 END) // 1000) / 1000.0 AS p_champion,
    ((450 * h1 + 150 * h2 + CASE WHEN h3 % 30 = 0 THEN 380000 ELSE 0 END) // 1000) / 1000.0 AS p_challenger
  FROM hashed
)"""


def paired_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    key, cust = c("o_orderkey") % 1000003, c("o_custkey") % 1000003
    hashed = table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("id"),
        epoch_seconds(c("o_orderdate")).alias("dt"),
        F.year("o_orderdate").alias("yr"),
        "o_orderstatus",
        ((key * 7919 + cust * 104729) % 1000).alias("h1"),
        ((key * 15485863 + cust * 32452843) % 1000).alias("h2"),
        ((key * 611953 + cust * 2750159) % 1000).alias("h3"),
    )
    positive = c("h3") % 30 == 0
    return hashed.select(
        "id", "dt", "yr", "o_orderstatus",
        F.when(positive, 1).otherwise(0).alias("y"),
        "h1", "h2", "h3",
        (F.floor((600 * c("h1") + F.when(positive, 330000).otherwise(0)) / 1000) / 1000.0).alias("p_champion"),
        (F.floor((450 * c("h1") + 150 * c("h2") + F.when(positive, 380000).otherwise(0)) / 1000) / 1000.0)
        .alias("p_challenger"),
    )


# --- audit view: events as scored rows ----------------------------------------------

AUDIT_SQL = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
    ((event_id % 1000003) * 7919 + (user_id % 1000003) * 104729) % 1000 AS h1,
    ((event_id % 1000003) * 15485863 + (user_id % 1000003) * 32452843) % 1000 AS h2
  FROM events
),
audit AS (
  SELECT event_id AS id, ts AS scored_at, epoch(ts) AS dt, CAST(event_id AS VARCHAR) AS transaction_id,
    h1 / 1000.0 AS fraud_probability,
    CASE WHEN h1 / 1000.0 >= 0.75 + 0.05 * (user_id % 3) THEN 'BLOCK' ELSE 'ALLOW' END AS decision,
    0.75 + 0.05 * (user_id % 3) AS threshold,
    'v' || CAST(1 + event_id // 5000 AS VARCHAR) AS model_version,
    CASE WHEN event_type = 'error' AND user_id % 10 = 0 THEN ['event_type', 'user']
         WHEN event_type = 'error' THEN ['event_type'] ELSE [] END AS unseen_categories,
    CASE WHEN h2 % 7 = 0 THEN NULL ELSE 'v' || CAST(2 + event_id // 5000 AS VARCHAR) END AS challenger_version,
    CASE WHEN h2 % 7 = 0 THEN NULL ELSE h2 / 1000.0 END AS challenger_probability,
    CASE WHEN h2 % 7 = 0 THEN NULL ELSE 0.8 END AS challenger_threshold,
    CASE WHEN h2 % 7 = 0 THEN NULL WHEN h2 / 1000.0 >= 0.8 THEN 'BLOCK' ELSE 'ALLOW' END AS challenger_decision,
    CASE WHEN h1 % 11 = 0 THEN NULL ELSE CAST((h1 + h2) % 30 = 0 AS INTEGER) END AS true_label,
    value AS latency_ms
  FROM ev
)"""


def audit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    key, user = c("event_id") % 1000003, c("user_id") % 1000003
    ev = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        ((key * 7919 + user * 104729) % 1000).alias("h1"),
        ((key * 15485863 + user * 32452843) % 1000).alias("h2"),
    )
    threshold = F.lit(0.75) + F.lit(0.05) * (c("user_id") % 3)
    shadowed = c("h2") % 7 != 0
    generation = F.floor(c("event_id") / 5000)
    empty = F.array().cast("array<string>")
    return ev.select(
        c("event_id").alias("id"),
        c("ts").cast("timestamp").alias("scored_at"),
        epoch_seconds(c("ts")).alias("dt"),
        c("event_id").cast("string").alias("transaction_id"),
        (c("h1") / 1000.0).alias("fraud_probability"),
        F.when(c("h1") / 1000.0 >= threshold, "BLOCK").otherwise("ALLOW").alias("decision"),
        threshold.alias("threshold"),
        F.concat(F.lit("v"), (generation + 1).cast("string")).alias("model_version"),
        F.when((c("event_type") == "error") & (c("user_id") % 10 == 0),
               F.array(F.lit("event_type"), F.lit("user")))
        .when(c("event_type") == "error", F.array(F.lit("event_type"))).otherwise(empty)
        .alias("unseen_categories"),
        F.when(shadowed, F.concat(F.lit("v"), (generation + 2).cast("string"))).alias("challenger_version"),
        F.when(shadowed, c("h2") / 1000.0).alias("challenger_probability"),
        F.when(shadowed, F.lit(0.8)).alias("challenger_threshold"),
        F.when(shadowed, F.when(c("h2") / 1000.0 >= 0.8, "BLOCK").otherwise("ALLOW"))
        .alias("challenger_decision"),
        F.when(c("h1") % 11 != 0, F.when((c("h1") + c("h2")) % 30 == 0, 1).otherwise(0)).alias("true_label"),
        c("value").alias("latency_ms"),
    )


# --- unseen observations: events per type, value and day ---------------------------

UNSEEN_SQL = """
unseen AS (
  SELECT event_type AS feature, 'u' || CAST(user_id % 23 AS VARCHAR) AS value,
    date_trunc('day', ts) AS observed_at, count(*) AS occurrences
  FROM events GROUP BY ALL
)"""


def unseen_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("feature"),
            F.concat(F.lit("u"), (F.col("user_id") % 23).cast("string")).alias("value"),
            F.date_trunc("day", F.col("ts").cast("timestamp")).alias("observed_at"),
        )
        .agg(F.count("*").alias("occurrences"))
    )


# --- alerts: orders per calendar month ----------------------------------------------

ALERTS_SQL = """
monthly AS (
  SELECT year(o_orderdate) * 12 + month(o_orderdate) - 23940 AS id, count(*) AS window_rows,
    min(epoch(o_orderdate)) AS window_start_dt, max(epoch(o_orderdate)) AS window_end_dt,
    sum(o_custkey) AS s
  FROM orders GROUP BY 1
),
alerts AS (
  SELECT CAST(id AS BIGINT) AS id, CAST(window_rows AS BIGINT) AS window_rows, window_start_dt, window_end_dt,
    window_end_dt + 86400.0 AS created_s,
    (s % 500) / 1000.0 AS value_drift_psi, (s % 370) / 1000.0 AS missingness_psi,
    greatest(s % 500, s % 370) / 1000.0 AS overall_psi,
    'f' || CAST(s % 7 AS VARCHAR) AS overall_psi_feature,
    (s % 500) >= 200 AS retrain_triggered, (s % 370) >= 200 AS investigate_pipeline,
    CASE WHEN (s % 500) >= 200 AND (s % 370) >= 200 THEN 'RETRAIN + INVESTIGATE PIPELINE'
         WHEN (s % 500) >= 200 THEN 'RETRAIN'
         WHEN (s % 370) >= 200 THEN 'INVESTIGATE PIPELINE (no retrain)' ELSE 'STABLE' END AS verdict,
    ['f' || CAST(s % 7 AS VARCHAR), 'f' || CAST(s % 5 AS VARCHAR)] AS value_drift_feature_list
  FROM monthly
),
resolutions AS (
  SELECT id AS alert_id, created_s + 3600.0 AS resolved_s, 'run-' || CAST(id AS VARCHAR) AS run_id,
    'v' || CAST(id AS VARCHAR) AS model_version
  FROM alerts WHERE retrain_triggered AND id % 3 <> 0
)"""


def alerts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate") - 23940).cast("bigint").alias("id"))
        .agg(
            F.count("*").alias("window_rows"),
            epoch_seconds(F.min("o_orderdate")).alias("window_start_dt"),
            epoch_seconds(F.max("o_orderdate")).alias("window_end_dt"),
            F.sum("o_custkey").alias("s"),
        )
    )
    value, missing = c("s") % 500, c("s") % 370
    from tidemark.functions.scalar import drift_verdict

    def name(modulus: int):
        return F.concat(F.lit("f"), (c("s") % modulus).cast("string"))

    return monthly.select(
        "id", "window_rows", "window_start_dt", "window_end_dt",
        (c("window_end_dt") + 86400.0).alias("created_s"),
        (value / 1000.0).alias("value_drift_psi"),
        (missing / 1000.0).alias("missingness_psi"),
        (F.greatest(value, missing) / 1000.0).alias("overall_psi"),
        name(7).alias("overall_psi_feature"),
        (value >= 200).alias("retrain_triggered"),
        (missing >= 200).alias("investigate_pipeline"),
        drift_verdict(value >= 200, missing >= 200).alias("verdict"),
        F.array(name(7), name(5)).alias("value_drift_feature_list"),
    )


def resolutions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return alerts_view(spark, sf_dir).where(c("retrain_triggered") & (c("id") % 3 != 0)).select(
        c("id").alias("alert_id"),
        (c("created_s") + 3600.0).alias("resolved_s"),
        F.concat(F.lit("run-"), c("id").cast("string")).alias("run_id"),
        F.concat(F.lit("v"), c("id").cast("string")).alias("model_version"),
    )


# --- comparisons: customers grouped into verdict records ----------------------------

VERDICTS = [
    "PROMOTE",
    "NO PROMOTION -- insufficient data",
    "no promotion, difference within noise",
    "NO VERDICT -- evaluation rows overlap the challenger's training window",
    "PROMOTE (rolled back: window overlap found later)",
]

COMPARISONS_SQL = """
grouped AS (
  SELECT c_custkey // 10 AS id, count(*) AS n, sum(c_nationkey) AS s, max(c_nationkey) AS m
  FROM customer GROUP BY 1
),
comparisons AS (
  SELECT CAST(id AS BIGINT) AS id, 946684800.0 + id * 86400.0 AS promoted_s,
    CAST(id + 1 AS VARCHAR) AS from_version, CAST(id + 2 AS VARCHAR) AS to_version,
    CAST(1000 * n AS BIGINT) AS comparison_rows, CAST(30 * n AS BIGINT) AS comparison_positives,
    0.4 + (s % 97) / 1000.0 AS champion_pr_auc, 0.4 + (s % 89) / 1000.0 AS challenger_pr_auc,
    (s % 89) / 1000.0 - (s % 97) / 1000.0 AS pr_auc_delta,
    CAST(m AS DOUBLE) / 8.0 AS margin_in_ses, CAST(1 + id % 80 AS BIGINT) AS trigger_alert_id,
    CASE s % 5 WHEN 0 THEN 'PROMOTE' WHEN 1 THEN 'NO PROMOTION -- insufficient data'
      WHEN 2 THEN 'no promotion, difference within noise'
      WHEN 3 THEN 'NO VERDICT -- evaluation rows overlap the challenger''s training window'
      ELSE 'PROMOTE (rolled back: window overlap found later)' END AS verdict
  FROM grouped
)"""


def comparisons_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    grouped = (
        table(spark, sf_dir, "customer")
        .groupBy(F.floor(c("c_custkey") / 10).alias("id"))
        .agg(F.count("*").alias("n"), F.sum("c_nationkey").alias("s"), F.max("c_nationkey").alias("m"))
    )
    verdict = F.lit(VERDICTS[4])
    for i in (3, 2, 1, 0):
        verdict = F.when(c("s") % 5 == i, VERDICTS[i]).otherwise(verdict)
    return grouped.select(
        "id",
        (F.lit(946684800.0) + c("id") * 86400.0).alias("promoted_s"),
        (c("id") + 1).cast("string").alias("from_version"),
        (c("id") + 2).cast("string").alias("to_version"),
        (c("n") * 1000).alias("comparison_rows"),
        (c("n") * 30).alias("comparison_positives"),
        (F.lit(0.4) + (c("s") % 97) / 1000.0).alias("champion_pr_auc"),
        (F.lit(0.4) + (c("s") % 89) / 1000.0).alias("challenger_pr_auc"),
        ((c("s") % 89) / 1000.0 - (c("s") % 97) / 1000.0).alias("pr_auc_delta"),
        (c("m").cast("double") / 8.0).alias("margin_in_ses"),
        (c("id") % 80 + 1).alias("trigger_alert_id"),
        verdict.alias("verdict"),
    )


# --- registry: suppliers as model versions and their runs ---------------------------

REGISTRY_SQL = """
versions AS (
  SELECT CAST(s_suppkey AS BIGINT) AS version, 'run-' || CAST(s_suppkey AS VARCHAR) AS run_id,
    CASE s_nationkey % 4 WHEN 0 THEN 'Production' WHEN 1 THEN 'Staging' WHEN 2 THEN 'Archived' ELSE 'None' END AS stage,
    CASE s_nationkey % 6 WHEN 0 THEN ['staging'] WHEN 1 THEN ['challenger'] WHEN 2 THEN ['champion', 'stable']
      ELSE [] END AS aliases,
    CASE WHEN s_nationkey % 2 = 0 THEN 'drift_retrain' END AS origin,
    CASE WHEN s_nationkey % 3 = 0 THEN 'superseded' END AS archived_reason,
    CASE WHEN s_nationkey % 5 = 0 THEN 'window overlap' END AS promotion_rolled_back,
    CASE WHEN s_nationkey % 7 < 4 THEN 'NO PROMOTION -- challenger is not ahead' END AS shadow_verdict,
    (s_nationkey * 13 % 100) / 1000.0 AS shadow_delta, CAST(s_nationkey * 1000 AS BIGINT) AS shadow_rows
  FROM supplier
),
runs AS (
  SELECT 'run-' || CAST(s_suppkey AS VARCHAR) AS run_id, k AS key,
    CASE k WHEN 'retrain.window_start_dt' THEN 788918400.0 + s_nationkey * 8640000.0
           WHEN 'retrain.window_end_dt' THEN 788918400.0 + s_nationkey * 8640000.0 + 31536000.0
           WHEN 'trigger.alert_id' THEN CAST(1 + s_suppkey % 80 AS DOUBLE)
           WHEN 'val.pr_auc' THEN 0.4 + (s_suppkey * 7 % 100) / 1000.0
           ELSE 0.5 + (s_suppkey * 11 % 400) / 1000.0 END AS value
  FROM supplier, (VALUES ('retrain.window_start_dt'), ('retrain.window_end_dt'), ('trigger.alert_id'),
    ('val.pr_auc'), ('val.at_best_f1_threshold.threshold')) kv(k)
  WHERE NOT (s_nationkey % 9 = 4 AND k <> 'val.pr_auc')
)"""

RUN_KEYS = ["retrain.window_start_dt", "retrain.window_end_dt", "trigger.alert_id", "val.pr_auc",
            "val.at_best_f1_threshold.threshold"]


def versions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = F.col, F.col("s_nationkey")
    tags = F.map_filter(
        F.create_map(
            F.lit("origin"), F.when(n % 2 == 0, "drift_retrain"),
            F.lit("archived_reason"), F.when(n % 3 == 0, "superseded"),
            F.lit("promotion_rolled_back"), F.when(n % 5 == 0, "window overlap"),
            F.lit("shadow_verdict"), F.when(n % 7 < 4, "NO PROMOTION -- challenger is not ahead"),
            F.lit("shadow_pr_auc_delta"), ((n * 13 % 100) / 1000.0).cast("string"),
            F.lit("shadow_rows"), (n * 1000).cast("string"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return table(spark, sf_dir, "supplier").select(
        c("s_suppkey").alias("version"),
        F.concat(F.lit("run-"), c("s_suppkey").cast("string")).alias("run_id"),
        F.when(n % 4 == 0, "Production").when(n % 4 == 1, "Staging")
        .when(n % 4 == 2, "Archived").otherwise("None").alias("stage"),
        F.when(n % 6 == 0, F.array(F.lit("staging"))).when(n % 6 == 1, F.array(F.lit("challenger")))
        .when(n % 6 == 2, F.array(F.lit("champion"), F.lit("stable")))
        .otherwise(F.array().cast("array<string>")).alias("aliases"),
        tags.alias("tags"),
    )


def runs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, key, value): several rows per run, some runs without a recorded window."""
    c, n, s = F.col, F.col("s_nationkey"), F.col("s_suppkey")
    start = F.lit(788918400.0) + n * 8640000.0
    values = [start, start + 31536000.0, (s % 80 + 1).cast("double"),
              F.lit(0.4) + (s * 7 % 100) / 1000.0, F.lit(0.5) + (s * 11 % 400) / 1000.0]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in zip(RUN_KEYS, values)])
    return (
        table(spark, sf_dir, "supplier")
        .select(F.concat(F.lit("run-"), s.cast("string")).alias("run_id"), "s_nationkey",
                F.explode(entries).alias("e"))
        .where(~((n % 9 == 4) & (c("e.key") != "val.pr_auc")))
        .select("run_id", c("e.key").alias("key"), c("e.value").alias("value"))
    )
