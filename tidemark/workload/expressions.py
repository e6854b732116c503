"""Scalar functions, each applied to whole given tables."""

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.workload.base import query, r6, table
from tidemark.workload.fixtures import (
    ALERTS_SQL,
    AUDIT_SQL,
    PAIRED_SQL,
    alerts_view,
    audit_view,
    paired_view,
)

PAIRED = "WITH " + PAIRED_SQL
AUDIT = "WITH " + AUDIT_SQL


@query("fn_1_sigmoid", PAIRED + "SELECT id, round(1 / (1 + exp(-(h1 - 500) / 100.0)), 6) + 0.0 AS p FROM paired")
def sigmoid(spark, sf_dir):
    return paired_view(spark, sf_dir).select("id", r6(S.sigmoid((F.col("h1") - 500) / 100.0)).alias("p"))


@query("fn_2_psi_term", PAIRED + """
SELECT id, round((greatest(h1 / 1000.0::DOUBLE, 1e-6) - greatest(h2 / 1000.0::DOUBLE, 1e-6))
  * ln(greatest(h1 / 1000.0::DOUBLE, 1e-6) / greatest(h2 / 1000.0::DOUBLE, 1e-6)), 6) + 0.0 AS term FROM paired""")
def psi_term(spark, sf_dir):
    return paired_view(spark, sf_dir).select("id", r6(S.psi_term(F.col("h2") / 1000.0, F.col("h1") / 1000.0)).alias("term"))


@query("fn_3_mean_probability", PAIRED + "SELECT id, round((p_champion + p_challenger) / 2, 6) + 0.0 AS p FROM paired")
def mean_probability(spark, sf_dir):
    return paired_view(spark, sf_dir).select(
        "id", r6(S.mean_probability(F.col("p_champion"), F.col("p_challenger"))).alias("p"))


@query("fn_4_recorded_rounding", """
SELECT event_id, round(CAST(event_id % 997 AS DOUBLE) / 997, 6) + 0.0 AS probability, round(CAST(event_id % 1013 AS DOUBLE) / 7, 3) + 0.0 AS latency FROM events""")
def recorded_rounding(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", r6((F.col("event_id") % 997).cast("double") / 997).alias("probability"),
        (F.round((F.col("event_id") % 1013).cast("double") / 7, 3) + 0.0).alias("latency"))


@query("fn_5_right_closed_bins", """
SELECT bin, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 3 THEN -1
  ELSE (l_quantity > 10)::BIGINT + (l_quantity > 20)::BIGINT + (l_quantity > 30)::BIGINT END AS bin FROM lineitem) GROUP BY 1""")
def right_closed_bins(spark, sf_dir):
    value = F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    edges = [F.lit(10.0), F.lit(20.0), F.lit(30.0)]
    return table(spark, sf_dir, "lineitem").groupBy(
        S.right_closed_bin(value, edges).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query("fn_6_bin_labels", "SELECT p_partkey, format('({:.4g}, {:.4g}]', p_retailprice, p_retailprice * 1000) AS label FROM part")
def bin_labels(spark, sf_dir):
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", S.bin_label(price, price * 1000).alias("label"))


@query("fn_7_rendered_numbers", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::VARCHAR AS d, x, CASE WHEN x = floor(x) THEN format('{:,}', x::BIGINT)
  WHEN abs(x) >= 1e-3 THEN regexp_replace(format('{:,.4f}', x), '\\.?0+$', '') ELSE format('{:.3e}', x) END AS text
FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN l_extendedprice WHEN l_linenumber = 2 THEN l_quantity * 1000
  WHEN l_linenumber = 3 THEN l_discount / 1000 ELSE l_tax END AS x FROM lineitem)""")
def rendered_numbers(spark, sf_dir):
    n = F.col("l_linenumber")
    x = F.when(n == 1, F.col("l_extendedprice")).when(n == 2, F.col("l_quantity") * 1000).when(
        n == 3, F.col("l_discount") / 1000).otherwise(F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("d"), x.alias("x"), S.render_number(x).alias("text"))


@query("fn_8_direction", PAIRED + "SELECT id, CASE WHEN h1 - h2 > 0 THEN 'toward fraud' ELSE 'toward legitimate' END AS push FROM paired")
def direction(spark, sf_dir):
    return paired_view(spark, sf_dir).select("id", S.direction(F.col("h1") - F.col("h2")).alias("push"))


@query("fn_9_iso_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events")
def iso_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.iso_utc(F.col("ts")).alias("iso"))


@query("fn_10_parsed_time", """
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN epoch(date_trunc('second', ts)) END AS seconds FROM events""")
def parsed_time(spark, sf_dir):
    """ISO text back to a moment; every tenth text is no time at all."""
    text = F.when(F.col("event_id") % 10 == 0, "not a time").otherwise(S.iso_utc(F.col("ts")))
    return table(spark, sf_dir, "events").select("event_id", S.epoch_seconds(S.parse_iso(text)).alias("seconds"))


@query("fn_11_json_list", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 END::BIGINT AS entries, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || ',x' END AS joined FROM events""")
def json_list(spark, sf_dir):
    text = F.when(F.col("event_id") % 4 == 0, "{broken").otherwise(F.to_json(F.array("event_type", F.lit("x"))))
    parsed = S.parse_json_list(text, "string")
    return table(spark, sf_dir, "events").select(
        "event_id", F.size(parsed).cast("bigint").alias("entries"), F.array_join(parsed, ",").alias("joined"))


@query("fn_12_json_text", AUDIT + """
SELECT id, '[' || array_to_string(list_transform(unseen_categories, lambda u: '"' || u || '"'), ',') || ']' AS text FROM audit""")
def json_text(spark, sf_dir):
    return audit_view(spark, sf_dir).select("id", S.to_json_text(F.col("unseen_categories")).alias("text"))


@query("fn_13_picked_features", "WITH " + ALERTS_SQL + """
SELECT id, CASE WHEN value_drift_psi >= 0.1 THEN array_to_string(value_drift_feature_list, ',') ELSE '(none recorded)' END AS features FROM alerts""")
def picked_features(spark, sf_dir):
    kind = F.when(F.col("value_drift_psi") >= 0.1, "value").otherwise("missingness")
    entries = F.transform("value_drift_feature_list", lambda f: F.struct(f.alias("feature"), kind.alias("type")))
    return alerts_view(spark, sf_dir).select("id", S.pick_features(entries, "value").alias("features"))
