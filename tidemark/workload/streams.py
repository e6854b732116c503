"""Streaming queries: replay, scoring, isolation, idempotence, buckets."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators.encoding import FeatureEncoder
from tidemark.session import scratch_path
from tidemark.sources.tables import read_or_empty
from tidemark.streaming import feed as FD
from tidemark.streaming import scoring as SC
from tidemark.workload.base import query, r6, table

MESSAGE = "event_id bigint, dt double, user_id bigint, event_type string, value double, k double, label int"

# The vocabulary knows every type but 'error'; gaps: no value on every ninth event.
STREAM_SQL = """
WITH e AS (
  SELECT event_id, epoch(ts) AS dt, user_id, event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(event_id % 30 = 0 AS INTEGER) AS label FROM events),
sc AS (
  SELECT *, round(1 / (1 + exp(-(k - 50) / 20)), 6) + 0.0 AS p, round((user_id % 100) / 100.0, 6) + 0.0 AS q, 1 / (1 + exp(-(k - 50) / 20)) AS raw FROM e)"""


def _rows(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "events").select(
        "event_id", S.epoch_seconds(c("ts")).alias("dt"), "user_id", "event_type",
        F.when(c("event_id") % 9 != 0, c("value")).alias("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.when(c("event_id") % 30 == 0, 1).otherwise(0).alias("label"),
    )


def _encoder(spark, sf_dir):
    known = _rows(spark, sf_dir).where(F.col("event_type") != "error").select("event_type", "value", "k", "user_id")
    return FeatureEncoder().fit(known)


CHAMPION = SC.Scorer("v1", 0.6, lambda: S.sigmoid((F.col("k").cast("double") - 50) / 20))
CHALLENGER = SC.Scorer("v2", 0.5, SC.guarded(lambda rows: (rows["user_id"] % 100) / 100.0, ["user_id"]))


def _fails_sometimes(rows: pd.DataFrame):
    if (rows["event_id"] % 97 == 0).any():
        raise RuntimeError("one row in 97 cannot be scored")
    return (rows["user_id"] % 100) / 100.0


FRAGILE = SC.Scorer("v2", 0.5, SC.guarded(_fails_sometimes, ["user_id", "event_id"]))


def _fails(rows: pd.DataFrame):
    raise RuntimeError("a challenger that never works")


BROKEN = SC.Scorer("v3", 0.5, SC.guarded(_fails, ["user_id"]))


def _sink(spark, sf_dir, challenger=CHALLENGER):
    return SC.AuditSink(scratch_path(spark, "audit"), _encoder(spark, sf_dir), CHAMPION, challenger,
                        "event_id", "dt", "label")


def _feed(spark, sf_dir, damage=False, slices=3):
    path = scratch_path(spark, "feed")
    FD.write_feed(_rows(spark, sf_dir), "dt", ["event_id"], "event_id", path, slices)
    if damage:
        bad = table(spark, sf_dir, "events").where("event_id % 50 = 0").select(F.concat(F.lit("{broken "), F.col("event_id")).alias("value"))
        bad.write.mode("append").text(path)
    return path


def _scored(spark, sf_dir, challenger=CHALLENGER, damage=False):
    sink = _sink(spark, sf_dir, challenger)
    messages = FD.read_feed(spark, _feed(spark, sf_dir, damage), files_per_batch=8)
    SC.run_scoring(FD.parse_messages(messages, MESSAGE), sink).awaitTermination()
    return sink


AUDIT_ROW_SQL = """
SELECT CAST(event_id AS VARCHAR) AS transaction_id, dt AS transaction_dt, p AS fraud_probability,
  CASE WHEN raw >= 0.6 THEN 'BLOCK' ELSE 'ALLOW' END AS decision, 0.6::DOUBLE AS threshold, 'v1' AS model_version,
  CASE WHEN event_type = 'error' THEN 'event_type' ELSE '' END AS unseen, label::BIGINT AS true_label,"""


def _audit_columns(audit):
    return audit.select(
        "transaction_id", "transaction_dt", r6("fraud_probability").alias("fraud_probability"), "decision", "threshold",
        "model_version", F.array_join("unseen_categories", ",").alias("unseen"), F.col("true_label").cast("bigint").alias("true_label"),
        F.coalesce("challenger_version", F.lit("-")).alias("challenger_version"),
        r6("challenger_probability").alias("challenger_probability"),
        F.coalesce("challenger_decision", F.lit("-")).alias("challenger_decision"),
    )


WITH_SHADOW = " 'v2' AS challenger_version, q AS challenger_probability, CASE WHEN q >= 0.5 THEN 'BLOCK' ELSE 'ALLOW' END AS challenger_decision FROM sc"
WITHOUT_SHADOW = " '-' AS challenger_version, CAST(NULL AS DOUBLE) AS challenger_probability, '-' AS challenger_decision FROM sc"


@query("src_5_topic_source", """
SELECT status, count(*) AS n FROM (SELECT 'parsed' AS status FROM events UNION ALL SELECT 'corrupt' FROM events WHERE event_id % 50 = 0) GROUP BY 1""")
def topic_source(spark, sf_dir):
    """A feed with damaged messages, read as a stream and counted by status."""
    out = scratch_path(spark, "parsed")
    parsed = FD.parse_messages(FD.read_feed(spark, _feed(spark, sf_dir, damage=True), 8), MESSAGE)
    status = F.when(F.col(FD.CORRUPT).isNull(), "parsed").otherwise("corrupt")
    parsed.select(status.alias("status"), "event_id").writeStream.format("parquet").option(
        "checkpointLocation", f"{out}-checkpoint").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("status string, event_id bigint").parquet(out).groupBy("status").agg(F.count("*").alias("n"))


@query("snk_2_topic_messages", """
SELECT CAST(doc_id AS VARCHAR) AS key, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"'
  || CASE WHEN quality IS NULL THEN '' ELSE ',"quality":' || quality || ',"toxic":' || toxic END || '}' AS value
FROM documents LEFT JOIN labels USING (doc_id)""")
def topic_messages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return FD.to_messages(docs, "doc_id")


@query("snk_3_audit_sink", STREAM_SQL + AUDIT_ROW_SQL + WITH_SHADOW)
def audit_sink(spark, sf_dir):
    return _audit_columns(SC.read_audit(spark, _scored(spark, sf_dir).root))


@query("str_1_ordered_replay", """
SELECT 'in order' AS status, count(*) AS messages, min(epoch(ts)) AS first_dt, max(epoch(ts)) AS last_dt FROM events""")
def ordered_replay(spark, sf_dir):
    """Every batch of four files starts where the one before it ended, and numbers follow event time."""
    out = scratch_path(spark, "replay")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    parsed = FD.parse_messages(FD.read_feed(spark, _feed(spark, sf_dir, slices=4), 4), MESSAGE + ", sequence bigint")
    parsed.select("event_id", "dt", "sequence").writeStream.foreachBatch(keep).option(
        "checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    from pyspark.sql import Window

    rows = spark.read.schema("event_id bigint, dt double, sequence bigint, batch_id bigint").parquet(out)
    inside = Window.partitionBy("batch_id").orderBy("sequence")
    key = F.struct("dt", "event_id")
    stepped = rows.select("batch_id", "dt", "sequence", (F.lag(key).over(inside) >= key).alias("back"))
    spans = stepped.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.min("dt").alias("a"), F.max("dt").alias("b"), F.count_if("back").alias("back"),
        F.min("sequence").alias("first"), F.max("sequence").alias("last"))
    # One row per micro-batch: bounded by the number of files of the feed.
    order = Window.orderBy("batch_id")
    expected = F.coalesce(F.lag("last").over(order) + 1, F.lit(0))
    checked = spans.withColumn("late", (F.col("first") != expected) | (F.col("last") - F.col("first") + 1 != F.col("n")) | (F.col("back") > 0))
    return checked.agg(
        F.when(F.count_if("late") == 0, "in order").otherwise("out of order").alias("status"),
        F.sum("n").alias("messages"), F.min("a").alias("first_dt"), F.max("b").alias("last_dt"))


@query("str_2_scoring_loop", STREAM_SQL + """
SELECT count(*) AS messages, count(*) AS scored, 0::BIGINT AS errors, count(*) FILTER (raw >= 0.6) AS blocked FROM sc""")
def scoring_loop(spark, sf_dir):
    sink = _scored(spark, sf_dir)
    stats = read_or_empty(spark, f"{sink.root}/stats", SC.STATS_SCHEMA).agg(
        *[F.sum(c).alias(c) for c in ("messages", "scored", "errors")])
    blocked = SC.read_audit(spark, sink.root).agg(F.count_if(F.col("decision") == "BLOCK")).scalar()
    return stats.withColumn("blocked", blocked)


@query("str_3_replayed_batch", STREAM_SQL + "SELECT count(*) AS rows, count(DISTINCT event_id) AS transactions, sum(label)::BIGINT AS positives FROM sc")
def replayed_batch(spark, sf_dir):
    """A batch delivered twice is stored once."""
    sink = _sink(spark, sf_dir)
    rows = _rows(spark, sf_dir).withColumn(FD.CORRUPT, F.lit(None).cast("string"))
    for _ in range(2):
        sink(rows, 0)
    return SC.read_audit(spark, sink.root).agg(
        F.count("*").alias("rows"), F.countDistinct("transaction_id").alias("transactions"),
        F.sum("true_label").alias("positives"))


@query("str_4_failing_challenger", STREAM_SQL + AUDIT_ROW_SQL + WITHOUT_SHADOW)
def failing_challenger(spark, sf_dir):
    """A challenger that raises costs its own columns and nothing else."""
    return _audit_columns(SC.read_audit(spark, _scored(spark, sf_dir, BROKEN).root))


@query("str_4_failing_rows", STREAM_SQL + AUDIT_ROW_SQL + """
 CASE WHEN event_id % 97 = 0 THEN '-' ELSE 'v2' END AS challenger_version, CASE WHEN event_id % 97 <> 0 THEN q END AS challenger_probability,
 CASE WHEN event_id % 97 = 0 THEN '-' WHEN q >= 0.5 THEN 'BLOCK' ELSE 'ALLOW' END AS challenger_decision FROM sc""")
def failing_rows(spark, sf_dir):
    """A challenger that raises on one row in 97 loses the scores of these rows only."""
    rows = _rows(spark, sf_dir)
    known = FeatureEncoder().fit(rows.where(F.col("event_type") != "error").select("event_type", "value", "k", "user_id", "event_id"))
    sink = SC.AuditSink(scratch_path(spark, "audit"), known, CHAMPION, FRAGILE, "event_id", "dt", "label")
    messages = FD.read_feed(spark, _feed(spark, sf_dir), files_per_batch=8)
    SC.run_scoring(FD.parse_messages(messages, MESSAGE), sink).awaitTermination()
    return _audit_columns(SC.read_audit(spark, sink.root))


@query("str_5_label_isolation", STREAM_SQL + "SELECT count(*) AS rows, 0::BIGINT AS changed_scores, count(*) AS changed_labels FROM sc")
def label_isolation(spark, sf_dir):
    """Flipping every label changes no score and no decision."""
    encoder = _encoder(spark, sf_dir)
    rows = _rows(spark, sf_dir)
    flipped = rows.withColumn("label", 1 - F.col("label"))
    a, b = (SC.score_rows(r, encoder, CHAMPION, CHALLENGER, "event_id", "dt", "label") for r in (rows, flipped))
    names = ["fraud_probability", "decision", "challenger_probability"]
    joined = a.select("transaction_id", F.col("true_label").alias("l1"), F.struct(*names).alias("s1")).join(
        b.select("transaction_id", F.col("true_label").alias("l2"), F.struct(*names).alias("s2")), "transaction_id")
    return joined.agg(F.count("*").alias("rows"), F.count_if(F.col("s1") != F.col("s2")).alias("changed_scores"),
                      F.count_if(F.col("l1") != F.col("l2")).alias("changed_labels"))


@query("str_6_unseen_counts", "SELECT 'event_type' AS feature, event_type AS value, count(*) AS occurrences FROM events WHERE event_type = 'error' GROUP BY 2")
def stream_unseen_counts(spark, sf_dir):
    sink = _scored(spark, sf_dir)
    return read_or_empty(spark, f"{sink.root}/unseen", SC.UNSEEN_SCHEMA).groupBy("feature", "value").agg(
        F.sum("occurrences").alias("occurrences"))


@query("str_7_corrupt_messages", """
SELECT count(*) + count(*) FILTER (event_id % 50 = 0) AS messages, count(*) AS scored, count(*) FILTER (event_id % 50 = 0) AS errors FROM events""")
def corrupt_messages(spark, sf_dir):
    sink = _scored(spark, sf_dir, damage=True)
    return read_or_empty(spark, f"{sink.root}/stats", SC.STATS_SCHEMA).agg(
        *[F.sum(c).alias(c) for c in ("messages", "scored", "errors")])


@query("str_8_streamed_buckets", STREAM_SQL + """
SELECT floor(dt / 600) * 600.0 AS bucket_start, count(*) AS scored, count(*) FILTER (raw >= 0.6) AS blocked FROM sc GROUP BY 1""")
def streamed_buckets(spark, sf_dir):
    """The streaming form over event time, in ten-minute buckets, with the watermark bounding its state."""
    out = scratch_path(spark, "buckets")
    parsed = FD.parse_messages(FD.read_feed(spark, _feed(spark, sf_dir), 8), MESSAGE)
    decided = parsed.select(
        F.timestamp_micros(F.round(F.col("dt") * 1e6).cast("bigint")).alias("scored_at"),
        S.decision(S.sigmoid((F.col("k") - 50) / 20), F.lit(0.6)).alias("decision"))
    name = f"buckets_{out[-8:]}"

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    SC.activity_windows(decided, "10 minutes", "40 days").writeStream.queryName(name).outputMode("update").foreachBatch(
        keep).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.schema("bucket_start double, scored bigint, blocked bigint, batch_id bigint").parquet(out)
    return updates.groupBy("bucket_start").agg(
        F.max_by("scored", "batch_id").alias("scored"), F.max_by("blocked", "batch_id").alias("blocked"))


@query("str_9_disagreement_rate", STREAM_SQL + """
SELECT count(*) AS scored, count(*) FILTER (raw >= 0.6) AS blocked, count(*) AS shadow_scored,
  count(*) FILTER ((raw >= 0.6) <> (q >= 0.5)) AS disagreements,
  round(100.0 * count(*) FILTER ((raw >= 0.6) <> (q >= 0.5)) / count(*), 6) + 0.0 AS disagreement_pct FROM sc""")
def disagreement_rate(spark, sf_dir):
    from tidemark.plans.views import run_statistics

    stats = run_statistics(SC.read_audit(spark, _scored(spark, sf_dir).root))
    return stats.select("scored", "blocked", "shadow_scored", "disagreements", r6("disagreement_pct").alias("disagreement_pct"))
