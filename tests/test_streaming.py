import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.encoding import FeatureEncoder
from tidemark.streaming import feed as FD
from tidemark.streaming import scoring as SC

MESSAGE = "id bigint, dt double, kind string, amount double, label int"
CHAMPION = SC.Scorer("v1", 0.5, lambda: F.col("amount").cast("double") / 100)


@pytest.fixture()
def rows(spark):
    return spark.range(500).select(
        "id", (F.col("id") * 10.0).alias("dt"), F.when(F.col("id") % 5 == 0, "new").otherwise("known").alias("kind"),
        F.when(F.col("id") % 10 != 3, (F.col("id") % 100).cast("double")).alias("amount"),
        (F.col("id") % 30 == 0).cast("int").alias("label"))


@pytest.fixture()
def encoder(rows):
    return FeatureEncoder().fit(rows.where("kind = 'known'").select("kind", "amount"))


def test_missing_keys_are_omitted(rows):
    values = {r["key"]: r["value"] for r in FD.to_messages(rows, "id").collect()}
    assert "amount" not in values["3"] and '"amount":4.0' in values["4"]


def test_replay_is_ordered_and_limited(spark, rows, tmp_path):
    path = str(tmp_path / "feed")
    FD.write_feed(rows.orderBy(F.rand(1)), "dt", ["id"], "id", path, slices=3, limit=200, start=1_000.0)
    ids = [r["id"] for r in FD.parse_messages(spark.read.text(path), MESSAGE).collect()]
    assert sorted(ids) == list(range(100, 300))


def test_corrupt_messages_are_kept_apart(spark):
    df = spark.createDataFrame([('{"id": 1, "extra": 2}',), ("{nonsense",), ("",)], "value string")
    out = FD.parse_messages(df, MESSAGE).collect()
    assert [r["id"] for r in out] == [1, None, None]
    assert [r[FD.CORRUPT] is not None for r in out] == [False, True, True]


def test_challenger_never_changes_a_decision(rows, encoder):
    def broken(_):
        raise RuntimeError("no")

    plain = SC.score_rows(rows, encoder, CHAMPION, None, "id", "dt", "label")
    loud = SC.score_rows(rows, encoder, CHAMPION, SC.Scorer("v2", 0.5, lambda: F.lit(1.0)), "id", "dt", "label")
    failing = SC.score_rows(rows, encoder, CHAMPION, SC.Scorer("v3", 0.5, SC.guarded(broken, ["amount"])), "id", "dt", "label")
    names = ["transaction_id", "fraud_probability", "decision", "threshold", "model_version", "unseen_categories"]
    want = sorted(plain.select(names).collect())
    assert sorted(loud.select(names).collect()) == want == sorted(failing.select(names).collect())
    assert {r["challenger_decision"] for r in loud.select("challenger_decision").collect()} == {"BLOCK"}
    assert failing.where("challenger_version IS NOT NULL OR challenger_probability IS NOT NULL").isEmpty()


def test_stream_equals_batch_and_replays_idempotently(spark, rows, encoder, tmp_path):
    path = str(tmp_path / "feed")
    FD.write_feed(rows, "dt", ["id"], "id", path, slices=2)
    sink = SC.AuditSink(str(tmp_path / "out"), encoder, CHAMPION, None, "id", "dt", "label")
    parsed = FD.parse_messages(FD.read_feed(spark, path, 4), MESSAGE)
    SC.run_scoring(parsed, sink).awaitTermination()
    SC.run_scoring(FD.parse_messages(FD.read_feed(spark, path, 4), MESSAGE), sink).awaitTermination()
    names = ["transaction_id", "fraud_probability", "decision", "unseen_categories", "true_label"]
    batch = SC.score_rows(rows, encoder, CHAMPION, None, "id", "dt", "label")
    assert sorted(SC.read_audit(spark, sink.root).select(names).collect(), key=lambda r: r[0]) == \
        sorted(batch.select(names).collect(), key=lambda r: r[0])
    unseen = spark.read.parquet(f"{sink.root}/unseen").groupBy("feature", "value").agg(F.sum("occurrences")).collect()
    assert [tuple(r) for r in unseen] == [("kind", "new", 100)]


def test_booster_scores_and_explains_in_the_audit_row(spark, rows, tmp_path):
    from tidemark.plans import training as TR

    settings = TR.BoostSettings(depth=2, step=0.3)
    labelled = rows.withColumn("label", ((F.col("id") % 5 == 0) | (F.col("id") % 100 > 90)).cast("int"))
    encoder = FeatureEncoder("label", ("id", "dt")).fit(labelled)
    encoded = TR.prepare(encoder, labelled, ["id"], "label")
    inputs = TR.TreeInputs.fit(encoded, encoder.names)
    ready = inputs.apply(encoded, ["id", "label"])
    model = TR.fit_cached(TR.boosted(settings, 3), TR.fixed_layout(TR.with_weights(ready), ["id"]))
    scorer = SC.tree_scorer("v9", 0.5, model, inputs, encoder, top=2)
    audit = SC.score_rows(labelled, encoder, scorer, None, "id", "dt", "label")
    own = {str(r["id"]): round(r["score"], 6) for r in TR.positive_probability(model, ready, 3, ["id"]).collect()}
    got = audit.collect()
    assert {r["transaction_id"]: r["fraud_probability"] for r in got} == pytest.approx(own, abs=2e-6)
    assert all(r["n_trees"] == 3 and len(r["top_factors"]) == 2 for r in got)
    values = {f["value"] for r in got for f in r["top_factors"] if f["feature"] == "kind"}
    assert values <= {"new", "known"} and values


def test_each_row_is_scored_once_timed_and_numbered(spark, tmp_path):
    met = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def slow(k: pd.Series) -> pd.Series:
        met.add(len(k))
        time.sleep(0.02)
        return k / 100.0

    rows = spark.range(240).select(
        "id", F.col("id").cast("double").alias("dt"), (F.col("id") % 100).cast("double").alias("k"), F.concat(F.lit("g"), F.col("id") % 7).alias("g"),
        F.when(F.col("id") % 10 == 3, "broken").alias(FD.CORRUPT))
    encoder = FeatureEncoder(None, ("id", "dt")).fit(rows.drop(FD.CORRUPT).where("g <> 'g6'"))
    sink = SC.AuditSink(str(tmp_path / "audit"), encoder, SC.Scorer("v1", 0.5, lambda: slow(F.col("k"))), None, "id", "dt")
    batches = [rows.where("id < 100").repartition(3), rows.where("id >= 100").repartition(5)]
    for i in (0, 1, 1):  # the second batch is delivered twice
        sink(batches[i], i)
    good = rows.where(F.col(FD.CORRUPT).isNull())
    audit = SC.read_audit(spark, sink.root)
    assert sorted(r["id"] for r in audit.collect()) == list(range(1, good.count() + 1))
    first = {r["id"] for r in audit.where("batch_id = 0").collect()}
    assert first == set(range(1, len(first) + 1))
    assert met.value == good.count() + good.where("id >= 100").count()
    assert audit.where("latency_ms < 15 OR latency_ms > 60000").count() == 0
    unseen = spark.read.parquet(f"{sink.root}/unseen").agg(F.sum("occurrences")).first()[0]
    assert unseen == good.where("g = 'g6'").count()
    stats = {r["batch_id"]: r for r in spark.read.schema(SC.STATS_SCHEMA).parquet(f"{sink.root}/stats").collect()}
    assert stats[0]["messages"] == 100 and stats[0]["errors"] == 10 and stats[1]["through"] == good.count()


def test_numbers_do_not_depend_on_the_size_of_a_partition(spark):
    rows = spark.range(0, 50, 1, 4)
    sizes = {r["p"]: r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    assert [r[0] for r in rows.select(SC._number(sizes, 1 << 40)).collect()] == [(1 << 40) + i for i in range(1, 51)]
    assert rows.where("id < 0").select(SC._number({}, 0)).collect() == []


def test_a_part_known_to_hold_what_raises_is_not_tried_whole():
    import numpy as np
    import pandas as pd

    from tidemark.streaming.scoring import guarded

    tried = []

    def score(rows):
        tried.append(len(rows))
        if (rows["a"] == 700).any():
            raise RuntimeError("one row cannot be scored")
        assert list(rows.index) == list(range(len(rows)))
        return rows["a"] * 2

    run = guarded(score, ["a"])
    attempt = dict(zip(run.__code__.co_freevars, (c.cell_contents for c in run.__closure__)))["run"].func
    rows = pd.DataFrame({"a": np.arange(1_024.0)})
    got = attempt(rows).to_numpy()
    assert np.isnan(got[700]) and np.array_equal(np.delete(got, 700), np.delete(np.arange(1_024.0) * 2, 700))
    assert len(tried) < 21  # 21 if both halves of every part are tried

    def together(rows):
        if len(rows) > 3:
            raise RuntimeError("too many at once")
        return rows["a"]

    run = guarded(together, ["a"])
    attempt = dict(zip(run.__code__.co_freevars, (c.cell_contents for c in run.__closure__)))["run"].func
    assert np.array_equal(attempt(rows).to_numpy(), rows["a"].to_numpy())
    assert len(attempt(rows.iloc[:0])) == 0
