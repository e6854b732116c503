import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import encoding as E


@pytest.fixture()
def train(spark):
    rows = [(i, float(i), (["chrome", "safari", None])[i % 3], bool(i % 2), None if i % 4 == 0 else 1.0, i % 6 == 0)
            for i in range(12)]
    return spark.createDataFrame(rows, "id int, amount double, browser string, flag boolean, sparse double, label boolean").withColumn(
        "label", F.col("label").cast("int"))


@pytest.fixture()
def model(train):
    return E.FeatureEncoder("label", ("id",)).fit(train)


def test_three_states_and_no_refit(spark, model):
    other = spark.createDataFrame([("brave", 1.0, True, None, "x"), (None, 2.0, False, 1.0, "x"), ("safari", 3.0, True, 1.0, "x"), (" ", 4.0, True, 1.0, "x")],
                                  "browser string, amount double, flag boolean, sparse double, extra string")
    out = model.transform(other, states=True)
    assert out.columns[:4] == ["amount", "browser", "flag", "sparse"]
    rows = out.orderBy("amount").collect()
    assert [r["browser"] for r in rows] == [-1.0, None, 1.0, None]
    assert rows[0]["unseen"] == ["browser"] and rows[0]["missing"] == ["sparse"]
    assert rows[3]["missing"] == ["browser"]
    assert {r["level"] for r in model.vocabulary.collect()} == {"chrome", "safari"}


def test_contract(spark, model, train):
    with pytest.raises(E.SchemaContractError):
        model.transform(train.drop("amount"))
    with pytest.raises(E.SchemaContractError):
        model.transform(train.withColumn("amount", F.lit("many")))


def test_save_load_and_version(spark, model, train, tmp_path):
    path = str(tmp_path / "enc")
    model.save(path)
    again = E.EncoderModel.load(spark, path)
    assert again.names == model.names and again.categorical == model.categorical and again.fitted_rows == 12
    assert sorted(again.transform(train).collect()) == sorted(model.transform(train).collect())
    E.small_table(spark, [("browser", 0, "categorical", None, 1, 99)],
                  "feature string, position int, kind string, label string, fitted_rows bigint, format_version int"
                  ).write.mode("overwrite").parquet(f"{path}/contract")
    with pytest.raises(E.VocabularyVersionError):
        E.EncoderModel.load(spark, path)


def fresh(model):
    """The same vocabulary in a model that has measured nothing yet."""
    return E.EncoderModel(model.names, model.categorical, model.vocabulary, model.label, model.fitted_rows)


def test_large_vocabularies_take_joins_and_agree(spark, monkeypatch):
    df = spark.range(4_000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
        .otherwise(F.concat(F.lit("l"), (F.col("id") % 501).cast("string"))).alias("level"),
        F.when(F.col("id") % 5 < 3, "most").otherwise(F.concat(F.lit("m"), (F.col("id") % 97).cast("string"))).alias("other"),
        F.lit(None).cast("string").alias("gaps"))
    fitted = E.FeatureEncoder(None, ("id",)).fit(df.where("id < 300"))
    want = sorted(fitted.transform(df, keep=["id"], states=True).collect())
    assert any(r["unseen"] for r in want)
    monkeypatch.setattr(E, "LITERAL_LEVELS", 10)
    assert sorted(fresh(fitted).transform(df, keep=["id"], states=True).collect()) == want
    monkeypatch.setattr(E, "BROADCAST_BYTES", 10)
    assert sorted(fresh(fitted).transform(df, keep=["id"], states=True).collect()) == want
    assert fresh(fitted).transform(df.where("id < 0")).collect() == []
    long = E.levels_long(df, ["level"])
    a = E.vocabulary_lookup(long, fitted.vocabulary, broadcast_bytes=1 << 20).groupBy("state").count().collect()
    b = E.vocabulary_lookup(long, fitted.vocabulary, broadcast_bytes=5).groupBy("state").count().collect()
    assert sorted(a) == sorted(b)


def test_hot_levels_and_gaps_are_spread(spark):
    """A level of 60 % of the rows and as many gaps: no partition of the join gets more than a few times its share."""
    long = spark.range(60_000).select(F.lit("f").alias("feature"), F.when(F.col("id") % 10 < 3, "hot").when(F.col("id") % 10 < 5, None)
                                      .otherwise(F.concat(F.lit("l"), F.col("id") % 20_000)).alias("level"))
    vocabulary = long.where("level IS NOT NULL").distinct().withColumn("code", F.pmod(F.xxhash64("level"), F.lit(1_000_000)).cast("int"))
    hot = E.hot_levels(long, vocabulary, share=50)
    assert [r["level"] for r in hot.collect()] == ["hot"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = E.coded_levels(long, vocabulary, hot)
        sizes = [r["count"] for r in coded.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 60_000 and max(sizes) < 2 * 60_000 / 8
        assert coded.where("level IS NOT NULL AND (code IS NULL OR code <> CAST(pmod(xxhash64(level), 1000000) AS INT))").count() == 0
        assert coded.where("level IS NULL AND code IS NOT NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_summary_keeps_every_hot_level(spark):
    rng = random.Random(3)
    rows = [("a", f"rare{rng.randrange(5_000)}") for _ in range(9_000)] + [("a", f"hot{i}") for i in range(9) for _ in range(300)] + [("b", "only")] * 5
    rng.shuffle(rows)
    long = spark.createDataFrame(rows, "feature string, level string").repartition(6)
    vocabulary = long.distinct().withColumn("code", F.lit(1))
    found = {(r["feature"], r["level"]) for r in E.hot_levels(long, vocabulary, share=50).collect()}
    assert {("a", f"hot{i}") for i in range(9)} | {("b", "only")} <= found and len([f for f in found if f[0] == "a"]) <= 100


def test_number_of_shuffles_does_not_follow_the_columns(spark, monkeypatch):
    monkeypatch.setattr(E, "LITERAL_LEVELS", 0)
    monkeypatch.setattr(E, "BROADCAST_BYTES", 0)
    counts = []
    for n in (2, 31):
        df = spark.range(50).select("id", *[(F.col("id") % (i + 2)).cast("string").alias(f"c{i}") for i in range(n)])
        model = E.FeatureEncoder(None, ("id",)).fit(df)
        out = model.transform(df, keep=["id"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        counts.append(plan.count("Exchange hashpartitioning"))
        small = {c: {str(v): k for k, v in enumerate(sorted(map(str, range(int(c[1:]) + 2))))} for c in model.categorical}
        for row in out.collect():
            assert all(row[c] == small[c][str(row["id"] % (int(c[1:]) + 2))] for c in model.categorical)
    assert counts[0] == counts[1]


def test_large_codes_stay_apart_and_decode_without_a_collect(spark):
    big = 5_000_000
    vocabulary = spark.range(big).select(F.lit("f").alias("feature"), F.concat(F.lit("level "), "id").alias("level"), (F.col("id") + 16_777_210).cast("int").alias("code"))
    model = E.EncoderModel(("f",), ("f",), vocabulary)
    shown = spark.createDataFrame([(16_777_216.0,), (16_777_217.0,), (16_777_210.0 + big - 1,), (-1.0,), (None,), (5.0,)], "code double")
    got = {r["code"]: r["text"] for r in model.decoded(shown, "f", "code", "text").collect()}
    assert got == {16_777_216.0: "level 6", 16_777_217.0: "level 7", 16_777_210.0 + big - 1: f"level {big - 1}", -1.0: "<unseen>", None: "<missing>", 5.0: "<code 5>"}


def test_a_stream_of_batches_runs_no_job_for_the_vocabulary(spark, model, train):
    model.transform(train).collect()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("encoder", "no job expected")
    for _ in range(3):
        model.transform(train, states=True)
    assert list(tracker.getJobIdsForGroup("encoder")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_numbering_agrees_with_and_without_a_window(spark):
    levels = spark.range(900).select(F.concat(F.lit("f"), F.col("id") % 3).alias("feature"),
                                     F.concat(F.lit("é"), F.col("id")).alias("level"))
    assert sorted(E.number_levels(levels).collect()) == sorted(E.number_levels(levels, window_levels=0).collect())


def test_decode(spark, model):
    rows = spark.createDataFrame([(None,), (-1.0,), (0.0,), (9.0,)], "c double")
    got = [r[0] for r in rows.select(model.decode("browser", F.col("c"))).collect()]
    assert got == ["<missing>", "<unseen>", "chrome", "<code 9>"]
    numbers = spark.createDataFrame([(31937.0,), (1234.5,), (0.00012,), (None,)], "c double")
    got = [r[0] for r in numbers.select(model.decode("amount", F.col("c"))).collect()]
    assert got == ["31,937", "1,234.5", "1.200e-04", "<missing>"]
