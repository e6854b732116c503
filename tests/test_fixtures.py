"""The drift view's join with the parts: once they are many, the driver holds none of them."""

import pytest
from pyspark.sql import functions as F

from tidemark.workload import fixtures as FX


def folder(spark, tmp_path, parts, twice=()):
    keys = spark.range(parts).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") % 25).alias("p_brand"))
    for key in twice:
        keys = keys.union(spark.createDataFrame([(key, "Brand#twice"), (None, "Brand#none")], "p_partkey long, p_brand string"))
    keys.write.parquet(str(tmp_path / "part.parquet"))
    spark.range(400).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "id * 3 AS l_partkey", "id % 7 AS l_suppkey", "CAST(id AS DOUBLE) AS l_extendedprice",
        "timestamp_seconds(id * 86400) AS l_shipdate", "IF(id % 3 = 0, 'R', 'N') AS l_returnflag", "CAST(id % 50 AS DOUBLE) AS l_quantity",
        "0.02D AS l_tax", "'O' AS l_linestatus", "0.05D AS l_discount").write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def plans(df):
    found = df._jdf.queryExecution()
    return found.optimizedPlan().toString(), found.executedPlan().toString()


def test_many_parts_are_not_gathered_on_the_driver(spark, tmp_path):
    view = FX.drift_view(spark, folder(spark, tmp_path, FX.BROADCAST_PARTS + 50_000), "train")
    assert view.where("f_cat IS NOT NULL").count() == 200
    joined = plans(view)[1]
    assert "SortMergeJoin" in joined and "Broadcast" not in joined
    assert "Join" not in plans(view.select("dt", "label", "f_cover"))[0]  # no brand is read


@pytest.mark.parametrize("twice", [(), (6,)])
def test_merged_parts_give_the_rows_of_a_broadcast(spark, tmp_path, monkeypatch, twice):
    sf_dir = folder(spark, tmp_path, 900, twice)
    rows = lambda: sorted(map(repr, FX.drift_view(spark, sf_dir).collect()))
    few = rows()
    monkeypatch.setattr(FX, "BROADCAST_PARTS", 0)
    view = FX.drift_view(spark, sf_dir)
    assert "SortMergeJoin" in plans(view)[1] and rows() == few and len(few) == 400 + len(twice)
    assert view.select("label").count() == len(few)
    assert view.where("f_cat IS NULL").count() == 100
