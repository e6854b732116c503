import numpy as np
import pytest

from tidemark.operators import order_stats
from tidemark.operators.order_stats import exact_quantiles, histogram, order_statistics
from tidemark.operators.ordering import ordered_index
from tidemark.operators.splits import (
    EmptyWindowError,
    partition_check,
    recent_rows,
    sixths,
    split_name,
    starting_at,
    temporal_holdout,
)

DECILES = [i / 10 for i in range(11)]


def frame(spark, **columns):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(columns)).repartition(5)


@pytest.mark.parametrize("leaf_rows,sample", [(10, 10**6), (300, 10**6), (300, 150), (10**6, 10**6)])
def test_quantiles_equal_numpy_however_often_the_search_is_narrowed(spark, monkeypatch, leaf_rows, sample):
    monkeypatch.setattr(order_stats, "SAMPLE_ROWS", sample)
    rng = np.random.default_rng(7)
    smooth = rng.normal(size=20_000)
    hot = np.where(rng.random(20_000) < 0.34, 3.25, rng.integers(0, 5_000, 20_000).astype(float))
    gaps = np.where(rng.random(20_000) < 0.5, np.nan, rng.lognormal(size=20_000))
    few = rng.integers(0, 7, 20_000).astype(float)
    rare = np.where(rng.random(20_000) < 0.97, np.nan, rng.normal(size=20_000))
    df = frame(spark, smooth=smooth, hot=hot, gaps=gaps, few=few, rare=rare)
    got = exact_quantiles(df, ["smooth", "hot", "gaps", "few", "rare"], DECILES, leaf_rows=leaf_rows, grid=32)
    for name, values in (("smooth", smooth), ("hot", hot), ("gaps", gaps[~np.isnan(gaps)]), ("few", few),
                         ("rare", rare[~np.isnan(rare)])):
        assert np.allclose(got[name], np.quantile(values, DECILES), rtol=0, atol=1e-12)


def test_nothing_populated_gives_none(spark):
    df = spark.createDataFrame([(None, 1.0)] * 5, "a double, b double")
    got = exact_quantiles(df, ["a", "b"], DECILES)
    assert got["a"] is None and got["b"] == [1.0] * 11


def test_order_statistics_by_rank(spark):
    values = np.random.default_rng(3).permutation(5_000).astype(float)
    at = order_statistics(frame(spark, v=values), {"v": lambda n: [0, 17, n // 2, n - 1]}, leaf_rows=50, grid=16)
    assert at["v"] == {0: 0.0, 17: 17.0, 2_500: 2_500.0, 4_999: 4_999.0}


def test_histogram_is_right_closed_and_counts_gaps(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.5, 3.0, None)], "x double")
    rows = {r["interval"]: r["n"] for r in histogram(df, ["x"], {0: [2.0, 3.0]}).collect()}
    assert rows == {-1: 1, 0: 2, 1: 2}


def test_window_of_rows_keeps_ties_and_takes_the_newest(spark):
    df = spark.createDataFrame([(float(i // 3),) for i in range(30)], "dt double")
    kept = recent_rows(df, "dt", 4)
    assert sorted(r["dt"] for r in kept.collect()) == [8.0] * 3 + [9.0] * 3
    with pytest.raises(EmptyWindowError):
        recent_rows(df, "dt", 0)


def test_holdout_is_a_partition_with_ties_later(spark):
    df = spark.createDataFrame([(i, float(i // 10)) for i in range(1_000)], "id int, dt double")
    earlier, later, cutoff = temporal_holdout(df, "dt", 0.15)
    assert earlier.filter(earlier.dt >= cutoff).isEmpty()
    row = partition_check(df, earlier, later, ["id"]).first()
    assert row["is_partition"] and row["earlier_rows"] + row["later_rows"] == 1_000
    assert not partition_check(df, earlier, df, ["id"]).first()["is_partition"]
    for bad in (0.0, 1.0, -0.5):
        with pytest.raises(ValueError):
            temporal_holdout(df, "dt", bad)
    with pytest.raises(ValueError):
        temporal_holdout(df, "no_such", 0.5)
    with pytest.raises(EmptyWindowError):
        temporal_holdout(df.limit(5).selectExpr("id", "1.0D AS dt"), "dt", 0.5)


def test_split_is_half_open(spark):
    bounds = sixths(0.0, 600.0)
    df = spark.createDataFrame([(x,) for x in (299.0, 300.0, 399.0, 400.0)], "dt double")
    names = [r[0] for r in df.select(split_name(df, "dt", bounds)).collect()]
    assert names == ["train", "val", "val", "stream"]
    with pytest.raises(EmptyWindowError):
        starting_at(df, "dt", 1e9)


def test_bounds_reach_the_scan(spark, tmp_path):
    import pandas as pd

    path = str(tmp_path / "t")
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=100, freq="h"), "x": range(100)})
    spark.createDataFrame(pdf, "ts timestamp_ntz, x long").write.parquet(path)
    kept = starting_at(spark.read.parquet(path), "ts", 1704153600.0)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan
    assert kept.count() == 76


def test_ordered_index_numbers_every_row_once(spark):
    df = spark.createDataFrame([(i % 2, (i * 37) % 101, i) for i in range(500)], "g int, k int, i int")
    rows = ordered_index(df, ["k", "i"], by=["g"], partitions=7).collect()
    for g in (0, 1):
        mine = sorted((r["k"], r["i"], r["index"]) for r in rows if r["g"] == g)
        assert [m[2] for m in mine] == list(range(250))


def test_few_values_are_counted_outright_and_many_are_not(spark):
    rng = np.random.default_rng(5)
    few, many = rng.integers(-2, 3, 4_000) * 0.5, rng.normal(size=4_000)
    few[:40], gone = np.nan, np.full(4_000, np.nan)
    rows = order_stats.tally(frame(spark, few=few, many=many, gone=gone), ["few", "many", "gone"], few=5).collect()
    got = {r["feature"]: r for r in rows}
    values, counts = np.unique(few[40:], return_counts=True)
    assert (got[0]["missing"], got[0]["n"], got[0]["values"], got[0]["counts"]) == (40, 3_960, values.tolist(), counts.tolist())
    assert got[1]["values"] is None and (got[1]["n"], got[1]["low"], got[1]["high"]) == (4_000, many.min(), many.max())
    assert (got[2]["missing"], got[2]["n"], got[2]["low"]) == (4_000, 0, None)
    # partitions that hold few values each, but many together
    apart = spark.range(0, 40, 1, 10).selectExpr("CAST(id DIV 4 AS DOUBLE) AS x")
    assert order_stats.tally(apart, ["x"], few=5).collect()[0]["values"] is None


def test_quantiles_of_few_values_take_one_pass(spark, monkeypatch):
    few = np.random.default_rng(6).integers(0, 90, 9_000) * 1.25
    df = frame(spark, **{f"c{i}": few + i for i in range(70)})
    monkeypatch.setattr(order_stats, "values_in", None)
    monkeypatch.setattr(order_stats, "histogram", None)
    got = exact_quantiles(df, df.columns, DECILES, leaf_rows=10)
    for i in range(70):
        assert np.allclose(got[f"c{i}"], np.quantile(few + i, DECILES), rtol=0, atol=1e-12)
