import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar as S


def values(spark, rows, ddl, expression):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], ddl).select(expression).collect()]


def test_missing(spark):
    assert values(spark, ["a", " ", "", None], "x string", S.is_missing(F.col("x"), T.StringType())) == [False, True, True, True]
    assert values(spark, [1.0, math.nan, None], "x double", S.is_missing(F.col("x"), T.DoubleType())) == [False, True, True]
    assert values(spark, ["1.5", "x", None, "NaN"], "x string", S.to_number(F.col("x"))) == [1.5, None, None, None]


# Decimal ties (1234.5) are left out: the JVM rounds them half up, C half to even.
@pytest.mark.parametrize("x", [0.0, 1.0, 12.0, 123.45, 1234.6, 12345.6, 0.00012347, 0.0000123, -3.14159, 99995.0, 0.1, 100.0, 1e10])
def test_four_significant_digits(spark, x):
    assert values(spark, [x], "x double", S.significant4(F.col("x"))) == [f"{x:.4g}"]


def test_number_rendering(spark):
    cases = {31937.0: "31,937", 1234.5: "1,234.5", 0.25: "0.25", 0.0001234: "1.234e-04", -5.0: "-5", 0.0: "0"}
    assert values(spark, list(cases), "x double", S.render_number(F.col("x"))) == list(cases.values())


def test_bins_are_right_closed(spark):
    edges = [F.lit(2.0), F.lit(3.0)]
    assert values(spark, [1.0, 2.0, 2.5, 3.0, 9.0, None], "x double", S.right_closed_bin(F.col("x"), edges)) == [0, 0, 1, 1, 2, -1]


def test_decisions_and_margins(spark):
    assert values(spark, [0.5, 0.4999], "x double", S.decision(F.col("x"), F.lit(0.5))) == ["BLOCK", "ALLOW"]
    assert values(spark, [0.0, math.nan, None, 0.02], "x double", S.margin_in_ses(F.lit(-0.04), F.col("x"))) == [0.0, 0.0, 0.0, 2.0]


def test_json_lists_survive_bad_text(spark):
    assert values(spark, ['["a","b"]', "{oops", None], "x string", S.parse_json_list(F.col("x"), "string")) == [["a", "b"], [], []]


def test_picked_features(spark):
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(t).alias("type")) for n, t in (("a", "value"), ("b", "missingness"), ("c", "value"))])
    row = spark.range(1).select(S.pick_features(entries, "value"), S.pick_features(entries, "other")).first()
    assert tuple(row) == ("a,c", "(none recorded)")
