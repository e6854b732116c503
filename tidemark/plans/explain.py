"""Explanations over attribution rows: top factors, remainders, global importance, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S

ADDITIVITY_TOLERANCE = 1e-4


class AdditivityError(ValueError):
    """Base plus contributions do not give the model's probability back."""


def ranked_factors(phi: Column, names: list[str]) -> Column:
    """Array of (feature, contribution, direction), largest absolute contribution first.

    Sorted inside the row: no shuffle. Equal sizes keep the feature order.
    """
    entries = F.transform(phi, lambda value, i: F.struct(
        (-F.abs(value)).alias("rank"), i.alias("i"),
        F.get(F.array(*[F.lit(n) for n in names]), i).alias("feature"),
        value.alias("contribution"), S.direction(value).alias("direction"),
    ))
    return F.transform(F.array_sort(entries), lambda e: e.dropFields("rank", "i"))


def top_factors(phi: Column, names: list[str], k: int = 5) -> Column:
    return F.slice(ranked_factors(phi, names), 1, k)


def remainder(phi: Column, names: list[str], k: int) -> Column:
    """What the features outside the top k add up to."""
    rest = F.slice(ranked_factors(phi, names), k + 1, max(1, len(names)))
    return F.aggregate(rest, F.lit(0.0), lambda total, e: total + e["contribution"].cast("double"))


def global_importance(rows: DataFrame, names: list[str], phi: str = "phi") -> DataFrame:
    """Mean and maximal absolute contribution, mean push and percent share per feature."""
    long = rows.select(F.posexplode(phi).alias("i", "value")).select(
        F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("feature"), F.col("value").cast("double").alias("value"))
    sums = long.groupBy("feature").agg(
        F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean"), F.max(F.abs("value")).alias("max_abs"))
    total = sums.agg(F.sum("mean_abs")).scalar()
    return sums.withColumn(
        "share_pct", F.coalesce(F.try_divide(F.lit(100.0) * F.col("mean_abs"), total), F.lit(0.0))
    ).orderBy(F.desc("mean_abs"), "feature")


def additivity(rows: DataFrame, probability: str = "probability") -> DataFrame:
    """Largest gap between the rebuilt and the recorded probability."""
    total = F.aggregate("phi", F.lit(0.0), lambda a, v: a + v.cast("double"))
    gap = F.abs(S.sigmoid(F.col("base") + total) - F.col(probability))
    return rows.agg(F.count("*").alias("rows"), F.max(gap).alias("max_error")).withColumn(
        "additive", F.col("max_error") <= ADDITIVITY_TOLERANCE)


def require_additive(rows: DataFrame, probability: str = "probability") -> DataFrame:
    check = additivity(rows, probability).first()
    if not check["additive"]:
        raise AdditivityError(f"contributions miss the prediction by {check['max_error']:.2e}")
    return rows


def breakdown(rows: DataFrame, names: list[str], labels: dict[str, Column], keep: list[str], k: int,
              threshold: float) -> DataFrame:
    """One line per shown factor of each row, plus the base, the remainder and the margin."""
    c = F.col
    total = F.aggregate("phi", F.lit(0.0), lambda a, v: a + v.cast("double"))
    text = F.create_map(*[x for n in names for x in (F.lit(n), labels.get(n, F.lit("")))])
    shown = F.transform(top_factors(c("phi"), names, k), lambda e, i: F.struct(
        (i + 1).alias("position"), e["feature"].alias("term"),
        F.try_element_at(text, e["feature"]).alias("value"), e["contribution"].alias("contribution")))

    def line(position: int, term: str, value: Column) -> Column:
        return F.struct(F.lit(position).alias("position"), F.lit(term).alias("term"),
                        F.lit("").alias("value"), value.alias("contribution"))

    lines = F.concat(
        F.array(line(0, "base", c("base"))), shown,
        F.array(line(k + 1, f"+ {max(0, len(names) - k)} other features", remainder(c("phi"), names, k)),
                line(k + 2, "margin", c("base") + total)),
    )
    return rows.select(*keep, "probability", S.decision(c("probability"), F.lit(float(threshold))).alias("decision"),
                       F.inline(lines))
