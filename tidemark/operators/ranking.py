"""Tie-exact ranking metrics: average precision, ROC-AUC, best-F1, confusion blocks.

A cumulative count in score order would need one sorted partition. Instead the
counts are grouped per distinct score (map-side combine folds hot scores), cut into
score ranges at sketched quantiles, and each range adds the totals of the ranges
above it. Ranges are sized by the row count, so no task sees more than its share.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order_stats import grid_points

ROWS_PER_RANGE = 250_000
#: Sketch steps per range: a score that fills several is a hot one.
STEPS_PER_RANGE = 8


class DegenerateLabelsError(ValueError):
    """A metric was asked for on rows that are empty or of one class."""


def score_grid(df: DataFrame, score: Column, rows_per_range: int) -> tuple[int, list[float]]:
    """Number of ranges for the rows there are, and STEPS_PER_RANGE sketched quantiles for each."""
    ranges = math.ceil((df.agg(F.count(score)).first()[0] or 0) / rows_per_range)
    if ranges <= 1:
        return ranges, []
    steps = ranges * STEPS_PER_RANGE
    return ranges, df.agg(F.percentile_approx(score, grid_points(steps), 4 * steps)).first()[0]


def score_cuts(df: DataFrame, score: str, rows_per_range: int = ROWS_PER_RANGE) -> list[float]:
    """Inner cut points that split the scores into ranges of bounded size, as many as the rows need."""
    _, grid = score_grid(df, F.col(score).cast("double"), rows_per_range)
    return sorted(set(grid[STEPS_PER_RANGE - 1:: STEPS_PER_RANGE]))


def with_range(df: DataFrame, score: str, cuts: list[float], output: str = "__range") -> DataFrame:
    """Number of the score range; equal scores always share a range."""
    if not cuts:
        return df.withColumn(output, F.lit(0.0))
    return Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol=score, outputCol=output
    ).transform(df)


def ranked_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
                  cuts: list[float] | None = None, times: str | None = None) -> DataFrame:
    """Per distinct score: pos, neg, and tp, fp = counts at or above that score.

    A row counts as often as column `times` says, once without one.
    """
    n = F.lit(1) if times is None else F.col(times)
    scored = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *by, F.col(score).cast("double").alias("score"), (F.col(label) == 1).alias("hit"), n.cast("bigint").alias("times")
    )
    if cuts is None:
        cuts = score_cuts(scored, "score")
    grouped = scored.groupBy(*by, "score").agg(
        F.sum(F.when(F.col("hit"), F.col("times")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("hit"), 0).otherwise(F.col("times"))).alias("neg"),
    )
    ranged = with_range(grouped, "score", cuts)
    down = (
        Window.partitionBy(*by, "__range").orderBy(F.desc("score"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)})
    if not cuts:
        return local.drop("__range")
    # Totals of the ranges above: at most groups x ranges rows.
    above = (
        Window.partitionBy(*by).orderBy(F.desc("__range"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*by, "__range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
        .select(*by, "__range",
                F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p_above"),
                F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"))
    )
    return (
        local.join(offsets, [*by, "__range"])
        .select(*by, "score", "pos", "neg",
                (F.col("tp") + F.col("p_above")).alias("tp"),
                (F.col("fp") + F.col("n_above")).alias("fp"))
    )


def ranking_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
                    cuts: list[float] | None = None, times: str | None = None) -> DataFrame:
    """One row per group: rows, positives, floor, average precision, ROC-AUC, lift.

    With one class only, the two metrics are NULL.
    """
    return metrics_of(ranked_counts(df, score, label, by, cuts, times), by)


def metrics_of(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The ranking metrics of counts made by :func:`ranked_counts`."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    pairs_won = F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / F.lit(2.0))
    sums = counts.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("rows"),
        F.sum("pos").alias("positives"),
        F.sum(F.col("pos") * precision).alias("weighted_precision"),
        F.sum(pairs_won).alias("pairs_won"),
    )
    p, n = F.col("positives"), F.col("rows") - F.col("positives")
    two = (p > 0) & (n > 0)
    floor = F.try_divide(p.cast("double"), F.col("rows").cast("double"))
    ap = F.when(two, F.col("weighted_precision") / p)
    return sums.select(
        *by, "rows", "positives", floor.alias("floor"),
        ap.alias("pr_auc"),
        F.when(two, F.col("pairs_won") / (p.cast("double") * n)).alias("roc_auc"),
        F.try_divide(ap, floor).alias("lift"),
    )


def require_two_classes(metrics: DataFrame) -> DataFrame:
    """Refuse empty or one-class groups before anyone reads a number."""
    bad = metrics.where((F.col("positives") == 0) | (F.col("positives") == F.col("rows")))
    if metrics.isEmpty() or not bad.isEmpty():
        raise DegenerateLabelsError("metrics need both classes in every group")
    return metrics


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """The three scores with empty denominators read as zero."""
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), zero)
    r = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), zero)
    return p, r, F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), zero)


def best_f1(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
            cuts: list[float] | None = None) -> DataFrame:
    """The threshold with the highest F1 over the whole curve; ties take the lowest."""
    return best_f1_of(ranked_counts(df, score, label, by, cuts), by)


def best_f1_of(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    positives = counts.groupBy(*by).agg(F.sum("pos").alias("p"))
    if by:
        counts = counts.join(positives, list(by))
        total = F.col("p")
    else:
        total = positives.select("p").scalar()
    p, r, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), total - F.col("tp"))
    scored = counts.select(*by, "score", p.alias("precision"), r.alias("recall"), f1.alias("f1"))
    best = F.max_by(F.struct("score", "precision", "recall", "f1"),
                    F.struct(F.col("f1"), (-F.col("score")).alias("s"))).alias("best")
    return scored.groupBy(*by).agg(best).select(
        *by, F.col("best.score").alias("threshold"), "best.precision", "best.recall", "best.f1"
    )


def confusion(df: DataFrame, score: str, label: str, threshold: Column | float,
              by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and scores at a threshold (inclusive), one pass."""
    at = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    flagged, hit = F.col(score) >= at, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(flagged & hit).alias("tp"),
        F.count_if(flagged & ~hit).alias("fp"),
        F.count_if(~flagged & hit).alias("fn"),
        F.count_if(~flagged & ~hit).alias("tn"),
    )
    p, r, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    flagged_n = F.col("tp") + F.col("fp")
    return counts.select(
        *by, "rows", "tp", "fp", "fn", "tn",
        p.alias("precision"), r.alias("recall"), f1.alias("f1"),
        flagged_n.alias("flagged"),
        F.coalesce(F.try_divide(F.lit(100.0) * flagged_n, F.col("rows").cast("double")), F.lit(0.0))
        .alias("flagged_pct"),
    )


def class_balance(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, positives, rate and the negatives-per-positive weight (NULL without positives)."""
    sums = df.groupBy(*by).agg(
        F.count(label).alias("rows"), F.count_if(F.col(label) == 1).alias("positives")
    )
    p, n = F.col("positives").cast("double"), F.col("rows").cast("double")
    return sums.select(
        *by, "rows", "positives",
        F.try_divide(p, n).alias("rate"),
        F.try_divide(n - p, p).alias("positive_weight"),
    )


def positive_weight(df: DataFrame, label: str) -> float:
    weight = class_balance(df, label).first()["positive_weight"]
    if weight is None:
        raise DegenerateLabelsError("no positive rows")
    return weight


def metric_block(df: DataFrame, score: str, label: str, by: Sequence[str],
                 threshold: float = 0.5, times: str | None = None) -> DataFrame:
    """Ranking metrics, the block at a fixed threshold and the best-F1 block per group.

    All three are read off one table of counts per distinct score. A row counts as often as
    column `times` says, once without one.
    """
    cuts = score_cuts(df, score)
    counts = ranked_counts(df, score, label, by, cuts, times)
    flagged = F.col("score") >= float(threshold)

    def total(column: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0))

    fixed = counts.groupBy(*by).agg(
        total("pos", flagged).alias("tp"), total("neg", flagged).alias("fp"),
        total("pos", ~flagged).alias("fn"), total("neg", ~flagged).alias("tn"),
    )
    p, r, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    at_default = fixed.select(
        *by, *[F.col(c).alias(f"{c}_at_default") for c in ("tp", "fp", "fn", "tn")],
        p.alias("precision_at_default"), r.alias("recall_at_default"), f1.alias("f1_at_default"),
    )
    best = best_f1_of(counts, by).select(
        *by, "threshold", *[F.col(c).alias(f"best_{c}") for c in ("precision", "recall", "f1")]
    )
    return metrics_of(counts, by).join(at_default, list(by)).join(best, list(by))
