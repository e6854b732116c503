"""Population Stability Index over every shared feature, and its decomposition.

One summary pass over both sides counts the values of every feature that has few distinct
ones; quantiles and buckets of these follow from the counts. The others take the narrowing
passes for the exact reference quantiles and one counting pass by (feature, bucket). Missing values are a bucket, bins are
right-closed, the bucket universe is the union of both sides.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar as S
from tidemark.operators.order_stats import (
    ColumnSummary,
    approximate_quantiles,
    exact_quantiles_of,
    histogram,
    summary_of,
    tally,
)
from tidemark.session import small_table

NUMERIC, CATEGORICAL = "numeric", "categorical"


def feature_kind(data_type: T.DataType) -> str:
    """Booleans take the categorical route: a lopsided flag has no usable quantiles."""
    return NUMERIC if isinstance(data_type, T.NumericType) else CATEGORICAL


def scoreable_features(reference: DataFrame, current: DataFrame,
                       exclude: Iterable[str] = ()) -> dict[str, str]:
    """Shared columns in reference order with the route set by the reference type."""
    shared, skip = set(current.columns), set(exclude)
    return {
        f.name: feature_kind(f.dataType)
        for f in reference.schema.fields
        if f.name in shared and f.name not in skip
    }


@dataclass(frozen=True)
class FeatureProfile:
    """Everything about one feature that the counting pass needs."""

    feature: str
    kind: str
    edges: tuple[float, ...] | None
    rows: tuple[int, int]
    populated: tuple[int, int]
    #: Reference and current summary where both hold all distinct values.
    counted: tuple[ColumnSummary, ColumnSummary] | None = None


def usable_edges(quantiles: list[float] | None) -> tuple[float, ...] | None:
    """De-duplicated quantiles; fewer than three leave nothing to compare."""
    if quantiles is None:
        return None
    edges = tuple(sorted(set(quantiles)))
    return edges if len(edges) >= 3 else None


def _side(df: DataFrame, kinds: dict[str, str], tag: str) -> DataFrame:
    """Numbers as doubles, the rest as text, NaN and blanks as NULL, plus the side tag.

    Written as SQL text: a wide frame has hundreds of these, and text is one call each.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    picked = [f"'{tag}' AS __side"]
    for name, kind in kinds.items():
        column = f"`{name}`"
        fractional = isinstance(types[name], (T.FloatType, T.DoubleType))
        if kind == CATEGORICAL:
            text = f"CAST({column} AS STRING)"
            value = f"CASE WHEN trim({text}) <> '' THEN {text} END"
        elif fractional or not isinstance(types[name], (T.NumericType, T.BooleanType)):
            number = f"try_cast({column} AS DOUBLE)"
            value = f"nullif({number}, double('NaN'))"
        else:
            value = f"CAST({column} AS DOUBLE)"
        picked.append(f"{value} AS {column}")
    return df.selectExpr(*picked)


@dataclass(frozen=True)
class DriftFrame:
    """Both sides as one narrow frame: the side, the numeric values and the levels as arrays."""

    rows: DataFrame
    numeric: tuple[str, ...]
    levels: tuple[str, ...]

    def numbers(self) -> list[str]:
        return [f"`{f}`" for f in self.numeric]

    def presence(self) -> list[str]:
        """0 where a level is present, so that levels can be counted like numbers."""
        return [f"CASE WHEN `{f}` IS NOT NULL THEN 0D END" for f in self.levels]

    def level_values(self) -> DataFrame:
        """(side, feature number, level)."""
        columns = ", ".join(f"`{f}`" for f in self.levels)
        return self.rows.selectExpr("__side", f"posexplode(array({columns})) AS (feature, bucket)")


def profile_features(
    reference: DataFrame,
    current: DataFrame,
    exclude: Iterable[str] = (),
    features: Iterable[str] | None = None,
    bins: int = S.DEFAULT_BINS,
    accuracy: int | None = None,
) -> tuple[dict[str, FeatureProfile], DriftFrame]:
    """Profiles per feature and the tagged union of both sides."""
    kinds = scoreable_features(reference, current, exclude)
    if features is not None:
        keep = set(features)
        kinds = {f: k for f, k in kinds.items() if f in keep}
    numeric = tuple(f for f, k in kinds.items() if k == NUMERIC)
    levels = tuple(f for f, k in kinds.items() if k == CATEGORICAL)
    left = _side(reference, kinds, "ref")
    frame = DriftFrame(left.unionByName(_side(current, kinds, "cur")), numeric, levels)

    # One pass over both sides: rows, populated rows, ranges and few distinct values of every feature.
    sides: dict[tuple[str, int], tuple[int, ColumnSummary]] = {
        (r["side"], r["feature"]): (r["missing"] + r["n"], summary_of(r))
        for r in tally(frame.rows, frame.numbers() + frame.presence(), "__side").collect()
    }
    nothing = (0, ColumnSummary(0, None, None, (), ()))
    summaries = {i: sides[("ref", i)][1] for i in range(len(numeric)) if ("ref", i) in sides}
    probabilities = [i / bins for i in range(bins + 1)]
    if not numeric:
        quantiles = {}
    elif accuracy is not None:
        quantiles = approximate_quantiles(left, list(numeric), probabilities, accuracy)
    else:
        quantiles = exact_quantiles_of(left, frame.numbers(), summaries, probabilities)

    profiles = {}
    for i, f in enumerate((*numeric, *levels)):
        (ref_rows, ref), (cur_rows, cur) = (sides.get((side, i), nothing) for side in ("ref", "cur"))
        profiles[f] = FeatureProfile(
            f, kinds[f], usable_edges(quantiles.get(i)) if kinds[f] == NUMERIC else None,
            (ref_rows, cur_rows), (ref.count, cur.count),
            (ref, cur) if kinds[f] == NUMERIC and ref.values is not None and cur.values is not None else None,
        )
    return {f: profiles[f] for f in kinds}, frame


def _profile_table(frame: DriftFrame, profiles: dict[str, FeatureProfile]) -> DataFrame:
    """One row per feature: bounded by the width of the schema, so safe to broadcast."""
    rows = [
        (p.feature, p.kind, list(p.edges) if p.edges else None, list(p.edges[1:-1]) if p.edges else [],
         p.rows[0], p.rows[1], p.populated[0], p.populated[1])
        for p in profiles.values()
    ]
    return small_table(
        frame.rows.sparkSession, rows,
        "feature string, kind string, edges array<double>, inner_edges array<double>, "
        "ref_rows bigint, cur_rows bigint, ref_populated bigint, cur_populated bigint",
    )


def _known_buckets(profile: FeatureProfile) -> dict[str | None, list[int]]:
    """Reference and current rows per bucket that has any, from the counted values."""
    buckets: dict[str | None, list[int]] = {}
    for side, summary in enumerate(profile.counted):
        at = np.searchsorted(profile.edges[1:-1], summary.values, side="left").tolist()
        missing = (None, profile.rows[side] - profile.populated[side])
        for bucket, n in (missing, *zip(map(str, at), summary.counts)):
            if n:
                buckets.setdefault(bucket, [0, 0])[side] += n
    return buckets


def bucket_counts(frame: DriftFrame, profiles: dict[str, FeatureProfile]) -> DataFrame:
    """(feature, bucket, ref_n, cur_n) for all measurable features.

    Buckets are bin numbers or levels as text; NULL is the missing bucket. Grouping uses
    feature numbers; names are joined to the counts.
    """
    spark = frame.rows.sparkSession

    def named(counts: DataFrame, names: list[str]) -> DataFrame:
        table = small_table(spark, list(enumerate(names)), "number int, name string")
        return counts.join(F.broadcast(table), F.col("feature") == F.col("number")).select(
            F.col("name").alias("feature"), F.col("bucket").cast("string").alias("bucket"), "ref_n", "cur_n"
        )

    def of_side(tag: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == tag, F.col("n"))), F.lit(0))

    numeric = [f for f in frame.numeric if profiles[f].edges and not profiles[f].counted]
    known = [(f, bucket, *n) for f in frame.numeric if profiles[f].edges and profiles[f].counted
             for bucket, n in _known_buckets(profiles[f]).items()]
    parts = []
    if known:
        parts.append(small_table(spark, known, "feature string, bucket string, ref_n bigint, cur_n bigint"))
    if numeric:
        cuts = {i: list(profiles[f].edges[1:-1]) for i, f in enumerate(numeric)}
        binned = histogram(frame.rows, [f"`{f}`" for f in numeric], cuts, "__side")
        bucket = F.when(F.col("interval") >= 0, F.col("interval")).alias("bucket")
        parts.append(named(binned.groupBy("feature", bucket).agg(
            of_side("ref").alias("ref_n"), of_side("cur").alias("cur_n")), numeric))
    if frame.levels:
        counts = frame.level_values().groupBy("feature", "bucket").agg(
            F.count_if(F.col("__side") == "ref").alias("ref_n"),
            F.count_if(F.col("__side") == "cur").alias("cur_n"),
        )
        parts.append(named(counts, list(frame.levels)))
    if not parts:
        return small_table(spark, [], "feature string, bucket string, ref_n bigint, cur_n bigint")
    return reduce(DataFrame.unionByName, parts)


def drift_table(
    reference: DataFrame,
    current: DataFrame,
    exclude: Iterable[str] = (),
    features: Iterable[str] | None = None,
    bins: int = S.DEFAULT_BINS,
    epsilon: float = S.DEFAULT_EPSILON,
    accuracy: int | None = None,
) -> DataFrame:
    """One row per feature: both PSI readings, the missing rates and the band."""
    profiles, frame = profile_features(reference, current, exclude, features, bins, accuracy)
    table = _profile_table(frame, profiles)
    populated = F.col("bucket").isNotNull()
    term_all = S.psi_term(S.share(F.col("ref_n"), F.col("ref_rows")),
                          S.share(F.col("cur_n"), F.col("cur_rows")), epsilon)
    term_populated = S.psi_term(S.share(F.col("ref_n"), F.col("ref_populated")),
                                S.share(F.col("cur_n"), F.col("cur_populated")), epsilon)
    totals = table.select("feature", "ref_rows", "cur_rows", "ref_populated", "cur_populated")
    sums = (
        bucket_counts(frame, profiles)
        .join(F.broadcast(totals), "feature")
        .groupBy("feature")
        .agg(F.sum(term_all).alias("sum_all"),
             F.sum(F.when(populated, term_populated)).alias("sum_populated"))
    )
    measurable = (F.col("kind") == CATEGORICAL) | F.col("edges").isNotNull()
    both = (F.col("ref_rows") > 0) & (F.col("cur_rows") > 0)
    both_populated = (F.col("ref_populated") > 0) & (F.col("cur_populated") > 0)
    na_ref = 1.0 - S.share(F.col("ref_populated"), F.col("ref_rows"))
    na_cur = 1.0 - S.share(F.col("cur_populated"), F.col("cur_rows"))
    return (
        # The left side has one row per feature; broadcasting the per-feature sums keeps it local.
        table.join(F.broadcast(sums), "feature", "left")
        .withColumn("psi_all", F.when(measurable & both, F.col("sum_all")))
        .withColumn("psi_non_null", F.when(measurable & both_populated, F.col("sum_populated")))
        .select(
            "feature", "kind", "psi_all", "psi_non_null",
            (F.col("psi_all") - F.col("psi_non_null")).alias("psi_from_missingness"),
            na_ref.alias("na_rate_reference"),
            na_cur.alias("na_rate_current"),
            (na_cur - na_ref).alias("na_rate_delta"),
            S.psi_band(F.col("psi_all")).alias("band"),
        )
    )


def psi_report(reference: DataFrame, current: DataFrame, **options) -> DataFrame:
    """(feature, kind, psi, band), worst first, unmeasurable last."""
    return (
        drift_table(reference, current, **options)
        .select("feature", "kind", F.col("psi_all").alias("psi"), "band")
        .orderBy(F.desc_nulls_last("psi"), "feature")
    )


def decompose_drift(reference: DataFrame, current: DataFrame, **options) -> DataFrame:
    return (
        drift_table(reference, current, **options).drop("band")
        .orderBy(F.desc_nulls_last("psi_all"), "feature")
    )


def psi_contributions(
    reference: DataFrame,
    current: DataFrame,
    feature: str,
    bins: int = S.DEFAULT_BINS,
    epsilon: float = S.DEFAULT_EPSILON,
) -> DataFrame:
    """Per-bucket breakdown of one numeric feature, largest contribution first."""
    profiles, frame = profile_features(reference, current, features=[feature], bins=bins)
    profile = profiles[feature]
    if profile.kind != NUMERIC:
        raise ValueError(f"{feature} is not numeric")
    table = _profile_table(frame, profiles)
    index = F.col("bucket").try_cast("int")
    last = F.size("inner_edges")
    low = F.when(index == 0, float("-inf")).otherwise(F.get("inner_edges", index - 1))
    high = F.when(index == last, float("inf")).otherwise(F.get("inner_edges", index))
    ref = F.greatest(S.share(F.col("ref_n"), F.col("ref_rows")), F.lit(epsilon))
    cur = F.greatest(S.share(F.col("cur_n"), F.col("cur_rows")), F.lit(epsilon))
    return (
        bucket_counts(frame, profiles)
        .join(F.broadcast(table), "feature")
        .select(
            F.coalesce(index, F.lit(S.MISSING_BUCKET)).alias("bucket_code"),
            F.when(index.isNull(), "missing").otherwise(S.bin_label(low, high)).alias("bucket"),
            ref.alias("reference_pct"),
            cur.alias("current_pct"),
            S.psi_term(ref, cur, epsilon).alias("contribution"),
        )
        .orderBy(F.desc("contribution"), "bucket_code")
    )


def psi_numeric(reference: DataFrame, current: DataFrame, feature: str, **options) -> DataFrame:
    return drift_table(_as(reference, feature, "double"), _as(current, feature, "double"), **options).select(
        "feature", F.col("psi_all").alias("psi")
    )


def psi_categorical(reference: DataFrame, current: DataFrame, feature: str, **options) -> DataFrame:
    return drift_table(_as(reference, feature, "string"), _as(current, feature, "string"), **options).select(
        "feature", F.col("psi_all").alias("psi")
    )


def _as(df: DataFrame, feature: str, data_type: str) -> DataFrame:
    return df.select(F.col(f"`{feature}`").cast(data_type).alias(feature))


def band_counts(report: DataFrame) -> DataFrame:
    """Features per band, zero bands included."""
    bands = small_table(report.sparkSession, 
        [("stable",), ("moderate",), ("major",), ("unmeasurable",)], "band string"
    )
    counted = report.groupBy("band").agg(F.count("*").alias("n"))
    return bands.join(F.broadcast(counted), "band", "left").select(
        "band", F.coalesce("n", F.lit(0)).cast("bigint").alias("features")
    )


def band_regression(report: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Measured against expected band sizes, one row per band."""
    table = small_table(report.sparkSession, list(expected.items()), "band string, expected bigint")
    return band_counts(report).join(F.broadcast(table), "band").withColumn(
        "matches", F.col("features") == F.col("expected")
    )


def classify_drift(drift: DataFrame, threshold: float = S.MAJOR_ABOVE,
                   residual: float = S.VALUE_DRIFT_RESIDUAL) -> DataFrame:
    """Adds ``drift_type`` for features at or above the threshold: value or missingness.

    A feature nobody decomposed counts as value drift; one whose populated rows are
    unmeasurable counts as missingness.
    """
    decomposed = (
        F.col("decomposed") if "decomposed" in drift.columns else F.lit(True)
    )
    drifting = F.coalesce(F.col("psi_all") >= threshold, F.lit(False))
    values_moved = F.coalesce(F.col("psi_non_null") >= residual, F.lit(False))
    return drift.withColumn(
        "drift_type",
        F.when(~drifting, "none")
        .when(~decomposed | values_moved, "value")
        .otherwise("missingness"),
    )


def missingness_driven_majors(drift: DataFrame) -> DataFrame:
    """The sweep's own cut: a major reading whose populated rows are stable."""
    return drift.where((F.col("psi_all") >= S.MAJOR_ABOVE) & (F.col("psi_non_null") < S.STABLE_BELOW))


def overall_psi(report: DataFrame, psi: str = "psi") -> DataFrame:
    """The worst feature, not the mean: one row."""
    worst = F.struct(F.col(psi).alias("psi"), F.col("feature").alias("feature"))
    return report.where(F.col(psi).isNotNull()).agg(F.max(worst).alias("w")).select(
        F.coalesce(F.col("w.psi"), F.lit(0.0)).alias("overall_psi"),
        F.col("w.feature").alias("overall_psi_feature"),
    )
