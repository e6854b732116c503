"""The split manifest: built in one pass, read with typed checks, verified in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators.splits import SplitBoundaries, seconds, sixths, split_name

BOUNDARY_TOLERANCE_SECONDS = 1.0
RATE_TOLERANCE_PCT = 0.001
SPLITS = ("train", "val", "stream")
MANIFEST_SCHEMA = (
    "total_rows bigint, total_columns bigint, dt_min double, dt_max double, "
    "boundaries struct<month3_end: double, month4_end: double>, "
    "splits struct<"
    + ", ".join(f"{s}: struct<rows: bigint, fraud_rate_pct: double>" for s in SPLITS) + ">"
)


class ManifestError(ValueError):
    """The manifest is incomplete or contradicts the data."""


def split_statistics(df: DataFrame, time: str, label: str, bounds: SplitBoundaries) -> DataFrame:
    """(split, rows, fraud_rate_pct) in one grouped pass."""
    return df.groupBy(split_name(df, time, bounds).alias("split")).agg(
        F.count("*").alias("rows"),
        F.round(F.avg(label) * 100, 3).alias("fraud_rate_pct"),
    )


def build_manifest(df: DataFrame, time: str, label: str, bounds: SplitBoundaries) -> DataFrame:
    """One nested row describing the splits."""
    split, hit = split_name(df, time, bounds), F.col(label)

    def block(name: str):
        inside = split == name
        return F.struct(
            F.count_if(inside).alias("rows"),
            F.round(F.avg(F.when(inside, hit)) * 100, 3).alias("fraud_rate_pct"),
        ).alias(name)

    t = seconds(df, time)
    return df.agg(
        F.count("*").alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.min(t).alias("dt_min"), F.max(t).alias("dt_max"),
        F.struct(F.lit(bounds.month3_end).alias("month3_end"), F.lit(bounds.month4_end).alias("month4_end"))
        .alias("boundaries"),
        F.struct(*[block(s) for s in SPLITS]).alias("splits"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest file (a byte-order mark is tolerated); missing or mistyped keys are refused."""
    df = spark.read.option("multiLine", True).schema(MANIFEST_SCHEMA).json(path)
    keys = ["total_rows", "dt_min", "dt_max", "boundaries.month3_end", "boundaries.month4_end",
            *[f"splits.{s}.{k}" for s in SPLITS for k in ("rows", "fraud_rate_pct")]]
    row = df.select(*[F.col(k).isNull().alias(k.replace(".", "__")) for k in keys]).first()
    if row is None:
        raise ManifestError("empty manifest")
    absent = [k for k in keys if row[k.replace(".", "__")]]
    if absent:
        raise ManifestError(f"missing or mistyped keys: {absent}")
    return df


def manifest_bounds(manifest: DataFrame) -> SplitBoundaries:
    row = manifest.select("dt_min", "dt_max", "boundaries.*").first()
    return SplitBoundaries(row["dt_min"], row["dt_max"], row["month3_end"], row["month4_end"])


def boundary_checks(manifest: DataFrame) -> DataFrame:
    """One row per rule: does the manifest agree with itself?"""
    c = F.col
    span = c("dt_max") - c("dt_min")

    def near(cut: str, k: int):
        return F.abs(c(f"boundaries.{cut}") - (c("dt_min") + span / 6 * k)) <= BOUNDARY_TOLERANCE_SECONDS

    ordered = (
        (c("dt_min") < c("boundaries.month3_end"))
        & (c("boundaries.month3_end") < c("boundaries.month4_end"))
        & (c("boundaries.month4_end") < c("dt_max"))
    )
    rules = {"span_positive": span > 0, "month3_end_on_sixth": near("month3_end", 3),
             "month4_end_on_sixth": near("month4_end", 4), "strictly_increasing": ordered}
    return manifest.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), ok.alias("holds")) for name, ok in rules.items()
    ])))


def split_identity(manifest: DataFrame, df: DataFrame, time: str, label: str) -> DataFrame:
    """Per split: recorded against observed rows and label rate, and the positives implied."""
    observed = split_statistics(df, time, label, manifest_bounds(manifest))
    recorded = manifest.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("split"), F.col(f"splits.{s}.rows").alias("recorded_rows"),
                 F.col(f"splits.{s}.fraud_rate_pct").alias("recorded_rate_pct")) for s in SPLITS
    ])))
    joined = recorded.join(F.broadcast(observed), "split", "left")
    return joined.select(
        "split", "recorded_rows", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
        "recorded_rate_pct", "fraud_rate_pct",
        S.implied_positives(F.col("recorded_rows"), F.col("recorded_rate_pct")).alias("implied_positives"),
        (F.coalesce("rows", F.lit(0)) == F.col("recorded_rows")).alias("rows_match"),
        F.coalesce(F.abs(F.col("fraud_rate_pct") - F.col("recorded_rate_pct")) <= RATE_TOLERANCE_PCT, F.lit(False))
        .alias("rate_matches"),
    )


def totals_agree(manifest: DataFrame) -> DataFrame:
    total = sum((F.col(f"splits.{s}.rows") for s in SPLITS[1:]), F.col(f"splits.{SPLITS[0]}.rows"))
    return manifest.select(F.col("total_rows"), total.alias("split_rows"), (total == F.col("total_rows")).alias("agree"))


def verify_manifest(manifest: DataFrame, df: DataFrame, time: str, label: str) -> None:
    """Raise on the first contradiction."""
    broken = [r["rule"] for r in boundary_checks(manifest).collect() if not r["holds"]]
    broken += [
        f"{r['split']} rows or rate" for r in split_identity(manifest, df, time, label).collect()
        if not (r["rows_match"] and r["rate_matches"])
    ]
    if not totals_agree(manifest).first()["agree"]:
        broken.append("splits do not sum to the total")
    if broken:
        raise ManifestError(f"manifest contradicts the data: {broken}")


__all__ = [
    "ManifestError", "boundary_checks", "build_manifest", "manifest_bounds", "read_manifest", "sixths",
    "split_identity", "split_statistics", "totals_agree", "verify_manifest",
]
