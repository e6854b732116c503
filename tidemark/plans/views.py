"""Read-only summaries of the audit, alert, unseen and verdict tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar as S
from tidemark.operators.ordering import ordered_index
from tidemark.operators.splits import moment

#: Ranges of a counting pass, and keys among which the n-th is looked up directly.
KEY_RANGES, LAST_KEYS = 1_024, 10_000


def _axis(df: DataFrame, key: str) -> Column | None:
    """The key as a whole number in the same order; None for types that have none."""
    kind, column = df.schema[key].dataType, F.col(key)
    if isinstance(kind, T.IntegralType):
        return column.cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    return None


def _ranged_key(df: DataFrame, key: str, n: int, axis: Column, whole) -> tuple[object, int]:
    """(n-th newest key, rows that are newer): ranges are counted and the one with the n-th row is cut again.

    Tasks count rows by range and ship at most one row a range: the key column is scanned, never
    shuffled or sorted. The ranges shrink a thousandfold each time, so wherever the keys crowd this ends.
    """
    low, high, inside, newer = whole["low"], whole["high"], whole["present"], 0
    while inside > LAST_KEYS and low < high:
        width = (high - low) // KEY_RANGES + 1
        apart = axis - F.lit(low) if high - low < 1 << 63 else axis.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
        counted = df.where(axis.between(low, high)).groupBy(F.floor(apart.cast("double") / float(width)).alias("r")).agg(
            F.count("*").alias("n"), F.min(axis).alias("low"), F.max(axis).alias("high")).collect()
        for row in sorted(counted, key=lambda r: -r["r"]):
            if newer + row["n"] >= n:
                break
            newer += row["n"]
        low, high, inside = row["low"], row["high"], row["n"]
    for row in df.where(axis.between(low, high)).groupBy(key).count().orderBy(F.desc(key)).collect():
        if newer + row["count"] >= n:
            return row[key], newer
        newer += row["count"]
    raise RuntimeError("the table changed while it was counted")


def newest_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The newest ``n`` rows by ``key``, exactly ``n`` where there are so many; NULL keys are oldest.

    Whole numbers, dates and timestamps are counted by range, other keys numbered over range
    partitions. The n-th key then cuts the table by a filter in its own type, and of the rows tied with it
    as many stay as are missing.
    """
    if n <= 0:
        return df.limit(0)
    axis = _axis(df, key)
    if axis is None:
        at = ordered_index(df.select(key), [F.desc(key)], output="__newest").where(F.col("__newest") == n - 1).first()
        if at is None:
            return df
        value, newer_rows = at[key], None
    else:
        whole = df.agg(F.count("*").alias("rows"), F.count(key).alias("present"), F.min(axis).alias("low"), F.max(axis).alias("high")).first()
        if whole["rows"] <= n:
            return df
        value, newer_rows = (None, whole["present"]) if whole["present"] < n else _ranged_key(df, key, n, axis, whole)
    if value is None:
        newer, ties = df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())
    else:
        bound = F.lit(value).cast(df.schema[key].dataType)
        newer, ties = df.where(F.col(key) > bound), df.where(F.col(key) == bound)
    missing = n - (newer.count() if newer_rows is None else newer_rows)
    tied = ties.orderBy(F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]))
    return newer.unionByName(tied.limit(missing))


def since(df: DataFrame, time: str, start: float | None) -> DataFrame:
    return df if start is None else df.where(F.col(time) >= moment(df, time, start))


def live(last_scored: Column, now: Column, within: float = S.LIVE_WITHIN_SECONDS) -> Column:
    """Was the newest row scored less than ``within`` seconds before ``now`` (both in seconds)?"""
    return F.coalesce(now - last_scored < within, F.lit(False))


def _usable(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("challenger_probability").isNotNull() & F.col("true_label").isNotNull())


def newest_pair(audit: DataFrame) -> DataFrame:
    """The champion and challenger of the newest row both scored and labelled."""
    pair = F.max_by(F.struct("model_version", "challenger_version"), F.col("id")).alias("pair")
    return _usable(audit).agg(pair).where(F.col("pair").isNotNull()).select("pair.*")


def paired_rows(audit: DataFrame, champion: str | None = None, challenger: str | None = None,
                limit: int | None = None) -> DataFrame:
    """Jointly scored, labelled rows of one pair; the pair becomes a pushed-down filter."""
    if champion is None or challenger is None:
        newest = newest_pair(audit).first()
        if newest is None:
            return _usable(audit).limit(0)
        champion = champion or newest["model_version"]
        challenger = challenger or newest["challenger_version"]
    rows = _usable(audit).where(
        (F.col("model_version") == champion) & (F.col("challenger_version") == challenger)
    )
    return rows if limit is None else newest_rows(rows, "id", limit)


def flagged_or_ranked(df: DataFrame, score: str, threshold: float, tie: list[str], n: int) -> DataFrame:
    """The highest-scoring flagged rows, or of all rows when none clears the threshold."""
    flagged = df.where(F.col(score) >= threshold)
    pool = df if flagged.isEmpty() else flagged
    return pool.orderBy(F.desc(score), *[F.asc(t) for t in tie]).limit(n)


# --- serving ---------------------------------------------------------------------------


def scoring_summary(audit: DataFrame) -> DataFrame:
    """Totals, rates, span and mean throughput of the audit table, one pass."""
    t = S.epoch_seconds(F.col("scored_at"))
    sums = audit.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("decision") == "BLOCK").alias("blocked"),
        F.count_if(F.size("unseen_categories") > 0).alias("with_unseen"),
        F.count_if(F.col("challenger_probability").isNotNull()).alias("shadowed"),
        F.min(t).alias("first_scored"), F.max(t).alias("last_scored"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )
    rows = F.col("rows").cast("double")
    span = F.col("last_scored") - F.col("first_scored")
    return sums.select(
        "*",
        F.try_divide(F.col("blocked").cast("double"), rows).alias("flag_rate"),
        F.try_divide(F.col("with_unseen").cast("double"), rows).alias("unseen_rate"),
        F.when(span > 0, rows / span).alias("throughput_per_s"),
    )


def rows_by_version(audit: DataFrame) -> DataFrame:
    return audit.groupBy("model_version").agg(
        F.count("*").alias("rows"), F.count_if(F.col("decision") == "BLOCK").alias("blocked")
    ).orderBy(F.desc("rows"), "model_version")


def recent_buckets(audit: DataFrame, newest: int = 500, width: str = "10 seconds") -> DataFrame:
    """Tumbling buckets of scored and blocked over the newest rows; empty ones do not appear."""
    return (
        newest_rows(audit, "id", newest)
        .groupBy(F.window("scored_at", width).alias("w"))
        .agg(F.count("*").alias("scored"), F.count_if(F.col("decision") == "BLOCK").alias("blocked"))
        .select(S.epoch_seconds(F.col("w.start")).alias("bucket_start"), "scored", "blocked")
    )


def run_statistics(audit: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What a scoring run reports: decisions, unseen rows, shadow coverage, disagreements."""
    shadow = F.col("challenger_probability").isNotNull()
    sums = audit.groupBy(*by).agg(
        F.count("*").alias("scored"),
        F.count_if(F.col("decision") == "BLOCK").alias("blocked"),
        F.count_if(F.col("decision") == "ALLOW").alias("allowed"),
        F.count_if(F.size("unseen_categories") > 0).alias("unseen_rows"),
        F.count_if(shadow).alias("shadow_scored"),
        F.count_if(shadow & (F.col("decision") != F.col("challenger_decision"))).alias("disagreements"),
    )
    return sums.withColumn(
        "disagreement_pct",
        F.coalesce(F.try_divide(F.lit(100.0) * F.col("disagreements"), F.col("shadow_scored").cast("double")), F.lit(0.0)),
    )


def scoring_activity(audit: DataFrame, now: Column) -> DataFrame:
    """Totals with the live flag, beside the per-version breakdown, as (metric, key, value) rows."""
    summary = scoring_summary(audit).withColumn("live", live(F.col("last_scored"), now).cast("double"))
    names = [c for c in summary.columns if c not in ("first_scored", "last_scored")]
    totals = summary.select(F.inline(F.array(*[
        F.struct(F.lit("total").alias("metric"), F.lit(n).alias("key"), F.col(n).cast("double").alias("value"))
        for n in names
    ])))
    versions = rows_by_version(audit).select(
        F.inline(F.array(*[
            F.struct(F.lit(f"version.{n}").alias("metric"), F.col("model_version").alias("key"),
                     F.col(n).cast("double").alias("value")) for n in ("rows", "blocked")
        ]))
    )
    buckets = recent_buckets(audit).agg(
        F.count("*").alias("buckets"), F.max("scored").alias("busiest")
    ).select(F.inline(F.array(*[
        F.struct(F.lit("recent").alias("metric"), F.lit(n).alias("key"), F.col(n).cast("double").alias("value"))
        for n in ("buckets", "busiest")
    ])))
    return totals.unionByName(versions).unionByName(buckets)


# --- unseen levels -----------------------------------------------------------------------


def unseen_by_feature(observations: DataFrame, start: float | None = None) -> DataFrame:
    """Per feature: distinct values, occurrences, first and last sight; worst first."""
    rows = since(observations, "observed_at", start)
    # Values are folded first, so the distinct count is a plain count of folded rows.
    per_value = rows.groupBy("feature", "value").agg(
        F.sum("occurrences").alias("n"), F.min("observed_at").alias("a"), F.max("observed_at").alias("b")
    )
    return per_value.groupBy("feature").agg(
        F.count("*").alias("distinct_values"), F.sum("n").alias("occurrences"),
        F.min("a").alias("first_seen"), F.max("b").alias("last_seen"),
    ).orderBy(F.desc("occurrences"), "feature")


def top_values(observations: DataFrame, k: int = 5, salts: int = 32) -> DataFrame:
    """(feature, value, n, position): the most frequent values per feature.

    Ranked in two steps, so a feature with very many values is cut down in parallel first.
    """
    counts = observations.groupBy("feature", "value").agg(F.sum("occurrences").alias("n"))
    order = [F.desc("n"), F.asc("value")]
    salted = counts.withColumn("__salt", F.pmod(F.xxhash64("value"), F.lit(salts)))
    first = Window.partitionBy("feature", "__salt").orderBy(*order)
    kept = salted.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k)
    final = Window.partitionBy("feature").orderBy(*order)
    return (
        kept.withColumn("position", F.row_number().over(final)).where(F.col("position") <= k)
        .select("feature", "value", "n", F.col("position").cast("bigint").alias("position"))
    )


def unseen_summary(observations: DataFrame, start: float | None = None) -> DataFrame:
    """The per-feature aggregate with its example values as one text."""
    ranked = top_values(observations).groupBy("feature").agg(
        F.sort_array(F.collect_list(F.struct("position", "value", "n"))).alias("top_values")
    )
    return unseen_by_feature(observations, start).join(ranked, "feature", "left").withColumn(
        "examples", S.examples_text(F.col("top_values"))
    )


def unseen_totals(observations: DataFrame) -> DataFrame:
    by_feature = unseen_by_feature(observations)
    return by_feature.agg(
        F.count("*").alias("features"), F.sum("occurrences").alias("observations"),
        F.sum("distinct_values").alias("distinct_levels"),
        F.max_by("feature", F.col("occurrences")).alias("worst_feature"),
    )


# --- alerts --------------------------------------------------------------------------------


def open_triggers(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Retrain triggers nobody has answered, oldest first."""
    answered = resolutions.select(F.col("alert_id").alias("id"))
    return alerts.where("retrain_triggered").join(answered, "id", "left_anti").orderBy("id")


def latest_trigger(alerts: DataFrame, resolutions: DataFrame, include_resolved: bool = False) -> DataFrame:
    rows = alerts.where("retrain_triggered") if include_resolved else open_triggers(alerts, resolutions)
    return rows.orderBy(F.desc("id")).limit(1)


def retrain_due(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """One row: is a trigger open, and which is the newest?"""
    return open_triggers(alerts, resolutions).agg(
        (F.count("*") > 0).alias("due"), F.count("*").alias("open_triggers"), F.max("id").alias("alert_id")
    )


def resolve(resolutions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Compare-and-set over the append-only log: the first answer to an alert wins.

    ``attempts`` (alert_id, resolved_at or resolved_s, run_id, model_version) come back with ``accepted``.
    """
    at = "resolved_at" if "resolved_at" in attempts.columns else "resolved_s"
    seen = resolutions.select("alert_id").distinct().withColumn("known", F.lit(True))
    first = attempts.groupBy("alert_id").agg(F.min(F.struct(at, "run_id")).alias("first"))
    return (
        attempts.join(first, "alert_id").join(seen, "alert_id", "left")
        .withColumn("accepted", F.col("known").isNull() & (F.struct(at, "run_id") == F.col("first")))
        .drop("known", "first")
    )


def alert_history(alerts: DataFrame) -> DataFrame:
    """The two drift series side by side; stored alerts have ``created_at`` instead of ``created_s``."""
    if "created_s" not in alerts.columns:
        alerts = alerts.withColumn("created_s", S.epoch_seconds(F.col("created_at")))
    return alerts.select(
        "id", "created_s", "value_drift_psi", "missingness_psi", "verdict", "retrain_triggered"
    ).orderBy("id")


def latest_alert(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The newest alert, whether its trigger is still open, and the version that answered it."""
    newest = alerts.orderBy(F.desc("id")).limit(1)
    answers = resolutions.select(F.col("alert_id").alias("id"), F.col("model_version").alias("answered_by"))
    return newest.join(answers, "id", "left").withColumn(
        "open_trigger", F.col("retrain_triggered") & F.col("answered_by").isNull()
    )


# --- verdict records --------------------------------------------------------------------------


def promotion_history(comparisons: DataFrame, versions: DataFrame) -> DataFrame:
    """Verdict records and registry-tag records in one list, each classified."""
    c = F.col

    def v(name: str) -> Column:
        return F.concat(F.lit("v"), c(name))

    records = comparisons.select(
        v("to_version").alias("version"),
        F.coalesce(v("from_version"), F.lit("")).alias("from_version"),
        "verdict", "pr_auc_delta", c("margin_in_ses").alias("margin_ses"),
        c("comparison_rows").cast("bigint").alias("rows"), F.lit("model_promotions").alias("source"),
    )
    tags = versions.where(c("tags")["shadow_verdict"].isNotNull()).select(
        F.concat(F.lit("v"), c("version").cast("string")).alias("version"),
        F.lit("").alias("from_version"),
        c("tags")["shadow_verdict"].alias("verdict"),
        c("tags")["shadow_pr_auc_delta"].try_cast("double").alias("pr_auc_delta"),
        F.lit(None).cast("double").alias("margin_ses"),
        F.coalesce(c("tags")["shadow_rows"].try_cast("bigint"), F.lit(0)).alias("rows"),
        F.lit("registry tags").alias("source"),
    )
    return records.unionByName(tags).withColumn("outcome", S.verdict_outcome(c("verdict")))


def outcome_counts(history: DataFrame) -> DataFrame:
    promoted = F.when(F.col("outcome") == "promoted", "promoted").otherwise("declined")
    return history.groupBy("outcome", promoted.alias("side")).agg(F.count("*").alias("n"))
