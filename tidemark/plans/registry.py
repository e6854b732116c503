"""Model registry as an append-only event table, and the lookups over versions and runs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import GATE_PROMOTE
from tidemark.session import small_table
from tidemark.sources.tables import RUN_SCHEMA, TableStore

EVENT_SCHEMA = "event_id bigint, version bigint, run_id string, kind string, value string"
CHAMPION_ALIASES = ("champion", "staging")
THRESHOLD_KEY = "val.at_best_f1_threshold.threshold"
WINDOW_KEYS = ("retrain.window_start_dt", "retrain.window_end_dt")


class PromotionRefusedError(RuntimeError):
    """The verdict does not promote, or a retrain tried to skip the comparison."""


def registry_state(events: DataFrame) -> DataFrame:
    """Current (version, run_id, stage, aliases, tags): the latest event per subject wins."""
    c = F.col
    versions = events.groupBy("version").agg(
        F.max(F.when(c("kind") == "registered", c("run_id"))).alias("run_id"),
        F.max_by("value", F.when(c("kind") == "stage", c("event_id"))).alias("stage"),
    )
    alias_events = events.where(c("kind").isin("alias_set", "alias_removed"))
    holders = (
        alias_events.groupBy(c("value").alias("alias"))
        .agg(F.max_by(F.struct("version", "kind"), c("event_id")).alias("last"))
        .where(c("last.kind") == "alias_set")
        .groupBy(c("last.version").alias("version"))
        .agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    )
    tags = (
        events.where(c("kind").startswith("tag:")).groupBy("version", F.substring("kind", 5, 1 << 20).alias("tag"))
        .agg(F.max_by("value", "event_id").alias("value"))
        .groupBy("version").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "value")))).alias("tags"))
    )
    none = F.array().cast("array<string>")
    return versions.join(holders, "version", "left").join(tags, "version", "left").select(
        "version", "run_id", F.coalesce("stage", F.lit("None")).alias("stage"),
        F.coalesce("aliases", none).alias("aliases"),
        F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"),
    )


class Registry:
    """Writes registry events; reads are plain queries over them."""

    def __init__(self, store: TableStore, table: str = "model_events"):
        self.store, self.table = store, table

    def events(self) -> DataFrame:
        return self.store.read(self.table, EVENT_SCHEMA)

    def state(self) -> DataFrame:
        return registry_state(self.events())

    def _append(self, rows: list[tuple[int, str | None, str, str]]) -> None:
        last = self.events().agg(F.max("event_id")).first()[0] or 0
        numbered = [(number, *row) for number, row in zip(self.store.take_numbers(self.table, last, len(rows)), rows)]
        self.store.append(self.table, small_table(self.store.spark, numbered, EVENT_SCHEMA))

    def newest_run_id(self) -> str:
        """The run recorded last, by its ``start_time``; runs without one come first."""
        runs = self.store.read("runs", RUN_SCHEMA)
        started = runs.groupBy("run_id").agg(
            F.max(F.when(F.col("key") == "start_time", F.col("value").try_cast("double"))).alias("at"))
        last = started.orderBy(F.desc_nulls_last("at"), F.desc("run_id")).first()
        if last is None:
            raise LookupError("no run has been recorded")
        return last["run_id"]

    def register(self, run_id: str | None = None, stage: str = "Staging", alias: str | None = "challenger",
                 tags: dict[str, str] | None = None, origin: str = "baseline") -> int:
        if origin == "drift_retrain" and stage.lower() == "production":
            raise PromotionRefusedError("a retrain never registers straight to Production")
        run_id = run_id or self.newest_run_id()
        version = self.store.take_numbers("versions", self.events().agg(F.max("version")).first()[0] or 0)[0]
        rows = [(version, run_id, "registered", str(int(time.time()))), (version, run_id, "stage", stage)]
        if alias:
            rows.append((version, run_id, "alias_set", alias))
        rows += [(version, run_id, f"tag:{k}", v) for k, v in {"origin": origin, **(tags or {})}.items()]
        self._append(rows)
        return version

    def promote(self, challenger: int, champion: int | None, verdict: str, tags: dict[str, object] | None = None) -> None:
        if verdict != GATE_PROMOTE:
            raise PromotionRefusedError(verdict)
        self._append(promotion_events(challenger, champion, verdict, tags))


def promotion_events(challenger: int, champion: int | None, verdict: str = GATE_PROMOTE,
                     tags: dict[str, object] | None = None) -> list[tuple[int, str | None, str, str]]:
    """Stage, both aliases, the verdict and what else was measured, and the archived predecessor."""
    rows = [(challenger, None, "stage", "Production"), (challenger, None, "alias_set", "champion"),
            (challenger, None, "alias_set", "staging"), (challenger, None, "alias_removed", "challenger")]
    told = {"shadow_verdict": verdict, **(tags or {})}
    rows += [(challenger, None, f"tag:{k}", str(v)) for k, v in told.items()]
    if champion is not None:
        rows += [(champion, None, "stage", "Archived"), (champion, None, "tag:archived_reason", f"replaced by v{challenger}")]
    return rows


def newest_run(runs: DataFrame, kind: str = "model", start: str = "start_time") -> DataFrame:
    """The run to register by default: the latest start per model."""
    return runs.groupBy(kind).agg(F.max_by("run_id", F.col(start)).alias("run_id"))


def run_values(runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per run with the asked keys as columns (dots become underscores)."""
    return runs.where(F.col("key").isin(*keys)).groupBy("run_id").agg(*[
        F.max(F.when(F.col("key") == k, F.col("value"))).alias(k.replace(".", "_")) for k in keys
    ])


def training_windows(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Each version with the window its own run recorded; NULL where none was."""
    windows = run_values(runs, WINDOW_KEYS)
    return versions.join(windows, "run_id", "left").select(
        "version", "run_id", F.col("retrain_window_start_dt").alias("trained_from"),
        F.col("retrain_window_end_dt").alias("trained_to"),
    )


def thresholds(versions: DataFrame, runs: DataFrame, role_fallback: DataFrame) -> DataFrame:
    """The operating point follows the version; a role's value only fills a gap, and says so.

    ``role_fallback`` is (stage, fallback_threshold).
    """
    own = run_values(runs, (THRESHOLD_KEY,)).withColumnRenamed(THRESHOLD_KEY.replace(".", "_"), "own")
    joined = versions.join(own, "run_id", "left").join(F.broadcast(role_fallback), "stage", "left")
    return joined.select(
        "version", F.coalesce("own", "fallback_threshold").alias("threshold"),
        F.when(F.col("own").isNotNull(), F.concat(F.lit("run "), F.col("run_id")))
        .when(F.col("fallback_threshold").isNotNull(), "role fallback").otherwise("none").alias("threshold_source"),
    )


def resolve_champion(versions: DataFrame, aliases: tuple[str, ...] = CHAMPION_ALIASES) -> DataFrame:
    """The holder of the first alias of the list that anyone holds."""
    held = versions.select("version", "run_id", "stage", F.explode("aliases").alias("alias"))
    priority = F.array_position(F.array(*[F.lit(a) for a in aliases]), F.col("alias"))
    # Where a log still lists several holders, the newest version is taken.
    rank = F.struct(priority.alias("p"), (-F.col("version")).alias("v"))
    return held.where(F.col("alias").isin(*aliases)).agg(
        F.min_by(F.struct("version", "run_id", "stage", "alias"), rank).alias("c")
    ).where(F.col("c").isNotNull()).select("c.*")


def registry_view(versions: DataFrame) -> DataFrame:
    tag = F.col("tags")
    return versions.select(
        "version", "stage", F.array_join("aliases", ", ").alias("aliases"),
        F.coalesce(tag["origin"], F.lit("baseline")).alias("origin"),
        F.coalesce(tag["archived_reason"], tag["promotion_rolled_back"], tag["shadow_verdict"], F.lit("")).alias("note"),
    ).orderBy("version")


def lineage(comparisons: DataFrame, alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Promotion record -> triggering alert -> answering run and version."""
    c = F.col
    cause = alerts.select(c("id").alias("trigger_alert_id"), c("verdict").alias("alert_verdict"), "value_drift_psi")
    answer = resolutions.select(c("alert_id").alias("trigger_alert_id"), "run_id", "model_version")
    return (
        comparisons.select(c("id").alias("comparison_id"), "to_version", "trigger_alert_id", "verdict")
        .join(cause, "trigger_alert_id", "left").join(answer, "trigger_alert_id", "left")
    )


def evidence(comparisons: DataFrame) -> DataFrame:
    """Per version: its newest promoting record, else the latest record naming it on either side."""
    c = F.col
    fields = ["id", "pr_auc", "delta", "rows"]

    def named(version: str, score: str, source: str, rank: int, rows: DataFrame) -> DataFrame:
        return rows.select(
            c(version).alias("version"), F.lit(source).alias("source"), F.lit(rank).alias("rank"), "id",
            c(score).alias("pr_auc"), c("pr_auc_delta").alias("delta"), c("comparison_rows").alias("rows"),
        )

    pool = (
        named("to_version", "challenger_pr_auc", "promotion", 0, comparisons.where(c("verdict") == GATE_PROMOTE))
        .unionByName(named("to_version", "challenger_pr_auc", "challenger", 1, comparisons))
        .unionByName(named("from_version", "champion_pr_auc", "champion", 2, comparisons))
    )
    best = F.max_by(F.struct("source", *fields), F.struct((-c("rank")).alias("r"), c("id"))).alias("e")
    return pool.groupBy("version").agg(best).select("version", "e.*")


def champion_card(versions: DataFrame, runs: DataFrame, alerts: DataFrame) -> DataFrame:
    """The deciding version with the metrics of its own run and the alert behind it."""
    card = run_values(runs, ("val.pr_auc", THRESHOLD_KEY, "trigger.alert_id"))
    champion = resolve_champion(versions)
    cause = alerts.select(F.col("id").cast("double").alias("trigger_alert_id"), F.col("verdict").alias("trigger_verdict"))
    return champion.join(card, "run_id", "left").join(cause, "trigger_alert_id", "left").select(
        "version", "stage", "alias", "run_id", F.col("val_pr_auc").alias("pr_auc"),
        F.col(THRESHOLD_KEY.replace(".", "_")).alias("threshold"),
        "trigger_alert_id", "trigger_verdict",
    )
