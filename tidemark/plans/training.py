"""Model fitting: early stopping by average precision, ensembles, sweeps, retrain.

Missing values never reach the trees as NaN: each numeric input is filled below its
fitted minimum and features with gaps get an indicator column. Fits draw rows by hashes of
their keys; only Spark ML's own booster samples by layout, and wants rows laid out before.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import ranking as R
from tidemark.operators.encoding import EncoderModel, FeatureEncoder
from tidemark.operators.splits import RetrainWindow, temporal_holdout
from tidemark.plans.boosting import BoostedTrees, Growth, add_trees, binned
from tidemark.plans.forest import Forest, fit_forest
from tidemark.plans.views import resolve
from tidemark.session import discard, materialise, materialise_at, small_table
from tidemark.sources.tables import RESOLUTION_SCHEMA, TableStore, record_run

PLAUSIBLE_CARVE = 0.15


@dataclass(frozen=True)
class BoostSettings:
    """Fixed values of the fit; a sweep overrides some of them."""

    depth: int = 4
    step: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.6
    ceiling: int = 2_000
    patience: int = 50
    seed: int = 42
    forest_trees: int = 200
    forest_depth: int = 8
    block: int = 25

    def override(self, **changes) -> BoostSettings:
        return replace(self, **changes)


@dataclass(frozen=True)
class TreeInputs:
    """How encoded columns become tree inputs; learned on the fitting slice only."""

    names: tuple[str, ...]
    fill: dict[str, float]
    indicators: tuple[str, ...]

    @staticmethod
    def fit(encoded: DataFrame, names: Iterable[str]) -> TreeInputs:
        names = tuple(names)
        row = encoded.agg(*[F.min(F.col(f"`{n}`").cast("double")).alias(f"low:{n}") for n in names],
                          *[F.count_if(F.col(f"`{n}`").isNull()).alias(f"gaps:{n}") for n in names]).first()
        fill = {n: (row[f"low:{n}"] if row[f"low:{n}"] is not None else 0.0) - 1.0 for n in names}
        return TreeInputs(names, fill, tuple(n for n in names if row[f"gaps:{n}"] > 0))

    @property
    def columns(self) -> list[str]:
        return [*self.names, *[f"{n}__missing" for n in self.indicators]]

    def owner(self) -> list[int]:
        """Position of the feature each input column belongs to."""
        at = {n: i for i, n in enumerate(self.names)}
        return [*range(len(self.names)), *[at[n] for n in self.indicators]]

    def expressions(self) -> list[Column]:
        filled = [F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(self.fill[n])).alias(n) for n in self.names]
        flags = [F.col(f"`{n}`").isNull().cast("double").alias(f"{n}__missing") for n in self.indicators]
        return filled + flags

    def apply(self, encoded: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        keep = list(keep)
        wide = encoded.select(*keep, F.array(*self.expressions()).alias("inputs"),
                              F.struct(*self.expressions()).alias("__x"))
        flat = wide.select(*keep, "inputs", *[F.col(f"__x.`{c}`").alias(f"__{i}") for i, c in enumerate(self.columns)])
        assembler = VectorAssembler(inputCols=[f"__{i}" for i in range(len(self.columns))], outputCol="features")
        return assembler.transform(flat).select(*keep, "inputs", "features")


def fixed_layout(df: DataFrame, key: list[str], partitions: int | None = None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(k) for k in key]).sortWithinPartitions(*key)


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Positives weigh as much in total as negatives do, from this slice alone."""
    weight = R.positive_weight(df, label)
    return df.withColumn("weight", F.when(F.col(label) == 1, weight).otherwise(1.0))


def boosted(settings: BoostSettings, rounds: int) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=settings.depth,
        stepSize=settings.step, subsamplingRate=settings.row_share,
        featureSubsetStrategy=str(settings.column_share), seed=settings.seed,
    )


def fit_cached(estimator, train: DataFrame):
    """Fit over rows kept in memory for the length of the fit; the fit reads them many times."""
    held = train.persist()
    try:
        return estimator.fit(held)
    finally:
        held.unpersist()


def positive_probability(model, df: DataFrame, trees: int | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """(keep..., score); refuses a model that holds another number of trees than validated."""
    if trees is not None and model.getNumTrees != trees:
        raise ValueError(f"model holds {model.getNumTrees} trees, validated with {trees}")
    if isinstance(model, (BoostedTrees, Forest)):
        return model.append(df.select(*keep, "inputs"), "score").select(*keep, "score")
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("score"))


@dataclass(frozen=True)
class StoppedFit:
    model: BoostedTrees
    best_round: int
    history: list[tuple[int, float]] = field(default_factory=list)

    def history_frame(self, spark) -> DataFrame:
        return small_table(spark, [(k, "average_precision", v) for k, v in self.history],
                           "round int, metric string, value double")


def first_best(history: list[tuple[int, float]], patience: int) -> tuple[int, bool]:
    """(best round, stopped?): the first round nothing beat for ``patience`` further rounds."""
    best, score = 0, float("-inf")
    for k, value in history:
        if value > score:
            best, score = k, value
        elif k - best >= patience:
            return best, True
    return best, False


def staged_history(rows: DataFrame, trees: list, start: int) -> tuple[list[tuple[int, float]], DataFrame, str]:
    """Average precision after each of the trees that follow round ``start``, and the rows with their new margin.

    Each of the rows stands for ``n`` equal ones.
    """
    staged, path = materialise_at(add_trees(rows, trees, scores=True), "staged")
    rounds = staged.select("label", "n", F.posexplode("scores").alias("i", "score")).withColumn("round", F.col("i") + start + 1)
    found = R.ranking_metrics(rounds, "score", "label", ["round"], times="n").collect()
    return sorted((r["round"], r["pr_auc"]) for r in found), staged.drop("scores"), path


def fit_early_stopping(fit: DataFrame, stop: DataFrame, settings: BoostSettings) -> StoppedFit:
    """Grow until the stopping slice's average precision rests, then keep the best prefix.

    The booster goes on from the trees it has, a block at a time, and the stopping slice carries
    its margin along: no round is fitted or scored twice. With one class only in the stopping
    slice no round beats another, and none is kept.
    """
    growth, history = Growth.start(fit, settings), []
    rows = binned(stop.select(F.col("label").cast("int").alias("label"), "inputs"), growth.edges, ["label"])
    rows, path = materialise_at(rows.groupBy("label", "bins", "margin").agg(F.count("*").alias("n")), "staged")
    try:
        while len(growth.trees) < settings.ceiling:
            start = len(growth.trees)
            growth.grow(min(settings.block, settings.ceiling - start))
            found, rows, after = staged_history(rows, growth.trees[start:], start)
            discard(fit.sparkSession, path)
            path, history = after, history + [(k, v) for k, v in found if v is not None]
            if first_best(history, settings.patience)[1] or not history:
                break
    finally:
        discard(fit.sparkSession, path)
        growth.close()
    best, stopped = first_best(history, settings.patience)
    if stopped:
        history = history[: best + settings.patience]
    return StoppedFit(growth.model.prefix(best), best, history)


def peak_round(history: DataFrame) -> DataFrame:
    """Where the stopping score peaks; a peak in round 1 means nothing was learned after it."""
    return history.groupBy("metric").agg(
        F.max_by("round", F.struct(F.col("value"), -F.col("round"))).alias("peak_round"), F.max("value").alias("peak_value")
    ).withColumn("peaked_at_once", F.col("peak_round") == 1)


# --- results -----------------------------------------------------------------------------------


def ensemble_summary(scores: DataFrame, first: str, second: str, metrics: DataFrame, times: str | None = None) -> DataFrame:
    """Member correlation, the ensemble's score and its gain over the better member.

    ``metrics`` holds (model, pr_auc) for both members and ``ensemble``. A row of scores counts
    as often as column `times` says, once without one.
    """
    together = F.col("model") == "ensemble"
    block = metrics.agg(
        F.max(F.when(together, F.col("pr_auc"))).alias("ensemble_pr_auc"),
        F.max(F.when(~together, F.col("pr_auc"))).alias("best_single"),
    )
    n = F.lit(1) if times is None else F.col(times)
    known = scores.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(n.alias("n"), F.col(first).alias("x"), F.col(second).alias("y"))
    means = known.agg(*[F.try_divide(F.sum(F.col("n") * F.col(c)), F.sum("n")).alias(f"mean_{c}") for c in "xy"])
    x, y = (F.col(c) - F.col(f"mean_{c}") for c in "xy")
    correlation = known.crossJoin(means).agg(
        F.try_divide(F.sum(F.col("n") * x * y), F.sqrt(F.sum(F.col("n") * x * x) * F.sum(F.col("n") * y * y)))).scalar()
    return block.select(correlation.alias("correlation"), "ensemble_pr_auc",
                        (F.col("ensemble_pr_auc") - F.col("best_single")).alias("gain"))


def side_by_side(metrics: DataFrame) -> DataFrame:
    """(model, val_pr_auc, train_pr_auc, overfit_gap, is_best) from per-slice metrics."""
    def of(slice_name: str) -> Column:
        return F.max(F.when(F.col("slice") == slice_name, F.col("pr_auc")))

    wide = metrics.groupBy("model").agg(of("val").alias("val_pr_auc"), of("train").alias("train_pr_auc"))
    best = wide.agg(F.max_by("model", "val_pr_auc")).scalar()
    return wide.select("model", "val_pr_auc", "train_pr_auc",
                       (F.col("train_pr_auc") - F.col("val_pr_auc")).alias("overfit_gap"),
                       (F.col("model") == best).alias("is_best"))


def attribute_loss(results: DataFrame, probe: str, current: str, bar: float,
                   plausible: float = PLAUSIBLE_CARVE) -> DataFrame:
    """Split a loss against the bar into the carve and early stopping.

    A probe implausibly far from the bar was measured on other data: then nothing is attributed.
    """
    carve = F.col(probe) - bar
    suppressed = F.abs(carve) > plausible
    return results.withColumns({
        "carve_delta": carve,
        "stopping_delta": F.when(~suppressed, F.col(current) - bar - carve),
        "suppressed": suppressed,
    })


@dataclass(frozen=True)
class TrainedBundle:
    encoder: EncoderModel
    inputs: TreeInputs
    boosted: StoppedFit
    forest: Forest
    metrics: DataFrame
    summary: DataFrame


def prepare(encoder: EncoderModel, df: DataFrame, key: list[str], label: str) -> DataFrame:
    keep = [*key, F.col(label).cast("int").alias("label")]
    return encoder.transform(df, keep=keep)


def fit_bundle(fit: DataFrame, stop: DataFrame, evaluation: DataFrame, key: list[str], label: str,
               exclude: Iterable[str], settings: BoostSettings) -> TrainedBundle:
    """Encode on the fitting slice only, fit both members, score every slice in one table."""
    encoder = FeatureEncoder(label, (*key, *exclude)).fit(fit)
    slices = {n: prepare(encoder, df, key, label) for n, df in
              (("train", fit), ("stop", stop), ("val", evaluation))}
    inputs = TreeInputs.fit(slices["train"], encoder.names)
    ready = {n: inputs.apply(df, [*key, "label"]) for n, df in slices.items()}
    train = with_weights(ready["train"]).drop("features").persist()
    held = ready["stop"].select("label", "inputs").persist()
    try:
        stopped = fit_early_stopping(train, held, settings)
        second = fit_forest(train, settings)
        # Rows of equal inputs have equal scores: they are scored once, and count as often as they are there.
        slices = [df.select("label", "inputs", F.lit(n).alias("slice")) for n, df in (("train", train), ("stop", held), ("val", ready["val"]))]
        equal = slices[0].union(slices[1]).union(slices[2]).groupBy("slice", "label", "inputs").agg(F.count("*").alias("n"))
        # Scores are written once: the metric passes below read them several times.
        scores = materialise(score_members(stopped.model, second, equal, stopped.best_round, ["slice", "n"]), "scores")
    finally:
        train.unpersist()
        held.unpersist()
    long = scores.select("slice", "label", "n", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in ("boosted", "forest", "ensemble")
    ])))
    metrics = R.metric_block(long, "score", "label", ["model", "slice"], times="n")
    val = metrics.where(F.col("slice") == "val").select("model", "pr_auc")
    summary = ensemble_summary(scores.where(F.col("slice") == "val"), "boosted", "forest", val, "n")
    return TrainedBundle(encoder, inputs, stopped, second, metrics, summary)


def score_members(first: BoostedTrees, second: Forest, df: DataFrame, trees: int | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """Both members on the same rows: no join, each model appends its own columns."""
    if trees is not None and first.getNumTrees != trees:
        raise ValueError(f"model holds {first.getNumTrees} trees, validated with {trees}")
    keep = list(keep)
    one = second.append(df.select(*keep, "label", "inputs"), "forest")
    both = first.append(one, "boosted").select(*keep, "label", "boosted", "forest")
    return both.withColumn("ensemble", (F.col("boosted") + F.col("forest")) / 2)


def baseline_job(train: DataFrame, val: DataFrame, time: str, key: list[str], label: str, exclude: Iterable[str],
                 settings: BoostSettings, holdout: float = 0.15, store: TableStore | None = None,
                 run_id: str = "baseline", sampled: bool = False) -> TrainedBundle:
    """Carve by time, fit on the earlier part, evaluate on the untouched split, record the run.

    A sampled run is a smoke test: its numbers are never recorded.
    """
    fit, stop, cutoff = temporal_holdout(train, time, holdout)
    bundle = fit_bundle(fit, stop, val, key, label, exclude, settings)
    if store is not None and not sampled:
        record_run(store, run_id, {"carve.cutoff": cutoff, "carve.fraction": holdout,
                                   "n_trees_used": bundle.boosted.best_round}, nested_metrics(bundle.metrics))
    return bundle


def nested_metrics(metrics: DataFrame) -> DataFrame:
    """Per-(model, slice) rows folded into one nested row, so that they flatten to dotted keys."""
    names = [f.name for f in metrics.schema.fields if f.name not in ("model", "slice")]
    pairs = [(m, s) for m in ("boosted", "forest", "ensemble") for s in ("train", "stop", "val")]

    def block(model: str, part: str) -> Column:
        here = (F.col("model") == model) & (F.col("slice") == part)
        return F.struct(*[F.max(F.when(here, F.col(n))).alias(n) for n in names])

    return metrics.agg(*[block(m, s).alias(f"{m}.{s}") for m, s in pairs])


def config_sweep(train: DataFrame, val: DataFrame, time: str, key: list[str], label: str, exclude: Iterable[str],
                 base: BoostSettings, configs: dict[str, dict], bar: float, holdout: float = 0.15) -> DataFrame:
    """Fit every override over one shared encoding; one result row per configuration."""
    fit, stop, _ = temporal_holdout(train, time, holdout)
    encoder = FeatureEncoder(label, (*key, *exclude)).fit(fit)
    encoded = {n: prepare(encoder, d, key, label) for n, d in (("fit", fit), ("stop", stop), ("val", val))}
    inputs = TreeInputs.fit(encoded["fit"], encoder.names)
    ready = with_weights(inputs.apply(encoded["fit"], [*key, "label"])).drop("features").persist()
    held = inputs.apply(encoded["stop"], ["label"]).select("label", "inputs").persist()
    # Rows of equal inputs have equal scores: each configuration scores them once, and they count as often as they are there.
    slices = [df.select("label", "inputs", F.lit(n).alias("slice")) for n, df in (("val", inputs.apply(encoded["val"], ["label"])), ("train", ready))]
    equal, path = materialise_at(slices[0].union(slices[1]).groupBy("slice", "label", "inputs").agg(F.count("*").alias("n")), "equal")
    rows = []
    for name, overrides in configs.items():
        settings = base.override(**overrides)
        stopped = fit_early_stopping(ready, held, settings)
        scored = positive_probability(stopped.model, equal, stopped.best_round, ["slice", "label", "n"])
        by = {r["slice"]: r["pr_auc"] for r in R.ranking_metrics(scored, "score", "label", ["slice"], times="n").collect()}
        rows.append((name, settings.depth, stopped.best_round, by["val"], by["train"]))
    discard(train.sparkSession, path)
    ready.unpersist()
    held.unpersist()
    return sweep_table(small_table(train.sparkSession, rows, "config string, depth int, trees int, val_pr_auc double, train_pr_auc double"), bar)


def sweep_table(results: DataFrame, bar: float) -> DataFrame:
    """Deltas against the bar, and the picks: best score, smallest gap."""
    gap = F.col("train_pr_auc") - F.col("val_pr_auc")
    best = results.agg(F.max_by("config", "val_pr_auc")).scalar()
    tight = results.agg(F.min_by("config", gap)).scalar()
    return results.select(
        "*", gap.alias("gap"), (F.col("val_pr_auc") - bar).alias("vs_bar"),
        (F.col("config") == best).alias("best_score"), (F.col("config") == tight).alias("smallest_gap"))


def trigger_params(alert: DataFrame) -> DataFrame:
    """(key, value) rows carried from the alert onto the run, as stored."""
    from tidemark.functions.scalar import pick_features

    c = F.col
    listed = F.array_join(F.slice("value_drift_feature_list", 1, 20), ",")
    features = F.when(F.size("value_drift_feature_list") > 0, listed).otherwise(pick_features(c("top_features"), "value"))
    fields = {
        "trigger.alert_id": c("id"), "trigger.verdict": c("verdict"),
        "trigger.overall_psi": F.round("overall_psi", 6), "trigger.overall_psi_feature": c("overall_psi_feature"),
        "trigger.value_drift_psi": F.round("value_drift_psi", 6), "trigger.missingness_psi": F.round("missingness_psi", 6),
        "trigger.drifting_features": features, "trigger.window_start_dt": c("window_start_dt"),
        "trigger.window_end_dt": c("window_end_dt"), "trigger.window_rows": c("window_rows"),
    }
    optional = ("created_at", "value_drift_features", "missingness_features", "threshold", "window_label")
    fields |= {f"trigger.{n}": c(n) for n in optional if n in alert.columns}
    return alert.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()
    ])))


class AlertAnsweredError(ValueError):
    """The alert has an answer, or another job is working on one."""


def retrain_job(window: RetrainWindow, alert: DataFrame, key: list[str], label: str, exclude: Iterable[str],
                settings: BoostSettings, store: TableStore, run_id: str, register: bool = True) -> TrainedBundle:
    """Answer one alert: claim it, fit on its window, record why, register a challenger, resolve the alert.

    The claim comes before anything is fitted: of several jobs one goes on, the others are refused
    and leave neither run nor version. A job that fails gives its claim back.
    """
    asked = alert.select("id").first()
    if asked is None:
        raise LookupError("no alert to answer")
    answered = store.read("alert_resolutions", RESOLUTION_SCHEMA).where(F.col("alert_id") == asked["id"])
    claim = f"answers/{asked['id']}"
    if not answered.isEmpty() or not store.claim(claim):
        raise AlertAnsweredError(f"alert {asked['id']} is answered or about to be")
    try:
        return _answer(window, alert, key, label, exclude, settings, store, run_id, register)
    except BaseException:
        store.release(claim)
        raise


def _answer(window: RetrainWindow, alert: DataFrame, key: list[str], label: str, exclude: Iterable[str],
            settings: BoostSettings, store: TableStore, run_id: str, register: bool) -> TrainedBundle:
    from tidemark.plans.registry import Registry

    bundle = fit_bundle(window.fit, window.stop, window.evaluation, key, label, exclude, settings)
    params = {r["key"]: r["value"] for r in trigger_params(alert).collect()}
    params |= {"retrain.window_start_dt": window.start, "retrain.window_end_dt": window.end,
               "retrain.window_rows": window.rows, "n_trees_used": bundle.boosted.best_round}
    record_run(store, run_id, params, nested_metrics(bundle.metrics))
    version = None
    if register:
        version = Registry(store).register(run_id, "Staging", "challenger",
                                           {"trigger_alert_id": str(params["trigger.alert_id"])}, "drift_retrain")
    attempt = alert.select(
        F.col("id").alias("alert_id"), F.current_timestamp().alias("resolved_at"), F.lit(run_id).alias("run_id"),
        F.lit(None if version is None else str(version)).cast("string").alias("model_version"))
    resolve_once(store, attempt)
    return bundle


def resolve_once(store: TableStore, attempt: DataFrame) -> bool:
    """Append the answer to an alert unless one is on record; tells whether it was appended."""
    accepted = resolve(store.read("alert_resolutions", RESOLUTION_SCHEMA), attempt).where("accepted").drop("accepted")
    won = accepted.select(*T.StructType.fromDDL(RESOLUTION_SCHEMA).fieldNames()).collect()
    if won:
        store.append("alert_resolutions", store.spark.createDataFrame(won, RESOLUTION_SCHEMA))
    return bool(won)


def round_trip_error(model: BoostedTrees, df: DataFrame, path: str) -> DataFrame:
    """Largest difference between a model and its reloaded copy over the given rows."""
    model.save(df.sparkSession, path)
    both = BoostedTrees.load(df.sparkSession, path).append(model.append(df.select("inputs"), "one"), "two")
    return both.agg(F.count("*").alias("rows"), F.max(F.abs(F.col("one") - F.col("two"))).alias("max_error")).withColumn(
        "reproduced", F.col("max_error") <= 1e-6)
