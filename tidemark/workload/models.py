"""Model queries: boosting, forests, early stopping, attribution, retraining.

Fits are not expressible in SQL; their SQL twins state what must hold of the result
(rows scored, bounds, additivity, reproduction) on the same tables.
"""

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import ranking as R
from tidemark.operators.encoding import FeatureEncoder
from tidemark.operators.splits import recent_training_window, temporal_holdout
from tidemark.plans import explain as XP
from tidemark.plans import training as TR
from tidemark.plans.boosting import Growth
from tidemark.plans.trees import attributions
from tidemark.plans.views import latest_trigger
from tidemark.session import materialise, scratch_path, small_table
from tidemark.sources.tables import RUN_SCHEMA, TableStore
from tidemark.workload.base import query, r6, table
from tidemark.workload.fixtures import (
    DRIFT_KEY,
    DRIFT_SQL,
    alerts_view,
    drift_view,
    line_bounds,
    resolutions_view,
)

SETTINGS = TR.BoostSettings()
#: Rounds of the models that are only scored, explained and saved; early stopping chooses its own.
ROUNDS = 25
DROPPED = ["split", "l_shipdate", "f_const", "source"]
TRAIN = "WITH " + DRIFT_SQL


def _slices(spark, sf_dir):
    bounds = line_bounds(spark, sf_dir)
    train, val = (drift_view(spark, sf_dir, s, bounds).drop(*DROPPED) for s in ("train", "val"))
    fit, stop, _ = temporal_holdout(train, "dt", 0.15)
    return fit, stop, val


def _inputs(spark, sf_dir):
    """Fits draw rows by hashes of their keys, so no shuffle lays them out."""
    fit, stop, val = _slices(spark, sf_dir)
    encoder = FeatureEncoder("label", tuple(DRIFT_KEY)).fit(fit)
    encoded = [TR.prepare(encoder, df, DRIFT_KEY, "label") for df in (fit, stop, val)]
    inputs = TR.TreeInputs.fit(encoded[0], encoder.names)
    ready = [inputs.apply(df, [*DRIFT_KEY, "label"]) for df in encoded]
    train = TR.with_weights(ready[0])
    return encoder, inputs, train.drop("features"), ready[1], ready[2]


def _grown(train, rounds=ROUNDS):
    growth = Growth.start(train, SETTINGS).grow(rounds)
    growth.close()
    return growth.model


def _boosted(spark, sf_dir, rounds=ROUNDS):
    encoder, inputs, train, _, val = _inputs(spark, sf_dir)
    held = train.persist()
    model = _grown(held, rounds)
    held.unpersist()
    return encoder, inputs, model, val


_shared: dict[tuple, object] = {}


def _once(spark, sf_dir, name, make):
    """Fitted models are small; queries of one session over one folder share them."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def _stopped(spark, sf_dir):
    def fit():
        _, _, train, stop, _ = _inputs(spark, sf_dir)
        held = [train.persist(), stop.select("label", "inputs").persist()]
        try:
            return TR.fit_early_stopping(*held, SETTINGS)
        finally:
            for df in held:
                df.unpersist()

    return _once(spark, sf_dir, "stopped", fit)


VAL_ROWS = TRAIN + "SELECT count(*) AS rows, count(*) AS in_unit_interval, TRUE AS beats_floor FROM drift WHERE split = 'val'"


def _fit_check(model, val):
    """Rows of equal inputs have equal scores: they are scored once, and count as often as they are there."""
    equal = val.groupBy("label", "inputs").agg(F.count("*").alias("n"))
    scored = materialise(TR.positive_probability(model, equal, keep=["label", "n"]), "scores")
    metrics = R.ranking_metrics(scored, "score", "label", times="n")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = scored.agg(count("n").alias("rows"), count(F.when(F.col("score").between(0, 1), F.col("n"))).alias("in_unit_interval"))
    beats = metrics.select(F.col("pr_auc") > F.col("floor")).scalar()
    return rows.withColumn("beats_floor", beats)


@query("mdl_1_boosted_trees", VAL_ROWS)
def boosted_trees(spark, sf_dir):
    _, _, model, val = _boosted(spark, sf_dir)
    return _fit_check(model, val)


CARVE = TRAIN.rstrip() + """,
cut85 AS (SELECT quantile_cont(dt, 0.85) AS cut FROM drift WHERE split = 'train'),
fit AS (SELECT drift.* FROM drift, cut85 WHERE split = 'train' AND dt < cut),
stop AS (SELECT drift.* FROM drift, cut85 WHERE split = 'train' AND dt >= cut)"""


def _codes(name: str) -> str:
    levels = f"(SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT {name}::VARCHAR AS level FROM fit WHERE {name} IS NOT NULL))"
    return f"SELECT '{name}' AS feature, coalesce(code, -1)::DOUBLE AS x, label FROM fit LEFT JOIN {levels} ON {name}::VARCHAR = level"


_LONG = " UNION ALL ".join(
    [f"SELECT '{n}' AS feature, coalesce({n}::DOUBLE, (SELECT min({n}) FROM fit) - 1) AS x, label FROM fit" for n in ("f_value", "f_cover", "f_stable")]
    + [_codes(n) for n in ("f_cat", "f_catmiss", "f_bool")]
    + [f"SELECT '{n}__missing', ({n} IS NULL)::INT::DOUBLE, label FROM fit" for n in ("f_cover", "f_catmiss")])


@query("mdl_1_first_cuts", CARVE + f""",
long AS ({_LONG}),
w AS (SELECT sum(1 - label) / sum(label) AS w FROM fit),
sums AS (SELECT feature, x, sum(CASE WHEN label = 1 THEN -0.5 * w ELSE 0.5 END) AS g, sum(CASE WHEN label = 1 THEN 0.25 * w ELSE 0.25 END) AS h FROM long, w GROUP BY ALL),
total AS (SELECT feature, sum(g) AS g, sum(h) AS h FROM sums GROUP BY ALL),
edges AS (SELECT feature, unnest(list_distinct(quantile_cont(x, [{', '.join(f'{k}/64' for k in range(1, 64))}]))) AS e FROM long GROUP BY feature),
sides AS (SELECT s.feature, e, sum(s.g) AS gl, sum(s.h) AS hl FROM sums s JOIN edges t ON s.feature = t.feature AND s.x <= e GROUP BY ALL),
gains AS (SELECT feature, e, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM sides JOIN total USING (feature) WHERE hl >= 1 AND h - hl >= 1)
SELECT feature, round(arg_max(e, gain), 6) AS threshold, round(max(gain), 3) AS gain FROM gains GROUP BY feature HAVING max(gain) > 0.001""")
def first_cuts(spark, sf_dir):
    """The best cut of every input for the first tree, and its gain, as the summed histograms have them."""
    _, inputs, train, _, _ = _inputs(spark, sf_dir)
    held = train.persist()
    growth = Growth.start(held, SETTINGS)
    rows = [(inputs.columns[r["feature"]], float(growth.edges[r["feature"]][r["cut"]]), r["gain"]) for r in growth.root_cuts() if r["gain"] > 0.001]
    growth.close()
    held.unpersist()
    return small_table(spark, rows, "feature string, threshold double, gain double").select("feature", r6("threshold").alias("threshold"), F.round("gain", 3).alias("gain"))


@query("mdl_2_forest", VAL_ROWS)
def forest(spark, sf_dir):
    _, _, train, _, val = _inputs(spark, sf_dir)
    held = train.persist()
    model = TR.fit_forest(held, SETTINGS)
    held.unpersist()
    return _fit_check(model, val)


@query("mdl_3_early_stopping")
def early_stopping(spark, sf_dir):
    """Rounds scored on the stopping slice, and the round that was kept."""
    stopped = _stopped(spark, sf_dir)
    return stopped.history_frame(spark).select(
        F.col("round").cast("bigint").alias("round"), r6("value").alias("average_precision"),
        (F.col("round") == stopped.best_round).alias("kept"), F.lit(stopped.model.getNumTrees).cast("bigint").alias("trees"))


@query("mdl_3_stopping_rule", CARVE + """
SELECT count(*) AS stop_rows, sum(label)::BIGINT AS stop_positives, TRUE AS first_best, TRUE AS rested, TRUE AS trees_kept, TRUE AS rescored FROM stop""")
def stopping_rule(spark, sf_dir):
    """The kept round is the first best one, patience ran out after it, and its score comes again from the raw inputs."""
    stopped = _stopped(spark, sf_dir)
    _, _, _, stop, _ = _inputs(spark, sf_dir)
    again = R.ranking_metrics(TR.positive_probability(stopped.model, stop, stopped.best_round, ["label"]), "score", "label")
    history = stopped.history_frame(spark)
    top = history.agg(F.max("value")).scalar()
    facts = history.agg(
        (F.min(F.when(F.col("value") == top, F.col("round"))) == stopped.best_round).alias("first_best"),
        ((F.max("round") == stopped.best_round + SETTINGS.patience) | (F.max("round") == SETTINGS.ceiling)).alias("rested"),
        F.lit(stopped.model.getNumTrees == stopped.best_round).alias("trees_kept"),
        F.max(F.when(F.col("round") == stopped.best_round, F.col("value"))).alias("value"))
    return again.crossJoin(facts).select(
        F.col("rows").alias("stop_rows"), F.col("positives").alias("stop_positives"), "first_best", "rested", "trees_kept",
        (F.abs(F.col("pr_auc") - F.col("value")) < 1e-9).alias("rescored"))


@query("mdl_16_round_history")
def round_history(spark, sf_dir):
    return TR.peak_round(_stopped(spark, sf_dir).history_frame(spark)).withColumn("peak_value", r6("peak_value"))


@query("mdl_16_peak_is_kept", "SELECT 'average_precision' AS metric, TRUE AS consecutive, TRUE AS peak_is_kept, TRUE AS flag_agrees")
def peak_is_kept(spark, sf_dir):
    """Every round has one score, and the peak of the history is the round that early stopping kept."""
    stopped = _stopped(spark, sf_dir)
    history = stopped.history_frame(spark)
    counted = history.groupBy("metric").agg(((F.count("*") == F.max("round")) & (F.count_distinct("round") == F.max("round"))).alias("consecutive"))
    return TR.peak_round(history).join(counted, "metric").select(
        "metric", "consecutive", (F.col("peak_round") == stopped.best_round).alias("peak_is_kept"),
        (F.col("peaked_at_once") == (F.col("peak_round") == 1)).alias("flag_agrees"))


@query("mdl_4_bounded_probability", TRAIN + f"SELECT count(*) AS rows, count(*) AS in_unit_interval, {ROUNDS}::BIGINT AS trees FROM drift WHERE split = 'val'")
def bounded_probability(spark, sf_dir):
    _, _, model, val = _boosted(spark, sf_dir)
    scored = TR.positive_probability(model, val, trees=ROUNDS)
    return scored.agg(F.count("*").alias("rows"), F.count_if(F.col("score").between(0, 1)).alias("in_unit_interval"),
                      F.lit(model.getNumTrees).cast("bigint").alias("trees"))


def _sweep(spark, sf_dir):
    def fit():
        bounds = line_bounds(spark, sf_dir)
        train, val = (drift_view(spark, sf_dir, s, bounds).drop(*DROPPED) for s in ("train", "val"))
        return TR.config_sweep(train, val, "dt", DRIFT_KEY, "label", [], SETTINGS, {"base": {}, "shallow": {"depth": 2}}, bar=0.5)

    return _once(spark, sf_dir, "sweep", fit)


@query("mdl_8_config_sweep")
def config_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir).select("config", "depth", "trees", *[r6(c).alias(c) for c in ("val_pr_auc", "train_pr_auc", "gap", "vs_bar")],
                                        "best_score", "smallest_gap")


@query("mdl_8_sweep_adds_up", "SELECT 'base' AS config, 4 AS depth, TRUE AS deltas, TRUE AS picks UNION ALL SELECT 'shallow', 2, TRUE, TRUE")
def sweep_adds_up(spark, sf_dir):
    """Deltas follow from the scores, and each pick is the one the scores name."""
    rows = _sweep(spark, sf_dir)
    ends = rows.agg(F.max("val_pr_auc").alias("top"), F.min("gap").alias("least"))
    return rows.crossJoin(ends).select(
        "config", "depth", ((F.col("gap") == F.col("train_pr_auc") - F.col("val_pr_auc")) & (F.col("vs_bar") == F.col("val_pr_auc") - 0.5)).alias("deltas"),
        ((F.col("best_score") == (F.col("val_pr_auc") == F.col("top"))) & (F.col("smallest_gap") == (F.col("gap") == F.col("least")))).alias("picks"))


def _attributed(spark, sf_dir):
    encoder, inputs, model, val = _boosted(spark, sf_dir)
    rows = attributions(model.tables(), model.append(val.drop("features"), "score"), inputs.owner(), [*DRIFT_KEY, "score"])
    return encoder, inputs, model, val, rows


@query("mdl_10_attribution", TRAIN + "SELECT count(*) AS rows, count(*) * 6 AS contributions, count(*) AS matching FROM drift WHERE split = 'val'")
def attribution(spark, sf_dir):
    """One contribution per row and feature; the attributed probability is the model's own."""
    rows = _attributed(spark, sf_dir)[-1]
    return rows.agg(F.count("*").alias("rows"), F.sum(F.size("phi")).alias("contributions"),
                    F.count_if(F.abs(F.col("score") - F.col("probability")) < 1e-9).alias("matching"))


@query("mdl_11_additivity", TRAIN + "SELECT count(*) AS rows, TRUE AS additive FROM drift WHERE split = 'val'")
def additivity(spark, sf_dir):
    rows = _attributed(spark, sf_dir)[-1]
    return XP.additivity(rows, "score").select("rows", "additive")


def _breakdown(spark, sf_dir):
    _, inputs, _, _, rows = _attributed(spark, sf_dir)
    from tidemark.plans.views import flagged_or_ranked

    top = flagged_or_ranked(rows, "probability", 0.5, DRIFT_KEY, 10)
    return XP.breakdown(top, list(inputs.names), {}, DRIFT_KEY, 3, 0.5)


@query("mdl_12_breakdown")
def breakdown(spark, sf_dir):
    """The highest-scoring decisions, line by line."""
    return _breakdown(spark, sf_dir).withColumns({"contribution": r6("contribution"), "probability": r6("probability")})


@query("mdl_12_breakdown_adds_up", "SELECT 10::BIGINT AS decisions, 60::BIGINT AS lines, TRUE AS adds_up, TRUE AS margin_is_score, TRUE AS ordered, TRUE AS decided")
def breakdown_adds_up(spark, sf_dir):
    """Base, shown factors and remainder give the margin, the margin gives the probability, and the factors are in order."""
    lines = _breakdown(spark, sf_dir)
    one = lambda p: F.max(F.when(F.col("position") == p, F.col("contribution")))
    by = lines.groupBy(*DRIFT_KEY, "probability", "decision").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("position") < 5, F.col("contribution"))).alias("total"), one(5).alias("margin"),
        *[F.abs(one(p)).alias(f"c{p}") for p in (1, 2, 3)])
    return by.agg(
        F.count("*").alias("decisions"), F.sum("n").alias("lines"), F.bool_and(F.abs(F.col("total") - F.col("margin")) < 1e-9).alias("adds_up"),
        F.bool_and(F.abs(S.sigmoid(F.col("margin")) - F.col("probability")) < 1e-9).alias("margin_is_score"),
        F.bool_and((F.col("c1") >= F.col("c2")) & (F.col("c2") >= F.col("c3"))).alias("ordered"),
        F.bool_and((F.col("decision") == "BLOCK") == (F.col("probability") >= 0.5)).alias("decided"))


@query("mdl_15_round_trip", TRAIN + "SELECT count(*) AS rows, TRUE AS reproduced FROM drift WHERE split = 'val'")
def round_trip(spark, sf_dir):
    _, _, model, val = _boosted(spark, sf_dir)
    return TR.round_trip_error(model, val, scratch_path(spark, "model")).select("rows", "reproduced")


@query("mdl_17_baseline_job", TRAIN + """
SELECT model, CASE WHEN split = 'val' THEN 'val' WHEN dt < cut THEN 'train' ELSE 'stop' END AS slice, count(*) AS rows, sum(label)::BIGINT AS positives
FROM drift, (SELECT quantile_cont(dt, 0.85) AS cut FROM drift WHERE split = 'train'), (VALUES ('boosted'), ('forest'), ('ensemble')) m(model)
WHERE split <> 'stream' GROUP BY 1, 2""")
def baseline_job(spark, sf_dir):
    bounds = line_bounds(spark, sf_dir)
    train, val = (drift_view(spark, sf_dir, s, bounds).drop(*DROPPED) for s in ("train", "val"))
    store = TableStore(spark, scratch_path(spark, "baseline"))
    bundle = TR.baseline_job(train, val, "dt", DRIFT_KEY, "label", [], SETTINGS, store=store)
    return bundle.metrics.select("model", "slice", "rows", "positives")


@query("mdl_13_retrain_job")
def retrain_job(spark, sf_dir):
    """The newest open trigger answered end to end; the recorded run comes back."""
    bounds = line_bounds(spark, sf_dir)
    sources = {s: drift_view(spark, sf_dir, s, bounds).drop("split", "l_shipdate", "f_const") for s in ("val", "stream")}
    window = recent_training_window(sources, "dt", 600)
    alert = latest_trigger(alerts_view(spark, sf_dir), resolutions_view(spark, sf_dir)).withColumn(
        "top_features", F.array().cast("array<struct<feature:string,type:string>>"))
    store = TableStore(spark, scratch_path(spark, "retrain"))
    TR.retrain_job(window, alert, DRIFT_KEY, "label", ["source"], SETTINGS, store, "run-answer")
    return store.read("runs", RUN_SCHEMA).groupBy("run_id", "kind").agg(F.count("*").alias("entries"))


#: The loop query is about what is recorded and refused, so it fits few trees.
LOOP_SETTINGS = SETTINGS.override(ceiling=5, forest_trees=5, forest_depth=4)


@query("mdl_13_monitor_to_refused_retrain", TRAIN + """
SELECT (SELECT count(*) FROM drift WHERE split = 'stream') AS window_rows, 1::BIGINT AS alert_id, TRUE AS triggered, 1::BIGINT AS runs,
  '1' AS answered_by, 'Staging' AS stage, 'challenger' AS aliases, '1' AS trigger_alert, TRUE AS second_refused, 1::BIGINT AS resolutions, 0::BIGINT AS open_triggers""")
def monitor_to_refused_retrain(spark, sf_dir):
    """Monitor, alert, retrain, version and resolution on stored tables; a second retrain of the alert is refused before it fits."""
    from tidemark.plans import monitor as MO
    from tidemark.plans.registry import Registry
    from tidemark.plans.views import open_triggers
    from tidemark.sources.tables import ALERT_SCHEMA, RESOLUTION_SCHEMA

    bounds = line_bounds(spark, sf_dir)
    store = TableStore(spark, scratch_path(spark, "loop"))
    train, stream = (drift_view(spark, sf_dir, s, bounds).drop(*DROPPED) for s in ("train", "stream"))
    number = MO.record_monitor(store, MO.run_monitor(train, stream, "dt", [*DRIFT_KEY, "label"], window_days=100_000.0))
    alert = latest_trigger(store.read("drift_alerts", ALERT_SCHEMA), store.read("alert_resolutions", RESOLUTION_SCHEMA))
    sources = {s: drift_view(spark, sf_dir, s, bounds).drop("split", "l_shipdate", "f_const") for s in ("val", "stream")}
    window = recent_training_window(sources, "dt", 600)
    TR.retrain_job(window, alert, DRIFT_KEY, "label", ["source"], LOOP_SETTINGS, store, "run-1")
    refused = False
    try:
        again = latest_trigger(store.read("drift_alerts", ALERT_SCHEMA), store.read("alert_resolutions", RESOLUTION_SCHEMA), include_resolved=True)
        TR.retrain_job(window, again, DRIFT_KEY, "label", ["source"], LOOP_SETTINGS, store, "run-2")
    except TR.AlertAnsweredError:
        refused = True
    alerts, answers = store.read("drift_alerts", ALERT_SCHEMA), store.read("alert_resolutions", RESOLUTION_SCHEMA)
    runs = store.read("runs", RUN_SCHEMA).agg(F.count_distinct("run_id").alias("runs"))
    version = Registry(store).state().agg(
        F.max("stage").alias("stage"), F.max(F.array_join("aliases", ", ")).alias("aliases"), F.max(F.col("tags")["trigger_alert_id"]).alias("trigger_alert"))
    left = open_triggers(alerts, answers).agg(F.count("*").alias("open_triggers"))
    told = answers.agg(F.max("model_version").alias("answered_by"), F.lit(refused).alias("second_refused"), F.count("*").alias("resolutions"))
    head = alerts.where(F.col("id") == number).select("window_rows", F.col("id").alias("alert_id"), F.col("retrain_triggered").alias("triggered"))
    return head.crossJoin(runs).crossJoin(version).crossJoin(told).crossJoin(left)


# --- array attributions over the given embeddings ------------------------------------------

EMB_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS phi FROM embeddings),
long AS (SELECT vec_id, unnest(phi) AS value, generate_subscripts(phi, 1) AS i FROM e),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(value) DESC, i) AS position FROM long)"""


def _embedding_rows(spark, sf_dir):
    """Every dimension of an embedding plays a feature."""
    phi = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", phi.alias("phi"))


def _names(spark, sf_dir) -> list[str]:
    width = _embedding_rows(spark, sf_dir).agg(F.max(F.size("phi"))).first()[0] or 0
    return [f"d{i}" for i in range(1, width + 1)]


@query("srt_4_top_factors", EMB_SQL + """
SELECT vec_id, position, 'd' || i AS feature, round(value, 6) + 0.0 AS contribution,
  CASE WHEN value > 0 THEN 'toward fraud' ELSE 'toward legitimate' END AS direction FROM rk WHERE position <= 5""")
def top_factors(spark, sf_dir):
    rows = _embedding_rows(spark, sf_dir).select("vec_id", F.posexplode(XP.top_factors(F.col("phi"), _names(spark, sf_dir), 5)).alias("p", "f"))
    return rows.select("vec_id", (F.col("p") + 1).cast("bigint").alias("position"), "f.feature",
                       r6("f.contribution").alias("contribution"), "f.direction")


@query("srt_5_remainder", EMB_SQL + "SELECT vec_id, round(sum(value) FILTER (position > 5), 6) + 0.0 AS remainder FROM rk GROUP BY 1")
def remainder(spark, sf_dir):
    return _embedding_rows(spark, sf_dir).select("vec_id", r6(XP.remainder(F.col("phi"), _names(spark, sf_dir), 5)).alias("remainder"))


@query("agg_20_global_importance", EMB_SQL + """,
g AS (SELECT 'd' || i AS feature, avg(abs(value)) AS mean_abs, avg(value) AS mean, max(abs(value)) AS max_abs FROM long GROUP BY 1)
SELECT feature, round(mean_abs, 6) + 0.0 AS mean_abs, round(mean, 6) + 0.0 AS mean, round(max_abs, 6) + 0.0 AS max_abs,
  round(100 * mean_abs / sum(mean_abs) OVER (), 6) + 0.0 AS share_pct FROM g""")
def global_importance(spark, sf_dir):
    rows = XP.global_importance(_embedding_rows(spark, sf_dir), _names(spark, sf_dir))
    return rows.select("feature", *[r6(c).alias(c) for c in ("mean_abs", "mean", "max_abs", "share_pct")])
