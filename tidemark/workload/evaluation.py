"""Evaluation queries: class balance, ranking metrics, bootstrap, gate."""

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import ranking as R
from tidemark.operators.bootstrap import bootstrap_average_precision, paired_bootstrap
from tidemark.plans import gate as G
from tidemark.plans import views as V
from tidemark.workload.base import query, r6, table
from tidemark.workload.fixtures import (
    AUDIT_SQL,
    COMPARISONS_SQL,
    PAIRED_SQL,
    audit_view,
    comparisons_view,
    paired_view,
)

WITH = "WITH " + PAIRED_SQL

# Scores of both models in long form, and the cumulative counts per distinct score.
LONG_SQL = WITH + """,
long AS (SELECT 'p_champion' AS model, id, yr, y, p_champion AS score FROM paired UNION ALL
         SELECT 'p_challenger', id, yr, y, p_challenger FROM paired),
grp AS (SELECT model, score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM long GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM grp
        WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
tot AS (SELECT model, sum(pos) AS p, sum(neg) AS n FROM grp GROUP BY 1),
rank_m AS (
  SELECT model, CAST(max(p + n) AS BIGINT) AS rows, CAST(max(p) AS BIGINT) AS positives, max(p / (p + n)) AS floor,
    sum(pos * tp / (tp + fp)) / max(p) AS pr_auc, sum(neg * (tp - pos + pos / 2)) / max(p * n) AS roc_auc
  FROM cum JOIN tot USING (model) GROUP BY 1),
curve AS (
  SELECT model, score, tp / (tp + fp) AS precision, tp / p AS recall,
    CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p) END AS f1
  FROM cum JOIN tot USING (model)),
best AS (SELECT * FROM curve QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score) = 1),
conf AS (
  SELECT model, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp,
    count(*) FILTER (score < 0.5 AND y = 1) AS fn, count(*) FILTER (score < 0.5 AND y = 0) AS tn FROM long GROUP BY 1)"""


def long_scores(spark, sf_dir):
    return G.long_scores(paired_view(spark, sf_dir), ["id", "yr", "y"])


@query("agg_13_class_balance", WITH + """
SELECT yr::BIGINT AS yr, count(*) AS rows, sum(y)::BIGINT AS positives, round(avg(y), 6) + 0.0 AS rate,
  round((count(*) - sum(y)) / sum(y), 6) + 0.0 AS positive_weight FROM paired GROUP BY 1""")
def class_balance(spark, sf_dir):
    rows = R.class_balance(paired_view(spark, sf_dir), "y", ["yr"])
    return rows.select(F.col("yr").cast("bigint").alias("yr"), "rows", "positives", r6("rate").alias("rate"),
                       r6("positive_weight").alias("positive_weight"))


@query("agg_14_confusion", LONG_SQL + """
SELECT model, tp + fp + fn + tn AS rows, tp, fp, fn, tn, round(tp / (tp + fp), 6) + 0.0 AS precision,
  round(tp / (tp + fn), 6) + 0.0 AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1, tp + fp AS flagged,
  round(100.0 * (tp + fp) / (tp + fp + fn + tn), 6) + 0.0 AS flagged_pct FROM conf""")
def confusion(spark, sf_dir):
    rows = R.confusion(long_scores(spark, sf_dir), "score", "y", 0.5, ["model"])
    counts = ["model", "rows", "tp", "fp", "fn", "tn", "flagged"]
    return rows.select(*counts, *[r6(c).alias(c) for c in ("precision", "recall", "f1", "flagged_pct")])


@query("agg_15_average_precision", LONG_SQL + "SELECT model, round(pr_auc, 6) + 0.0 AS pr_auc FROM rank_m")
def average_precision(spark, sf_dir):
    return R.ranking_metrics(long_scores(spark, sf_dir), "score", "y", ["model"]).select(
        "model", r6("pr_auc").alias("pr_auc"))


@query("agg_16_roc_auc", LONG_SQL + "SELECT model, round(roc_auc, 6) + 0.0 AS roc_auc FROM rank_m")
def roc_auc(spark, sf_dir):
    return R.ranking_metrics(long_scores(spark, sf_dir), "score", "y", ["model"]).select(
        "model", r6("roc_auc").alias("roc_auc"))


@query("agg_17_floor_and_lift", LONG_SQL + """
SELECT model, rows, positives, round(floor, 6) + 0.0 AS floor, round(pr_auc, 6) + 0.0 AS pr_auc,
  round(pr_auc / floor, 6) + 0.0 AS lift FROM rank_m""")
def floor_and_lift(spark, sf_dir):
    rows = R.require_two_classes(R.ranking_metrics(long_scores(spark, sf_dir), "score", "y", ["model"]))
    return rows.select("model", "rows", "positives", *[r6(c).alias(c) for c in ("floor", "pr_auc", "lift")])


@query("agg_18_member_correlation", WITH + "SELECT round(corr(p_champion, p_challenger), 6) + 0.0 AS correlation FROM paired")
def correlation(spark, sf_dir):
    return paired_view(spark, sf_dir).agg(r6(F.corr("p_champion", "p_challenger")).alias("correlation"))


@query("win_1_cumulative_counts", LONG_SQL + """
SELECT model, score, pos::BIGINT AS pos, neg::BIGINT AS neg, tp::BIGINT AS tp, fp::BIGINT AS fp FROM cum""")
def cumulative_counts(spark, sf_dir):
    """Over score ranges, as large tables get it."""
    long = long_scores(spark, sf_dir)
    cuts = R.score_cuts(long, "score", rows_per_range=1_000)
    return R.ranked_counts(long, "score", "y", ["model"], cuts)


@query("win_2_best_f1", LONG_SQL + """
SELECT model, score AS threshold, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall,
  round(f1, 6) + 0.0 AS f1 FROM best""")
def best_f1(spark, sf_dir):
    rows = R.best_f1(long_scores(spark, sf_dir), "score", "y", ["model"])
    return rows.select("model", "threshold", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


ENSEMBLE_SQL = WITH + """,
m AS (SELECT id, yr, y, p_champion AS a, p_challenger AS b, (p_champion + p_challenger) / 2 AS e FROM paired),
long AS (SELECT 'a' AS model, yr, y, a AS score FROM m UNION ALL SELECT 'b', yr, y, b FROM m UNION ALL SELECT 'ensemble', yr, y, e FROM m),
tagged AS (SELECT *, CASE WHEN yr < 1998 THEN 'train' ELSE 'val' END AS slice FROM long),
grp AS (SELECT model, slice, score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM tagged GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM grp WINDOW w AS (PARTITION BY model, slice ORDER BY score DESC)),
tot AS (SELECT model, slice, sum(pos) AS p, sum(neg) AS n FROM grp GROUP BY ALL),
met AS (SELECT model, slice, CAST(max(p + n) AS BIGINT) AS rows, CAST(max(p) AS BIGINT) AS positives,
    sum(pos * tp / (tp + fp)) / max(p) AS pr_auc, sum(neg * (tp - pos + pos / 2)) / max(p * n) AS roc_auc
  FROM cum JOIN tot USING (model, slice) GROUP BY ALL)"""


def _members(spark, sf_dir):
    c = F.col
    rows = paired_view(spark, sf_dir).select(
        "id", "yr", "y", c("p_champion").alias("a"), c("p_challenger").alias("b"),
        S.mean_probability(c("p_champion"), c("p_challenger")).alias("ensemble"),
    )
    long = G.long_scores(rows, ["yr", "y"], ("a", "b", "ensemble"))
    return rows, long.withColumn("slice", F.when(c("yr") < 1998, "train").otherwise("val"))


@query("mdl_5_ensemble", ENSEMBLE_SQL + """
SELECT (SELECT round(corr(a, b), 6) + 0.0 FROM m) AS correlation,
  round(max(pr_auc) FILTER (model = 'ensemble'), 6) + 0.0 AS ensemble_pr_auc,
  round(max(pr_auc) FILTER (model = 'ensemble') - max(pr_auc) FILTER (model <> 'ensemble'), 6) + 0.0 AS gain
FROM met WHERE slice = 'val'""")
def ensemble(spark, sf_dir):
    from tidemark.plans.training import ensemble_summary

    rows, long = _members(spark, sf_dir)
    val = long.where(F.col("slice") == "val")
    metrics = R.ranking_metrics(val, "score", "y", ["model"])
    return ensemble_summary(rows, "a", "b", metrics).select(
        *[r6(c).alias(c) for c in ("correlation", "ensemble_pr_auc", "gain")])


@query("mdl_6_metric_block", ENSEMBLE_SQL + """,
pick AS (SELECT model, slice, score, 2 * tp / (tp + fp + p) AS f1 FROM cum JOIN tot USING (model, slice)
  QUALIFY row_number() OVER (PARTITION BY model, slice ORDER BY round(2 * tp / (tp + fp + p), 12) DESC, score) = 1),
dflt AS (SELECT model, slice, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp FROM tagged GROUP BY ALL)
SELECT model, slice, rows, positives, round(pr_auc, 6) + 0.0 AS pr_auc, round(roc_auc, 6) + 0.0 AS roc_auc,
  tp AS tp_at_default, fp AS fp_at_default, round(f1, 6) + 0.0 AS best_f1
FROM met JOIN pick USING (model, slice) JOIN dflt USING (model, slice)""")
def metric_block(spark, sf_dir):
    _, long = _members(spark, sf_dir)
    rows = R.metric_block(long, "score", "y", ["model", "slice"])
    return rows.select("model", "slice", "rows", "positives", r6("pr_auc").alias("pr_auc"), r6("roc_auc").alias("roc_auc"),
                       "tp_at_default", "fp_at_default", r6("best_f1").alias("best_f1"))


@query("mdl_7_model_comparison", ENSEMBLE_SQL + """,
wide AS (SELECT model, max(pr_auc) FILTER (slice = 'val') AS val_pr_auc, max(pr_auc) FILTER (slice = 'train') AS train_pr_auc FROM met GROUP BY 1)
SELECT model, round(val_pr_auc, 6) + 0.0 AS val_pr_auc, round(train_pr_auc, 6) + 0.0 AS train_pr_auc,
  round(train_pr_auc - val_pr_auc, 6) + 0.0 AS overfit_gap,
  model = (SELECT max_by(model, val_pr_auc) FROM wide) AS is_best FROM wide""")
def model_comparison(spark, sf_dir):
    from tidemark.plans.training import side_by_side

    _, long = _members(spark, sf_dir)
    rows = side_by_side(R.ranking_metrics(long, "score", "y", ["model", "slice"]))
    return rows.select("model", *[r6(c).alias(c) for c in ("val_pr_auc", "train_pr_auc", "overfit_gap")], "is_best")


# --- bootstrap -------------------------------------------------------------------------------

RESAMPLES = 1_000

BOOT_SQL = WITH + f""",
b AS (SELECT range AS b FROM range({RESAMPLES})),
x0 AS (SELECT id, y, p_champion, p_challenger, b,
  xor(((id % 2147483647) * 48271 + 42 * 69621 + 1) % 2147483647, (b * 1640531527) % 2147483647) AS x FROM paired, b),
x1 AS (SELECT * REPLACE ((x * 48271) % 2147483647 AS x) FROM x0),
x2 AS (SELECT * REPLACE ((xor(x, x >> 15) * 69621) % 2147483647 AS x) FROM x1),
x3 AS (SELECT * REPLACE ((xor(x, x >> 13) * 16807) % 2147483647 AS x) FROM x2),
steps AS (SELECT [CAST(floor(2147483647 * c) AS BIGINT) FOR c IN
  [exp(-1::DOUBLE), exp(-1::DOUBLE) * 2, exp(-1::DOUBLE) * 2.5, exp(-1::DOUBLE) * (2.5 + 1 / 6.0::DOUBLE),
   exp(-1::DOUBLE) * (2.5 + 1 / 6.0::DOUBLE + 1 / 24.0::DOUBLE), exp(-1::DOUBLE) * (2.5 + 1 / 6.0::DOUBLE + 1 / 24.0::DOUBLE + 1 / 120.0::DOUBLE),
   exp(-1::DOUBLE) * (2.5 + 1 / 6.0::DOUBLE + 1 / 24.0::DOUBLE + 1 / 120.0::DOUBLE + 1 / 720.0::DOUBLE),
   exp(-1::DOUBLE) * (2.5 + 1 / 6.0::DOUBLE + 1 / 24.0::DOUBLE + 1 / 120.0::DOUBLE + 1 / 720.0::DOUBLE + 1 / 5040.0::DOUBLE),
   exp(-1::DOUBLE) * (2.5 + 1 / 6.0::DOUBLE + 1 / 24.0::DOUBLE + 1 / 120.0::DOUBLE + 1 / 720.0::DOUBLE + 1 / 5040.0::DOUBLE + 1 / 40320.0::DOUBLE)]] AS s),
w AS (SELECT y, p_champion, p_challenger, b,
  (x >= s[1])::INT + (x >= s[2])::INT + (x >= s[3])::INT + (x >= s[4])::INT + (x >= s[5])::INT + (x >= s[6])::INT
  + (x >= s[7])::INT + (x >= s[8])::INT + (x >= s[9])::INT AS w FROM x3, steps),
lw AS (SELECT 'p_champion' AS model, b, p_champion AS score, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM w GROUP BY ALL UNION ALL
       SELECT 'p_challenger', b, p_challenger, sum(w * y)::DOUBLE, sum(w * (1 - y))::DOUBLE FROM w GROUP BY ALL),
cw AS (SELECT *, sum(pos) OVER q AS tp, sum(neg) OVER q AS fp FROM lw WINDOW q AS (PARTITION BY model, b ORDER BY score DESC)),
ap AS (SELECT model, b, sum(CASE WHEN tp + fp > 0 THEN pos * tp / (tp + fp) ELSE 0 END) / sum(pos) AS ap FROM cw GROUP BY ALL),
d AS (SELECT b, max(ap) FILTER (model = 'p_challenger') - max(ap) FILTER (model = 'p_champion') AS delta FROM ap GROUP BY 1)"""


@query("agg_19_paired_bootstrap", BOOT_SQL + """
SELECT count(*) AS resamples_used, round(stddev_samp(delta), 6) + 0.0 AS standard_error,
  round(quantile_cont(delta, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(delta, 0.975), 6) + 0.0 AS ci_high FROM d""")
def bootstrap(spark, sf_dir):
    row = paired_bootstrap(paired_view(spark, sf_dir), resamples=RESAMPLES, rows_per_range=2_000)
    return row.select("resamples_used", *[r6(c).alias(c) for c in ("standard_error", "ci_low", "ci_high")])


@query("agg_19_resample_scores", BOOT_SQL + "SELECT model, b, round(ap, 6) + 0.0 AS ap FROM ap")
def resample_scores(spark, sf_dir):
    rows = bootstrap_average_precision(paired_view(spark, sf_dir), resamples=RESAMPLES, rows_per_range=2_000)
    return rows.select("model", "b", r6("ap").alias("ap"))


# --- the gate ---------------------------------------------------------------------------------

PAIR_SQL = "WITH " + AUDIT_SQL + """,
usable AS (SELECT * FROM audit WHERE challenger_probability IS NOT NULL AND true_label IS NOT NULL),
newest AS (SELECT model_version AS mv, challenger_version AS cv, threshold AS mt, challenger_threshold AS ct FROM usable ORDER BY id DESC LIMIT 1),
rowset AS (SELECT u.*, mt, ct FROM usable u, newest WHERE model_version = mv AND challenger_version = cv),
long AS (SELECT 'champion' AS model, true_label AS y, fraud_probability AS score, mt AS t FROM rowset UNION ALL
         SELECT 'challenger', true_label, challenger_probability, ct FROM rowset),
grp AS (SELECT model, score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM long GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM grp WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
tot AS (SELECT model, sum(pos) AS p, sum(neg) AS n FROM grp GROUP BY 1),
met AS (SELECT model, CAST(max(p + n) AS BIGINT) AS rows, CAST(max(p) AS BIGINT) AS positives,
  sum(pos * tp / (tp + fp)) / max(p) AS pr_auc, sum(neg * (tp - pos + pos / 2)) / max(p * n) AS roc_auc FROM cum JOIN tot USING (model) GROUP BY 1),
conf AS (SELECT model, count(*) FILTER (score >= t AND y = 1) AS tp, count(*) FILTER (score >= t AND y = 0) AS fp FROM long GROUP BY 1),
a AS (SELECT * FROM met JOIN conf USING (model) WHERE model = 'champion'),
c AS (SELECT * FROM met JOIN conf USING (model) WHERE model = 'challenger'),
j AS (SELECT min(dt) AS judged_from, max(dt) AS judged_to FROM rowset)"""

GATE_TRAINED = (1_700_000_000.0, 1_705_000_000.0)


@query("gate_1_compare", PAIR_SQL + """
SELECT mv AS champion_version, cv AS challenger_version, a.rows, a.positives,
  round(a.pr_auc, 6) + 0.0 AS champion_pr_auc, round(c.pr_auc, 6) + 0.0 AS challenger_pr_auc,
  round(a.roc_auc, 6) + 0.0 AS champion_roc_auc, a.tp AS champion_tp, c.fp AS challenger_fp,
  round(c.pr_auc - a.pr_auc, 6) + 0.0 AS pr_auc_delta, judged_from, judged_to,
  round(greatest(0, least(judged_to, 1705000000.0) - greatest(judged_from, 1700000000.0)) / (judged_to - judged_from), 6) + 0.0 AS leakage_overlap,
  a.rows >= 5000 AND a.positives >= 100 AS sufficient_data,
  CASE WHEN greatest(0, least(judged_to, 1705000000.0) - greatest(judged_from, 1700000000.0)) / (judged_to - judged_from) > 0.01
    THEN 'NO VERDICT -- evaluation rows overlap the challenger''s training window'
    WHEN NOT (a.rows >= 5000 AND a.positives >= 100) THEN 'NO PROMOTION -- insufficient data'
    WHEN c.pr_auc - a.pr_auc <= 0 THEN 'NO PROMOTION -- challenger is not ahead' ELSE 'other' END AS verdict
FROM a, c, j, newest""")
def gate_compare(spark, sf_dir):
    """The newest pair of the audit table; the verdict is settled before the margin matters."""
    row = G.compare(audit_view(spark, sf_dir), trained=GATE_TRAINED)
    numbers = ("champion_pr_auc", "challenger_pr_auc", "champion_roc_auc", "pr_auc_delta", "leakage_overlap")
    return row.select(
        "champion_version", "challenger_version", "rows", "positives", *[r6(n).alias(n) for n in numbers],
        "champion_tp", "challenger_fp", "judged_from", "judged_to", "sufficient_data", "verdict",
    )


@query("gate_1_paired_orders", BOOT_SQL + """,
long AS (SELECT 'p_champion' AS model, y, p_champion AS score FROM paired UNION ALL SELECT 'p_challenger', y, p_challenger FROM paired),
grp AS (SELECT model, score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM long GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER q AS tp, sum(neg) OVER q AS fp FROM grp WINDOW q AS (PARTITION BY model ORDER BY score DESC)),
met AS (SELECT model, sum(pos) AS p, sum(pos + neg) AS n, sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc FROM cum GROUP BY 1),
g AS (SELECT max(n)::BIGINT AS rows, max(p)::BIGINT AS positives,
  max(pr_auc) FILTER (model = 'p_challenger') - max(pr_auc) FILTER (model = 'p_champion') AS delta,
  (SELECT stddev_samp(delta) FROM d) AS se FROM met)
SELECT rows, positives, round(delta, 6) + 0.0 AS pr_auc_delta, round(se, 6) + 0.0 AS bootstrap_std_error,
  round(abs(delta) / se, 3) + 0.0 AS margin_in_ses, FALSE AS leakage_checked,
  CASE WHEN rows < 5000 OR positives < 100 THEN 'NO PROMOTION -- insufficient data'
    WHEN delta > 0 AND abs(delta) / se >= 1 THEN 'PROMOTE' WHEN delta <= 0 THEN 'NO PROMOTION -- challenger is not ahead'
    ELSE 'no promotion, difference within noise' END AS verdict FROM g""")
def gate_orders(spark, sf_dir):
    """The whole orders table through the gate, margin included; training window unknown."""
    row = G.compare_rows(paired_view(spark, sf_dir), 0.5, 0.5, None, resamples=RESAMPLES)
    return row.select("rows", "positives", r6("pr_auc_delta").alias("pr_auc_delta"),
                      r6("bootstrap_std_error").alias("bootstrap_std_error"),
                      (F.round("margin_in_ses", 3) + 0.0).alias("margin_in_ses"), "leakage_checked", "verdict")


@query("agg_24_judged_range", PAIR_SQL + "SELECT judged_from, judged_to FROM j")
def judged_range(spark, sf_dir):
    return G.judged_range(V.paired_rows(audit_view(spark, sf_dir)))


@query("jn_5_score_pairing", WITH + """
SELECT id, y::BIGINT AS y, p_champion, p_challenger FROM paired WHERE id % 5 <> 0 AND id % 7 <> 0""")
def score_pairing(spark, sf_dir):
    """Two separately scored sets, each with gaps of its own, met on the transaction."""
    rows = paired_view(spark, sf_dir)
    champion = rows.where("id % 5 <> 0").select("id", "y", F.col("p_champion").alias("score"))
    challenger = rows.where("id % 7 <> 0").select("id", F.col("p_challenger").alias("score"))
    return G.pair_scores(champion, challenger, "id").withColumn("y", F.col("y").cast("bigint"))


OVERLAP_SQL = "WITH " + COMPARISONS_SQL + """,
o AS (SELECT id, promoted_s AS a, promoted_s + (id % 4) * 86400.0 AS b, promoted_s + (id % 5 - 2) * 43200.0 AS ta,
  promoted_s + (id % 7) * 43200.0 AS tb FROM comparisons),
f AS (SELECT id, CASE WHEN b - a <= 0 THEN CASE WHEN ta <= a AND a <= tb THEN 1.0 ELSE 0.0 END
  ELSE greatest(0.0, least(b, tb) - greatest(a, ta)) / (b - a) END AS overlap FROM o)"""


def _overlaps(spark, sf_dir):
    c, s = F.col, F.col("promoted_s")
    return comparisons_view(spark, sf_dir).select("id", S.overlap_fraction(
        s, s + (c("id") % 4) * 86400.0, s + (c("id") % 5 - 2) * 43200.0, s + (c("id") % 7) * 43200.0
    ).alias("overlap"))


@query("tmp_5_overlap", OVERLAP_SQL + "SELECT id, round(overlap, 6) + 0.0 AS overlap FROM f")
def overlap(spark, sf_dir):
    return _overlaps(spark, sf_dir).select("id", r6("overlap").alias("overlap"))


@query("tmp_6_leakage_guard", OVERLAP_SQL + "SELECT id, overlap > 0.01 AS leaked FROM f")
def leakage_guard(spark, sf_dir):
    return _overlaps(spark, sf_dir).select("id", S.leaked(F.col("overlap")).alias("leaked"))


@query("fn_16_margin", "WITH " + COMPARISONS_SQL + """
SELECT id, round(CASE WHEN id % 9 = 0 THEN 0 ELSE abs(pr_auc_delta) / (0.001 * (1 + id % 9)) END, 6) + 0.0 AS margin FROM comparisons""")
def margin(spark, sf_dir):
    c = F.col
    se = F.when(c("id") % 9 == 0, F.when(c("id") % 2 == 0, float("nan")).otherwise(0.0)).otherwise(
        F.lit(0.001) * (1 + c("id") % 9))
    return comparisons_view(spark, sf_dir).select("id", r6(S.margin_in_ses(c("pr_auc_delta"), se)).alias("margin"))


@query("mdl_9_loss_attribution", "WITH " + COMPARISONS_SQL + """,
r AS (SELECT id, challenger_pr_auc AS probe, champion_pr_auc AS cur, 0.43 AS bar FROM comparisons)
SELECT id, round(probe - bar, 6) + 0.0 AS carve_delta,
  CASE WHEN abs(probe - bar) <= 0.15 THEN round(cur - bar - (probe - bar), 6) + 0.0 END AS stopping_delta,
  abs(probe - bar) > 0.15 AS suppressed FROM r""")
def loss_attribution(spark, sf_dir):
    from tidemark.plans.training import attribute_loss

    rows = comparisons_view(spark, sf_dir).select(
        "id", F.col("challenger_pr_auc").alias("probe"), F.col("champion_pr_auc").alias("current"))
    out = attribute_loss(rows, "probe", "current", bar=0.43)
    return out.select("id", r6("carve_delta").alias("carve_delta"), r6("stopping_delta").alias("stopping_delta"), "suppressed")


@query("win_2_best_f1_by_segment", """
WITH s AS (SELECT l_linenumber::BIGINT AS seg, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_discount + l_tax AS score FROM lineitem),
g AS (SELECT seg, round(score, 6) AS score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM s GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY seg) AS p FROM g WINDOW w AS (PARTITION BY seg ORDER BY score DESC))
SELECT seg, round(max(2 * tp / (tp + fp + p)), 6) + 0.0 AS f1 FROM c GROUP BY 1""")
def best_f1_by_segment(spark, sf_dir):
    """Many groups, few distinct scores: the counts fold before they move."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("seg"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.round(F.col("l_discount") + F.col("l_tax"), 6).alias("score"),
    )
    return R.best_f1(rows, "score", "y", ["seg"]).select("seg", r6("f1").alias("f1"))
