"""Drift queries: quantile edges and the PSI family."""

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import psi as P
from tidemark.operators.encoding import missing_share
from tidemark.plans import monitor as M
from tidemark.session import small_table
from tidemark.workload.base import query, r6
from tidemark.workload.fixtures import (
    DRIFT_EXCLUDE,
    DRIFT_FEATURES,
    DRIFT_SQL,
    PSI_SQL,
    drift_sides,
    drift_view,
)

WITH = "WITH " + PSI_SQL


def drift_rows(spark, sf_dir, **options):
    reference, current = drift_sides(spark, sf_dir)
    return P.drift_table(reference, current, exclude=DRIFT_EXCLUDE, **options)


@query("psi_5_report", WITH + """
SELECT feature, kind, round(psi_all, 6) + 0.0 AS psi, band FROM drift_rows""")
def psi_report(spark, sf_dir):
    reference, current = drift_sides(spark, sf_dir)
    return P.psi_report(reference, current, exclude=DRIFT_EXCLUDE).withColumn("psi", r6("psi"))


@query("agg_5_quantile_edges", "WITH " + DRIFT_SQL + """,
v AS (SELECT 'f_value' AS feature, f_value AS x FROM drift WHERE split = 'train' UNION ALL
      SELECT 'f_cover', f_cover FROM drift WHERE split = 'train' UNION ALL
      SELECT 'price', l_extendedprice FROM drift WHERE split = 'train'),
e AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0,.1,.2,.3,.4,.5,.6,.7,.8,.9,1]))) AS e
      FROM v WHERE x IS NOT NULL GROUP BY feature)
SELECT feature, CAST(generate_subscripts(e, 1) AS BIGINT) AS position, round(unnest(e), 6) + 0.0 AS edge FROM e""")
def quantile_edges(spark, sf_dir):
    train = drift_view(spark, sf_dir, "train").withColumnRenamed("l_extendedprice", "price")
    profiles, _ = P.profile_features(train, train, features=["f_value", "f_cover", "price"])
    rows = [
        (p.feature, i, edge) for p in profiles.values() for i, edge in enumerate(p.edges or (), start=1)
    ]
    return small_table(spark, rows, "feature string, position bigint, edge double").withColumn("edge", r6("edge"))


@query("psi_1_numeric", WITH + """
SELECT feature, round(psi_all, 6) + 0.0 AS psi FROM drift_rows WHERE feature = 'f_cover'""")
def psi_numeric(spark, sf_dir):
    reference, current = drift_sides(spark, sf_dir)
    return P.psi_numeric(reference, current, "f_cover").withColumn("psi", r6("psi"))


@query("psi_2_categorical", WITH + """
SELECT feature, round(psi_all, 6) + 0.0 AS psi FROM drift_rows WHERE feature = 'f_catmiss'""")
def psi_categorical(spark, sf_dir):
    reference, current = drift_sides(spark, sf_dir)
    return P.psi_categorical(reference, current, "f_catmiss").withColumn("psi", r6("psi"))


@query("psi_3_contributions", WITH + """
SELECT CASE WHEN bucket IS NULL THEN 'missing' ELSE
    format('({:.4g}, {:.4g}]', CASE WHEN b = 0 THEN '-Infinity'::DOUBLE ELSE inner_e[b] END,
      CASE WHEN b = len(inner_e) THEN 'Infinity'::DOUBLE ELSE inner_e[b + 1] END) END AS bucket,
  CAST(coalesce(b, -1) AS BIGINT) AS bucket_code,
  round(ra, 6) + 0.0 AS reference_pct, round(ca, 6) + 0.0 AS current_pct,
  round((ca - ra) * ln(ca / ra), 6) + 0.0 AS contribution
FROM (SELECT *, CAST(bucket AS INTEGER) AS b FROM sh JOIN edges USING (feature) WHERE feature = 'f_cover')""")
def contributions(spark, sf_dir):
    reference, current = drift_sides(spark, sf_dir)
    rows = P.psi_contributions(reference, current, "f_cover")
    return rows.select(
        "bucket", F.col("bucket_code").cast("bigint").alias("bucket_code"),
        *[r6(c).alias(c) for c in ("reference_pct", "current_pct", "contribution")],
    )


@query("psi_4_dispatch", WITH + """
SELECT feature, kind, round(psi_all, 6) + 0.0 AS psi FROM drift_rows WHERE feature IN ('f_value', 'f_bool', 'f_cat')""")
def dispatch(spark, sf_dir):
    return drift_rows(spark, sf_dir, features=["f_value", "f_bool", "f_cat"]).select(
        "feature", "kind", r6("psi_all").alias("psi")
    )


@query("psi_6_decomposition", WITH + """
SELECT feature, kind, round(psi_all, 6) + 0.0 AS psi_all, round(psi_non_null, 6) + 0.0 AS psi_non_null,
  round(psi_all - psi_non_null, 6) + 0.0 AS psi_from_missingness,
  round(na_rate_reference, 6) + 0.0 AS na_rate_reference, round(na_rate_current, 6) + 0.0 AS na_rate_current,
  round(na_rate_current - na_rate_reference, 6) + 0.0 AS na_rate_delta FROM drift_rows""")
def decomposition(spark, sf_dir):
    reference, current = drift_sides(spark, sf_dir)
    rows = P.decompose_drift(reference, current, exclude=DRIFT_EXCLUDE)
    return rows.select("feature", "kind", *[r6(c).alias(c) for c in rows.columns[2:]])


@query("psi_7_drift_types", WITH + "SELECT feature, drift_type FROM typed WHERE drift_type <> 'none'")
def drift_types(spark, sf_dir):
    typed = P.classify_drift(drift_rows(spark, sf_dir))
    return typed.where(F.col("drift_type") != "none").select("feature", "drift_type")


@query("psi_8_missingness_majors", WITH + """
SELECT feature, round(psi_all, 6) + 0.0 AS psi_all, round(psi_non_null, 6) + 0.0 AS psi_non_null
FROM drift_rows WHERE psi_all >= 0.20 AND psi_non_null < 0.10""")
def missingness_majors(spark, sf_dir):
    rows = P.missingness_driven_majors(drift_rows(spark, sf_dir))
    return rows.select("feature", r6("psi_all").alias("psi_all"), r6("psi_non_null").alias("psi_non_null"))


ALERT_SQL = """
SELECT round(max(psi_all), 6) + 0.0 AS overall_psi, max_by(feature, psi_all) AS overall_psi_feature,
  round(coalesce(max(psi_all) FILTER (drift_type = 'value'), 0), 6) + 0.0 AS value_drift_psi,
  count(*) FILTER (drift_type = 'value') AS value_drift_features,
  round(coalesce(max(psi_all) FILTER (drift_type = 'missingness'), 0), 6) + 0.0 AS missingness_psi,
  count(*) FILTER (drift_type = 'missingness') AS missingness_features,
  count(*) FILTER (band = 'major') AS n_major, count(*) FILTER (band = 'moderate') AS n_moderate,
  count(*) FILTER (band = 'stable') AS n_stable, count(*) FILTER (band = 'unmeasurable') AS n_unmeasurable,
  0.2 AS threshold,
  CASE WHEN coalesce(max(psi_all) FILTER (drift_type = 'value'), 0) >= 0.2
        AND coalesce(max(psi_all) FILTER (drift_type = 'missingness'), 0) >= 0.2 THEN 'RETRAIN + INVESTIGATE PIPELINE'
       WHEN coalesce(max(psi_all) FILTER (drift_type = 'value'), 0) >= 0.2 THEN 'RETRAIN'
       WHEN coalesce(max(psi_all) FILTER (drift_type = 'missingness'), 0) >= 0.2
         THEN 'INVESTIGATE PIPELINE (no retrain)' ELSE 'STABLE' END AS verdict,
  string_agg(feature, ',' ORDER BY psi_all DESC) FILTER (drift_type = 'value') AS value_list,
  string_agg(feature, ',' ORDER BY psi_all DESC) FILTER (drift_type = 'missingness') AS missingness_list,
  (SELECT count(*) FROM drift WHERE split = 'stream') AS window_rows,
  (SELECT min(dt) FROM drift WHERE split = 'stream') AS window_start_dt,
  (SELECT count(*) FROM drift WHERE split = 'train') AS reference_rows
FROM typed"""

# The monitor looks at the newest 200 days of the stream split only.
RECENT_PSI_SQL = PSI_SQL.replace(
    "cut AS (SELECT li.*, m3, m4, dt >= m4 AS late FROM li, bounds)",
    "cut AS (SELECT li.*, m3, m4, dt >= m4 AS late FROM li, bounds WHERE dt < m3 OR dt >= hi - 200 * 86400)",
)


@query("psi_9_monitor_run", "WITH " + RECENT_PSI_SQL + ALERT_SQL.replace("0.2 AS threshold", "CAST(0.2 AS DOUBLE) AS threshold"))
def monitor_run(spark, sf_dir):
    reference, stream = drift_sides(spark, sf_dir)
    alert = M.run_monitor(reference, stream, "dt", exclude=DRIFT_EXCLUDE, window_days=200).alert
    return alert.select(
        *[r6(c).alias(c) for c in ("overall_psi", "value_drift_psi", "missingness_psi")],
        "overall_psi_feature", "value_drift_features", "missingness_features",
        "n_major", "n_moderate", "n_stable", "n_unmeasurable", "threshold", "verdict",
        F.array_join("value_drift_feature_list", ",").alias("value_list"),
        F.array_join("missingness_feature_list", ",").alias("missingness_list"),
        "window_rows", "window_start_dt", "reference_rows",
    )


@query("psi_10_top_features", WITH + """
SELECT feature, round(psi_all, 6) + 0.0 AS psi, CASE drift_type WHEN 'none' THEN 'unclassified' ELSE drift_type END AS type,
  round(psi_non_null, 6) + 0.0 AS psi_non_null, round(na_rate_reference, 6) + 0.0 AS na_rate_reference,
  round(na_rate_current, 6) + 0.0 AS na_rate_current
FROM typed WHERE psi_all IS NOT NULL ORDER BY psi_all DESC LIMIT 5""")
def top_features(spark, sf_dir):
    rows = M.top_features(P.classify_drift(drift_rows(spark, sf_dir)), 5)
    numbers = ("psi", "psi_non_null", "na_rate_reference", "na_rate_current")
    return rows.select("feature", "type", *[r6(c).alias(c) for c in numbers])


@query("psi_11_band_regression", WITH + """
SELECT band, expected, coalesce(n, 0) AS features, coalesce(n, 0) = expected AS matches
FROM (VALUES ('stable', 1::BIGINT), ('moderate', 0), ('major', 5), ('unmeasurable', 2)) e(band, expected)
LEFT JOIN (SELECT band, count(*) AS n FROM drift_rows GROUP BY band) USING (band)""")
def band_regression(spark, sf_dir):
    expected = {"stable": 1, "moderate": 0, "major": 5, "unmeasurable": 2}
    return P.band_regression(drift_rows(spark, sf_dir), expected)


@query("agg_11_band_counts", WITH + """
SELECT band, coalesce(n, 0) AS features
FROM (VALUES ('stable'), ('moderate'), ('major'), ('unmeasurable')) e(band)
LEFT JOIN (SELECT band, count(*) AS n FROM drift_rows GROUP BY band) USING (band)""")
def band_counts(spark, sf_dir):
    return P.band_counts(drift_rows(spark, sf_dir))


@query("agg_12_overall_psi", WITH + """
SELECT round(coalesce(max(psi_all), 0), 6) + 0.0 AS overall_psi, max_by(feature, psi_all) AS overall_psi_feature FROM drift_rows""")
def overall(spark, sf_dir):
    return P.overall_psi(drift_rows(spark, sf_dir), "psi_all").withColumn("overall_psi", r6("overall_psi"))


@query("agg_4_level_shares", "WITH " + DRIFT_SQL + """
SELECT coalesce(f_catmiss, '__MISSING__') AS level, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share
FROM drift WHERE split = 'train' GROUP BY 1""")
def level_shares(spark, sf_dir):
    train = drift_view(spark, sf_dir, "train")
    counts = train.groupBy(F.coalesce("f_catmiss", F.lit(S.MISSING_LEVEL)).alias("level")).agg(
        F.count("*").alias("n")
    )
    total = train.agg(F.count("*")).scalar()
    return counts.select("level", r6(S.share(F.col("n"), total)).alias("share"))


@query("agg_8_null_rates", "WITH " + DRIFT_SQL + """,
u AS (SELECT 'f_cover' AS feature, split, f_cover IS NULL AS gap FROM drift UNION ALL
      SELECT 'f_catmiss', split, f_catmiss IS NULL FROM drift UNION ALL
      SELECT 'f_value', split, f_value IS NULL FROM drift),
g AS (SELECT feature, avg(gap::INT) FILTER (split = 'train') AS a, avg(gap::INT) FILTER (split = 'stream') AS b
      FROM u GROUP BY feature)
SELECT feature, round(a, 6) + 0.0 AS na_rate_reference, round(b, 6) + 0.0 AS na_rate_current,
  round(b - a, 6) + 0.0 AS na_rate_delta FROM g""")
def null_rates(spark, sf_dir):
    rows = drift_rows(spark, sf_dir, features=["f_cover", "f_catmiss", "f_value"])
    return rows.select("feature", *[r6(c).alias(c) for c in
                                    ("na_rate_reference", "na_rate_current", "na_rate_delta")])


@query("agg_21_missing_share", "WITH " + DRIFT_SQL + """
SELECT round((count(*) - count(f_value) + count(*) - count(f_cover) + count(*) - count(f_cat) + count(*) - count(f_catmiss)
  + count(*) - count(f_stable) + count(*) - count(f_bool) + count(*) - count(f_const)) / (count(*) * 7.0), 6) + 0.0
  AS missing_share FROM drift""")
def matrix_missing_share(spark, sf_dir):
    return missing_share(drift_view(spark, sf_dir), DRIFT_FEATURES).select(r6("missing_share").alias("missing_share"))


@query("jn_4_bucket_alignment", WITH + """
SELECT feature, coalesce(bucket, 'missing') AS bucket, CAST(r AS BIGINT) AS ref_n, CAST(c AS BIGINT) AS cur_n FROM cnt""")
def bucket_alignment(spark, sf_dir):
    reference, current = drift_sides(spark, sf_dir)
    profiles, tagged = P.profile_features(reference, current, exclude=DRIFT_EXCLUDE)
    return P.bucket_counts(tagged, profiles).withColumn("bucket", F.coalesce("bucket", F.lit("missing")))


@query("set_2_bucket_universe", WITH + """
SELECT feature, count(*) AS buckets, count(*) FILTER (r > 0 AND c > 0) AS shared,
  count(*) FILTER (r > 0 AND c = 0) AS reference_only, count(*) FILTER (r = 0 AND c > 0) AS current_only
FROM cnt GROUP BY feature""")
def bucket_universe(spark, sf_dir):
    reference, current = drift_sides(spark, sf_dir)
    profiles, tagged = P.profile_features(reference, current, exclude=DRIFT_EXCLUDE)
    r, c = F.col("ref_n") > 0, F.col("cur_n") > 0
    return P.bucket_counts(tagged, profiles).groupBy("feature").agg(
        F.count("*").alias("buckets"), F.count_if(r & c).alias("shared"),
        F.count_if(r & ~c).alias("reference_only"), F.count_if(~r & c).alias("current_only"),
    )


@query("jn_7_typed_report", WITH + """
SELECT feature, round(psi_all, 6) + 0.0 AS psi, CASE drift_type WHEN 'none' THEN 'unclassified' ELSE drift_type END AS type,
  round(CASE WHEN psi_all >= 0.1 THEN psi_non_null END, 6) + 0.0 AS psi_non_null FROM typed WHERE psi_all IS NOT NULL""")
def typed_report(spark, sf_dir):
    """The report joined to a decomposition that covers only features worth decomposing."""
    drift = drift_rows(spark, sf_dir)
    report = drift.select("feature", "psi_all")
    decomposition = drift.where(F.col("psi_all") >= S.STABLE_BELOW).select(
        "feature", "psi_non_null", F.lit(True).alias("decomposed")
    )
    joined = report.join(F.broadcast(decomposition), "feature", "left").withColumn(
        "decomposed", F.coalesce("decomposed", F.lit(False))
    )
    typed = P.classify_drift(joined).where(F.col("psi_all").isNotNull())
    kind = F.when(F.col("drift_type") == "none", "unclassified").otherwise(F.col("drift_type"))
    return typed.select("feature", r6("psi_all").alias("psi"), kind.alias("type"),
                        r6("psi_non_null").alias("psi_non_null"))


@query("srt_3_missing_last", WITH + """
SELECT feature, CAST(row_number() OVER (ORDER BY psi_all DESC NULLS LAST, feature) AS BIGINT) AS position FROM drift_rows""")
def missing_last(spark, sf_dir):
    from pyspark.sql import Window

    # One row per feature by construction, so a single ordered window is safe.
    order = Window.orderBy(F.desc_nulls_last("psi_all"), "feature")
    return drift_rows(spark, sf_dir).select("feature", F.row_number().over(order).cast("bigint").alias("position"))


@query("prd_4_psi_band", WITH + "SELECT feature, band FROM drift_rows")
def psi_band(spark, sf_dir):
    return drift_rows(spark, sf_dir).select("feature", S.psi_band(F.col("psi_all")).alias("band"))


@query("prj_4_psi_routing", WITH + "SELECT feature, kind FROM drift_rows WHERE na_rate_reference >= 0")
def psi_routing(spark, sf_dir):
    """The route of each shared feature beside its populated count, so the tables are read."""
    reference, current = drift_sides(spark, sf_dir)
    profiles, _ = P.profile_features(reference, current, exclude=DRIFT_EXCLUDE)
    rows = [(p.feature, p.kind) for p in profiles.values() if p.rows[0] > 0]
    return small_table(spark, rows, "feature string, kind string")


@query("prj_5_scoreable_columns", """
SELECT position, feature, populated FROM (VALUES
  (0::BIGINT, 'l_quantity', (SELECT count(l_quantity) FROM lineitem)),
  (1, 'l_discount', (SELECT count(l_discount) FROM lineitem)),
  (2, 'l_returnflag', (SELECT count(l_returnflag) FROM lineitem))) t(position, feature, populated)""")
def scoreable_columns(spark, sf_dir):
    """Reference order, shared with the current frame, id columns excluded."""
    from tidemark.workload.base import table

    lines = table(spark, sf_dir, "lineitem")
    reference = lines.select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    current = lines.select("l_returnflag", "l_discount", "l_quantity", "l_orderkey")
    names = list(P.scoreable_features(reference, current, exclude=["l_orderkey"]))
    counts = reference.agg(*[F.count(n).alias(n) for n in names])
    entries = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(n).alias("feature"), F.col(n).alias("populated"))
        for i, n in enumerate(names)
    ])
    return counts.select(F.inline(entries))


@query("flt_6_populated_rows", "WITH " + DRIFT_SQL + """
SELECT 'f_cover' AS feature, split, count(f_cover) AS populated FROM drift GROUP BY split UNION ALL
SELECT 'f_value', split, count(f_value) FROM drift GROUP BY split""")
def populated_rows(spark, sf_dir):
    long = drift_view(spark, sf_dir).select("split", "f_cover", "f_value").unpivot(
        "split", ["f_cover", "f_value"], "feature", "value"
    )
    return long.where(F.col("value").isNotNull()).groupBy("feature", "split").agg(F.count("*").alias("populated"))


# --- a table as wide as the published sweep: 431 features ----------------------------------

WIDE = 431

_WIDE_COLUMNS = ", ".join(
    f"CAST((l_partkey * {i + 1} + l_suppkey * 7 + CAST(l_quantity AS BIGINT) * CASE WHEN dt >= m4 THEN {1 + i % 3} ELSE 1 END) % {50 + i} AS DOUBLE)"
    f" AS w{i}" for i in range(WIDE)
)


@query("psi_5_wide_sweep", "WITH " + DRIFT_SQL.split("cut AS")[0].rstrip().rstrip(",") + f""",
wide AS (SELECT CASE WHEN dt < m3 THEN 'train' ELSE 'stream' END AS split, {_WIDE_COLUMNS} FROM li, bounds WHERE dt < m3 OR dt >= m4),
long AS (SELECT split, feature, value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE (split)) INTO NAME feature VALUE value)),
q AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0,.1,.2,.3,.4,.5,.6,.7,.8,.9,1]))) AS e FROM long WHERE split = 'train' GROUP BY 1),
cnt AS (SELECT feature, split, value, count(*) AS k FROM long GROUP BY ALL),
bins AS (SELECT feature, len(list_filter(e[2:len(e)-1], lambda x: value > x)) AS bucket,
  sum(k) FILTER (split = 'train') AS r, sum(k) FILTER (split = 'stream') AS c FROM cnt JOIN q USING (feature) WHERE len(e) >= 3 GROUP BY ALL),
tot AS (SELECT feature, sum(r) AS nr, sum(c) AS nc FROM bins GROUP BY 1),
s AS (SELECT feature, greatest(coalesce(r, 0) / nr, 1e-6) AS a, greatest(coalesce(c, 0) / nc, 1e-6) AS b FROM bins JOIN tot USING (feature))
SELECT feature, round(sum((b - a) * ln(b / a)), 6) + 0.0 AS psi FROM s GROUP BY 1""")
def wide_sweep(spark, sf_dir):
    """The report over a table with as many features as the published sweep had."""
    from tidemark.operators.splits import take_split
    from tidemark.workload.base import table
    from tidemark.workload.fixtures import line_bounds

    bounds = line_bounds(spark, sf_dir)
    # The given file is one row group; spread its narrow rows before they are made wide.
    lines = table(spark, sf_dir, "lineitem").repartition(spark.sparkContext.defaultParallelism)

    def side(name: str):
        late = name == "stream"
        return take_split(lines, "l_shipdate", bounds, name).selectExpr(*[
            f"CAST((l_partkey * {i + 1} + l_suppkey * 7 + CAST(l_quantity AS BIGINT) * {1 + i % 3 if late else 1})"
            f" % {50 + i} AS DOUBLE) AS w{i}"
            for i in range(WIDE)
        ])

    return P.psi_report(side("train"), side("stream")).select("feature", r6("psi").alias("psi"))
