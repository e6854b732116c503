"""Batch sources and sinks: Parquet splits, CSV, append-only tables, reports."""

from __future__ import annotations

import contextlib
import time
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar as S
from tidemark.operators.splits import SplitBoundaries, split_name


def read_split(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               sample: int | None = None, order: list[str] | None = None) -> DataFrame:
    """A Parquet split; ``sample`` takes the first rows in a stated order, for smoke tests only."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    if sample is None:
        return df
    if not order:
        raise ValueError("a sample needs an order to be repeatable")
    return df.orderBy(*order).limit(sample)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A headed CSV under an explicit schema, with gaps as NULL."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.select(*[S.missing_as_null(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An absent store is a normal state: an empty frame of the right shape."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class TableStore:
    """Append-only Parquet tables below one shared folder."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, name: str, schema: str) -> DataFrame:
        return read_or_empty(self.spark, self.path(name), schema)

    def append(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        df.write.mode("append").partitionBy(*partition_by).parquet(self.path(name))

    def claim(self, name: str) -> bool:
        """Create the empty file ``claims/<name>``; False if it is there. Of several writers one wins."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(f"claims/{name}"))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(path.getParent())
        try:
            if fs.getUri().getScheme() == "file":
                # Hadoop's local file system looks first and creates then; the operating system does both at once
                none = self.spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
                jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Paths.get(path.toUri().getPath(), self._no_strings()), none)
            else:
                fs.create(path, False).close()
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def _no_strings(self):
        return self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 0)

    def release(self, name: str) -> None:
        """Give a claim back after the work it stood for failed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(f"claims/{name}"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)

    def take_numbers(self, name: str, last: int, count: int = 1) -> list[int]:
        """The next free numbers after ``last``, each claimed, so that no two writers use one."""
        taken, number = [], last
        while len(taken) < count:
            number += 1
            if self.claim(f"{name}/{number}"):
                taken.append(number)
        return taken

    def append_numbered(self, name: str, row: DataFrame, schema: str) -> int:
        """Append a one-row frame under the next id; writers at the same time get different ids."""
        last = self.read(name, schema).agg(F.max("id")).first()[0] or 0
        number = self.take_numbers(name, last)[0]
        self.append(name, row.withColumn("id", F.lit(number).cast("bigint")).select(
            *T.StructType.fromDDL(schema).fieldNames()
        ))
        return number


ALERT_SCHEMA = (
    "id bigint, created_at timestamp, window_label string, window_start_dt double, window_end_dt double, "
    "window_rows bigint, reference_rows bigint, overall_psi double, overall_psi_feature string, "
    "value_drift_psi double, value_drift_features bigint, missingness_psi double, missingness_features bigint, "
    "n_major bigint, n_moderate bigint, n_stable bigint, n_unmeasurable bigint, threshold double, "
    "retrain_triggered boolean, investigate_pipeline boolean, verdict string, "
    "top_features array<struct<feature string, psi double, type string, psi_non_null double, "
    "na_rate_reference double, na_rate_current double>>, "
    "value_drift_feature_list array<string>, missingness_feature_list array<string>, unseen_categories string"
)
UNSEEN_SCHEMA = (
    "observed_at timestamp, feature string, value string, occurrences bigint, model_version string, source string"
)
RESOLUTION_SCHEMA = "alert_id bigint, resolved_at timestamp, run_id string, model_version string"
COMPARISON_SCHEMA = (
    "id bigint, promoted_at timestamp, from_version string, to_version string, trigger_alert_id bigint, "
    "comparison_rows bigint, comparison_positives bigint, comparison_fraud_rate double, champion_pr_auc double, "
    "challenger_pr_auc double, pr_auc_delta double, bootstrap_std_error double, margin_in_ses double, "
    "leakage_checked boolean, verdict string"
)
RUN_SCHEMA = "run_id string, kind string, key string, value string"


def latest(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The newest rows; planned as a top-n, not a sort."""
    return df.orderBy(F.desc(key)).limit(n)


def next_id(df: DataFrame, key: str = "id") -> int:
    return (df.agg(F.max(key)).first()[0] or 0) + 1


def record_unseen(store: TableStore, counts: DataFrame, model_version: str, source: str) -> None:
    """(feature, value, occurrences) of one batch, stamped and appended."""
    store.append("unseen_observations", counts.select(
        F.current_timestamp().alias("observed_at"), "feature", "value",
        F.col("occurrences").cast("bigint").alias("occurrences"),
        F.lit(model_version).alias("model_version"), F.lit(source).alias("source"),
    ))


def write_splits(df: DataFrame, time_column: str, bounds: SplitBoundaries, path: str) -> None:
    """Parquet partitioned by split."""
    df.withColumn("split", split_name(df, time_column, bounds)).write.mode("overwrite").partitionBy(
        "split"
    ).parquet(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    """A report whose rows are bounded by the schema, as one headed file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def flatten_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., key, value): every finite numeric leaf of the nested columns, dotted.

    Flags, text and lists are not metrics; NULL, NaN and infinities are dropped.
    """
    leaves: list[tuple[str, str]] = []

    def walk(prefix: str, path: str, data_type: T.DataType) -> None:
        if isinstance(data_type, T.StructType):
            for f in data_type.fields:
                walk(f"{prefix}.{f.name}" if prefix else f.name, f"{path}.`{f.name}`" if path else f"`{f.name}`",
                     f.dataType)
        elif isinstance(data_type, T.NumericType):
            leaves.append((prefix, path))

    for f in df.schema.fields:
        if f.name not in keys:
            walk(f.name, f"`{f.name}`", f.dataType)
    entries = F.array(*[
        F.struct(F.lit(name).alias("key"), F.col(path).cast("double").alias("value")) for name, path in leaves
    ])
    finite = ~F.isnan("value") & (F.abs("value") != float("inf"))
    return df.select(*keys, F.inline(entries)).where(F.col("value").isNotNull() & finite)


def record_run(store: TableStore, run_id: str, params: dict, metrics: DataFrame | None = None) -> None:
    """One run as rows: its parameters, and the numeric leaves of its metrics."""
    rows = [(run_id, "param", str(k), None if v is None else str(v)) for k, v in params.items()]
    frame = store.spark.createDataFrame(rows, RUN_SCHEMA)
    if metrics is not None:
        flat = flatten_metrics(metrics, []).select(
            F.lit(run_id).alias("run_id"), F.lit("metric").alias("kind"), "key",
            F.col("value").cast("string").alias("value"),
        )
        frame = frame.unionByName(flat)
    store.append("runs", frame)


@contextlib.contextmanager
def timed(sink: dict[str, float], name: str):
    start = time.perf_counter()
    yield
    sink[name] = time.perf_counter() - start
