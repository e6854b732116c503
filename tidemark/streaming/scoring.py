"""The scoring stream: decide with one model, record another, write each batch once.

The same ``score_rows`` serves batches and streams. Every micro-batch owns one folder
of the audit table and one of the unseen table and overwrites it, so a batch that is
replayed after a failure leaves the same rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import scalar as S
from tidemark.operators.encoding import EncoderModel
from tidemark.plans import explain as XP
from tidemark.plans.boosting import BoostedTrees
from tidemark.plans.training import TreeInputs
from tidemark.plans.trees import evaluate, tree_tables
from tidemark.session import small_table
from tidemark.streaming.feed import CORRUPT

AUDIT_SCHEMA = (
    "id bigint, scored_at timestamp, transaction_id string, transaction_dt double, fraud_probability double, decision string, "
    "threshold double, model_version string, n_trees int, unseen_categories array<string>, "
    "top_factors array<struct<feature string, value string, contribution double, direction string>>, "
    "challenger_version string, "
    "challenger_probability double, challenger_decision string, challenger_threshold double, true_label int, "
    "latency_ms double, batch_id bigint"
)
FACTORS = "array<struct<feature:string,value:string,contribution:double,direction:string>>"
STATS_SCHEMA = "messages bigint, scored bigint, errors bigint, elapsed_s double, through bigint, batch_id bigint"
UNSEEN_SCHEMA = "feature string, value string, occurrences bigint, batch_id bigint"


@dataclass(frozen=True)
class Scorer:
    """A model at its own threshold.

    ``probability`` is a column over the encoded features, ``factors`` the explanation
    recorded beside a decision (feature, value, contribution, direction).
    """

    version: str
    threshold: float
    probability: Callable[[], Column]
    trees: int | None = None
    factors: Callable[[], Column] | None = None


def tree_scorer(version: str, threshold: float, model: GBTClassificationModel | BoostedTrees, inputs: TreeInputs,
                encoder: EncoderModel, top: int = 5) -> Scorer:
    """A fitted booster that gives the probability and its explanation from one Arrow pass."""
    tables, owner = tree_tables(model), np.asarray(inputs.owner())
    names = list(inputs.names)

    @F.pandas_udf(T.StructType.fromDDL("probability double, phi array<double>"))
    def run(rows: pd.Series) -> pd.DataFrame:
        phi, _, margin = evaluate(tables, np.stack(rows.to_numpy()), owner)
        return pd.DataFrame({"probability": 1.0 / (1.0 + np.exp(-margin)), "phi": list(phi)})

    def scored() -> Column:
        return run(F.array(*inputs.expressions()))

    labels = {n: encoder.decode(n, F.col(f"`{n}`")) for n in names}

    def factors() -> Column:
        text = F.create_map(*[x for n in names for x in (F.lit(n), labels[n])])
        return F.transform(XP.top_factors(scored()["phi"], names, top), lambda e: F.struct(
            e["feature"].alias("feature"), F.try_element_at(text, e["feature"]).alias("value"),
            F.round(e["contribution"], 6).alias("contribution"), e["direction"].alias("direction")))

    return Scorer(version, threshold, lambda: scored()["probability"], len(tables.trees), factors)


def guarded(score: Callable[[pd.DataFrame], np.ndarray], columns: list[str]) -> Callable[[], Column]:
    """A challenger's score as a pandas UDF: rows that fail become NULL, nothing else changes.

    A batch that raises is halved until only the rows that raise are left without a score. Where the first
    half is scored, what raised is in the second, which is halved again without being tried whole.
    """

    def attempt(rows: pd.DataFrame) -> np.ndarray:
        values, names = rows.to_numpy(), rows.columns
        scores = np.full(len(values), np.nan)

        def part(a: int, b: int, untried: bool = True) -> bool:
            if untried or b - a == 1:
                try:
                    scores[a:b] = np.asarray(score(pd.DataFrame(values[a:b], columns=names)), dtype=float)
                    return True
                except Exception:
                    scores[a:b] = np.nan
            if b - a > 1:
                half = a + (b - a) // 2
                part(half, b, untried=not part(a, half))
            return False

        if len(values):
            part(0, len(values))
        return scores

    @F.pandas_udf(T.DoubleType())
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(attempt(rows))

    return lambda: run(F.struct(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]))


def score_rows(rows: DataFrame, encoder: EncoderModel, champion: Scorer, challenger: Scorer | None,
               id_column: str, time_column: str, label: str | None, beside: tuple[str, ...] = ()) -> DataFrame:
    """Audit columns for parsed rows, with the (feature, value) pairs nobody has seen.

    Only the encoder's own features reach a model; the label, and the columns named in ``beside``, are carried along.
    """
    carried = [
        *beside,
        F.col(id_column).cast("string").alias("__id"),
        F.col(time_column).cast("double").alias("__dt"),
        (F.col(label).cast("int") if label else F.lit(None).cast("int")).alias("__label"),
        F.create_map(*[x for n in encoder.categorical for x in (F.lit(n), F.col(f"`{n}`").cast("string"))]).alias("__raw")
        if encoder.categorical else F.lit(None).cast("map<string,string>").alias("__raw"),
    ]
    encoded = encoder.transform(rows, keep=carried, states=True)
    scored = encoded.withColumns({
        "__p": champion.probability(),
        "__factors": champion.factors() if champion.factors else F.array().cast(FACTORS),
    })
    shadow = challenger.probability() if challenger else F.lit(None).cast("double")
    scored = scored.withColumn("__q", shadow)
    c = F.col
    seen = c("__q").isNotNull() & ~F.isnan("__q")

    def recorded(value) -> Column:
        return F.when(seen, value)

    return scored.select(
        c("__id").alias("transaction_id"), c("__dt").alias("transaction_dt"),
        F.round("__p", 6).alias("fraud_probability"),
        S.decision(c("__p"), F.lit(champion.threshold)).alias("decision"),
        F.lit(round(champion.threshold, 6)).alias("threshold"),
        F.lit(champion.version).alias("model_version"),
        F.lit(champion.trees).cast("int").alias("n_trees"),
        c("unseen").alias("unseen_categories"),
        c("__factors").alias("top_factors"),
        recorded(F.lit(challenger.version if challenger else None).cast("string")).alias("challenger_version"),
        recorded(F.round("__q", 6)).alias("challenger_probability"),
        recorded(S.decision(c("__q"), F.lit(challenger.threshold if challenger else 0.0))).alias("challenger_decision"),
        recorded(F.lit(round(challenger.threshold, 6) if challenger else None).cast("double")).alias("challenger_threshold"),
        c("__label").alias("true_label"),
        F.transform("unseen", lambda f: F.struct(f.alias("feature"), F.try_element_at(c("__raw"), f).alias("value")))
        .alias("__unseen"),
        *beside,
    )


def unseen_counts(scored: DataFrame, pairs: str = "__unseen") -> DataFrame:
    return scored.select(F.inline(pairs)).groupBy("feature", "value").agg(F.count("*").alias("occurrences"))


def _nanoseconds() -> Column:
    """The executor's clock at the moment a row passes, unlike a timestamp, which a query reads once."""
    return F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("bigint")


@dataclass(frozen=True)
class AuditSink:
    """Writes one micro-batch: audit rows, unseen counts, message statistics.

    Every row meets the models once: what nobody has seen is counted from the rows as written. Ids go on
    without gaps from those of the batch before, so a replayed batch gets the same ones, whatever the size of
    its partitions. ``latency_ms`` is the time from a row's entry into scoring to its decision.
    """

    root: str
    encoder: EncoderModel
    champion: Scorer
    challenger: Scorer | None
    id_column: str
    time_column: str
    label: str | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        started = time.perf_counter()
        spark = batch.sparkSession
        batch.persist()
        try:
            whole = F.col(CORRUPT).isNull()
            parts = batch.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("messages"), F.count_if(whole).alias("good")).collect()
            before, messages, scored_rows = self._through(spark, batch_id), sum(r["messages"] for r in parts), sum(r["good"] for r in parts)
            entered = batch.where(whole).drop(CORRUPT).withColumns({"__number": _number({r["p"]: r["good"] for r in parts}, before), "__entered": _nanoseconds()})
            scored = score_rows(entered, self.encoder, self.champion, self.challenger,
                                self.id_column, self.time_column, self.label, ("__number", "__entered"))
            audit = scored.withColumns({
                "id": F.col("__number"), "scored_at": F.current_timestamp(),
                "latency_ms": (_nanoseconds() - F.col("__entered")) / F.lit(1e6)}).withColumnRenamed("__unseen", "unseen_values").drop("__number", "__entered")
            written = f"{self.root}/audit/batch_id={batch_id}"
            audit.write.mode("overwrite").parquet(written)
            kept = spark.read.schema(audit.select("unseen_values").schema).parquet(written)
            unseen_counts(kept, "unseen_values").write.mode("overwrite").parquet(f"{self.root}/unseen/batch_id={batch_id}")
            row = (messages, scored_rows, messages - scored_rows, time.perf_counter() - started, before + scored_rows)
            small_table(spark, [row], STATS_SCHEMA.removesuffix(", batch_id bigint")).write.mode("overwrite").parquet(f"{self.root}/stats/batch_id={batch_id}")
        finally:
            batch.unpersist()

    def _through(self, spark, batch_id: int) -> int:
        """The last id of the batch before."""
        from tidemark.sources.tables import read_or_empty

        row = read_or_empty(spark, f"{self.root}/stats/batch_id={batch_id - 1}", "through bigint").first() if batch_id else None
        return row["through"] if row else 0


def _number(rows: dict[int, int], before: int) -> Column:
    """Consecutive numbers after ``before``: rows of earlier partitions, then the place within the partition."""
    first, total = [], before
    for p in range(max(rows, default=-1) + 1):
        first.append(str(total))
        total += rows.get(p, 0)
    start = F.get(F.split(F.lit(",".join(first)), ","), F.spark_partition_id()).cast("bigint")
    return start + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1


def run_scoring(parsed: DataFrame, sink: AuditSink, available_now: bool = True) -> StreamingQuery:
    """Start the stream; the checkpoint below the sink's root commits a batch after its files are written."""
    writer = parsed.writeStream.foreachBatch(sink).option("checkpointLocation", f"{sink.root}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_audit(spark, root: str) -> DataFrame:
    from tidemark.sources.tables import read_or_empty

    return read_or_empty(spark, f"{root}/audit", AUDIT_SCHEMA)


def activity_windows(scored: DataFrame, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Streaming tumbling buckets; the watermark only bounds the state."""
    return (
        scored.withWatermark("scored_at", late)
        .groupBy(F.window("scored_at", width).alias("w"))
        .agg(F.count("*").alias("scored"), F.count_if(F.col("decision") == "BLOCK").alias("blocked"))
        .select(S.epoch_seconds(F.col("w.start")).alias("bucket_start"), "scored", "blocked")
    )
