"""Event feeds: ordered replay of a table, topic and file sources, tolerant parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar as S
from tidemark.operators.ordering import ordered_index
from tidemark.operators.splits import starting_at
from tidemark.session import materialise

CORRUPT = "_corrupt_record"


def to_messages(df: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """(keep..., key, value): JSON objects that simply omit missing fields."""
    clean = [S.missing_as_null(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(*keep, F.col(key).cast("string").alias("key"), F.to_json(F.struct(*clean)).alias("value"))


def write_topic(messages: DataFrame, servers: str, topic: str) -> None:
    """Messages into a Kafka topic (needs the Kafka connector on the classpath)."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write_feed(df: DataFrame, time: str, tie: list[str], key: str, path: str, slices: int = 8,
               limit: int | None = None, start: float | None = None, files: int = 4) -> int:
    """Replay a table as text files of JSON messages, oldest first; returns the number of slices.

    Rows are numbered once in replay order and carry the number as ``sequence``. Slices are ranges
    of it, written one after another with `files` files each; a reader that takes a slice per batch
    gets the batches in order, and the number orders the rows of a batch.
    """
    if start is not None:
        df = starting_at(df, time, start)
    numbered = materialise(ordered_index(df, [time, *tie], output="sequence"), "replay")
    rows = numbered.count()
    if limit is not None:
        rows = min(rows, limit)
    step = max(1, -(-rows // slices))
    begins = range(0, rows, step)
    for begin in begins:
        part = numbered.where((F.col("sequence") >= begin) & (F.col("sequence") < min(begin + step, rows)))
        ordered = part.repartitionByRange(files, "sequence").sortWithinPartitions("sequence")
        to_messages(ordered, key).select("value").write.mode("append").text(path)
    return len(begins)


def read_feed(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """File feed as a stream of (value), oldest files first."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def read_topic(spark: SparkSession, servers: str, topic: str, rows_per_batch: int = 100_000, **options) -> DataFrame:
    """Kafka topic from the earliest offset; offsets are committed by the checkpoint, after the write."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", rows_per_batch)
        .options(**options).load()
        .select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    )


def parse_messages(messages: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Typed columns plus ``_corrupt_record``; absent keys are NULL, extra keys are ignored."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    named = messages.select(parsed.alias("m"), "value")
    broken = F.when(F.col("m").isNull() | F.col(f"m.{CORRUPT}").isNotNull(), F.coalesce(f"m.{CORRUPT}", "value"))
    return named.select(*[F.col(f"m.`{f.name}`") for f in fields.fields], broken.alias(CORRUPT))
