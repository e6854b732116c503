"""Dense row numbers in a global order, without a single sorted partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import enable_checkpoints


def ordered_index(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), output: str = "index",
                  partitions: int | None = None) -> DataFrame:
    """Adds 0-based numbers in ``order`` (names or sort expressions) within ``by``.

    Range-partitioned rows are pinned with a reliable checkpoint, so that the partition
    each row sits in cannot change between counting and numbering.
    """
    spark = df.sparkSession
    enable_checkpoints(spark)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [*[F.col(c) for c in by], *order]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pinned = (
        df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()).checkpoint()
    )
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pinned.groupBy(*by, "__part").agg(F.count("*").alias("__n")).select(
        *by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    within = Window.partitionBy(*by, "__part").orderBy(*order)
    return (
        pinned.withColumn("__row", F.row_number().over(within) - 1)
        # one row per partition and group
        .join(offsets, [*by, "__part"])
        .withColumn(output, F.col("__row") + F.col("__offset"))
        .drop("__part", "__row", "__offset")
    )
