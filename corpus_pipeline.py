"""The corpus pipeline: quality rules, line dedup, near-duplicates, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; each is written as Parquet
below the shared folder and read again as the documents of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import lines, packing, quality, secrets, simhash
from tidemark.llm.common import settle
from tidemark.session import configure, materialise


def _stage(work):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return work(settle(configure(spark)), docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_rules", _stage(quality.stage)),
    ("line_dedup", _stage(lines.stage)),
    ("near_duplicates", _stage(simhash.stage)),
    ("secret_scan", _stage(secrets.stage)),
    ("packing", _stage(packing.stage)),
]

#: Tokenising and the network of the secret scan are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; the pieces of the packed sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = materialise(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
