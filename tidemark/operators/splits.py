"""Time-ordered routing: half-open splits, replay bounds, recent windows, hold-outs.

Bounds are found by one narrow aggregate and then applied as literals of the time
column's own type, so every filter here is pushed into the Parquet scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import SECONDS_PER_DAY, epoch_seconds
from tidemark.operators.order_stats import exact_quantiles, order_statistics


class EmptyWindowError(ValueError):
    """A time bound left no rows."""


@dataclass(frozen=True)
class SplitBoundaries:
    """Extent of the event time and the two cut points at sixths 3 and 4."""

    low: float
    high: float
    month3_end: float
    month4_end: float

    @property
    def span_days(self) -> float:
        return (self.high - self.low) / SECONDS_PER_DAY


def _is_clock(df: DataFrame, time: str) -> bool:
    return isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType))


# Bits of the stored integer types, sign included.
_INTEGER_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _is_date(df: DataFrame, time: str) -> bool:
    return isinstance(df.schema[time].dataType, T.DateType)


def _as_seconds(column: Column, df: DataFrame, time: str) -> Column:
    if _is_clock(df, time):
        return epoch_seconds(column)
    return F.unix_date(column) * float(SECONDS_PER_DAY) if _is_date(df, time) else column.cast("double")


def seconds(df: DataFrame, time: str) -> Column:
    """The time column as seconds, whatever its stored type; a date is its midnight."""
    return _as_seconds(F.col(time), df, time)


def moment(df: DataFrame, time: str, value: float) -> Column:
    """A literal of the stored type that splits rows by ``>=`` and ``<`` as ``value`` seconds would.

    Integers and dates take the next whole step, so the column is never cast and the bound is pushed down.
    """
    kind = df.schema[time].dataType
    if _is_clock(df, time):
        literal = F.timestamp_micros(F.lit(int(round(value * 1_000_000))))
        return literal.cast(kind)
    if _is_date(df, time):
        return F.date_from_unix_date(F.lit(math.ceil(value / SECONDS_PER_DAY)))
    bits = _INTEGER_BITS.get(kind.simpleString())
    if bits and -(1 << (bits - 1)) <= math.ceil(value) < 1 << (bits - 1):
        return F.lit(math.ceil(value)).cast(kind)
    return F.lit(float(value))


def time_extent(df: DataFrame, time: str) -> tuple[float, float]:
    row = (
        df.agg(F.min(time).alias("low"), F.max(time).alias("high"))
        .select(seconds_of("low", df, time), seconds_of("high", df, time))
        .first()
    )
    if row[0] is None:
        raise EmptyWindowError("no populated event time")
    return row[0], row[1]


def seconds_of(name: str, df: DataFrame, time: str) -> Column:
    """Like :func:`seconds` for a column derived from the time column."""
    return _as_seconds(F.col(name), df, time).alias(name)


def sixths(low: float, high: float) -> SplitBoundaries:
    step = (high - low) / 6
    return SplitBoundaries(low, high, low + step * 3, low + step * 4)


def split_boundaries(df: DataFrame, time: str) -> SplitBoundaries:
    return sixths(*time_extent(df, time))


def split_name(df: DataFrame, time: str, bounds: SplitBoundaries) -> Column:
    """Half-open routing: a row on a cut belongs to the later split."""
    return (
        F.when(F.col(time) < moment(df, time, bounds.month3_end), "train")
        .when(F.col(time) < moment(df, time, bounds.month4_end), "val")
        .otherwise("stream")
    )


def take_split(df: DataFrame, time: str, bounds: SplitBoundaries, name: str) -> DataFrame:
    low, high = {
        "train": (None, bounds.month3_end),
        "val": (bounds.month3_end, bounds.month4_end),
        "stream": (bounds.month4_end, None),
    }[name]
    if low is not None:
        df = df.where(F.col(time) >= moment(df, time, low))
    if high is not None:
        df = df.where(F.col(time) < moment(df, time, high))
    return df


def _must_have_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise EmptyWindowError(what)
    return df


def starting_at(df: DataFrame, time: str, start: float) -> DataFrame:
    return _must_have_rows(df.where(F.col(time) >= moment(df, time, start)), f"no rows from {start}")


def ending_before(df: DataFrame, time: str, end: float) -> DataFrame:
    return _must_have_rows(df.where(F.col(time) < moment(df, time, end)), f"no rows before {end}")


def recent_days(df: DataFrame, time: str, days: float) -> DataFrame:
    """The newest ``days`` of event time, at most the whole extent."""
    low, high = time_extent(df, time)
    cutoff = high - min(days * SECONDS_PER_DAY, high - low)
    return df.where(F.col(time) >= moment(df, time, cutoff))


def recent_rows(df: DataFrame, time: str, rows: int) -> DataFrame:
    """The newest ``rows`` rows by time; rows tied with the oldest of them stay."""
    if rows < 1:
        raise EmptyWindowError("a row window needs at least one row")
    numeric = df.select(seconds(df, time).alias("t"))
    at = order_statistics(numeric, {"t": lambda n: [max(0, n - rows)] if n else []})["t"]
    if not at:
        raise EmptyWindowError("no populated event time")
    return df.where(F.col(time) >= moment(df, time, next(iter(at.values()))))


def quantile_cut(df: DataFrame, time: str, probability: float) -> float:
    numeric = df.select(seconds(df, time).alias("t"))
    values = exact_quantiles(numeric, ["t"], [probability])["t"]
    if values is None:
        raise EmptyWindowError("no populated event time")
    return values[0]


def temporal_holdout(df: DataFrame, time: str, fraction: float) -> tuple[DataFrame, DataFrame, float]:
    """(earlier, later, cutoff): the later slice starts at the time quantile; ties go later."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must lie strictly between 0 and 1")
    if time not in df.columns:
        raise ValueError(f"no time column {time!r}")
    cutoff = quantile_cut(df, time, 1.0 - fraction)
    at = moment(df, time, cutoff)
    earlier, later = df.where(F.col(time) < at), df.where(F.col(time) >= at)
    _must_have_rows(earlier, "the earlier side of the carve is empty")
    _must_have_rows(later, "the later side of the carve is empty")
    return earlier, later, cutoff


@dataclass(frozen=True)
class RetrainWindow:
    fit: DataFrame
    stop: DataFrame
    evaluation: DataFrame
    start: float
    end: float
    rows: int


def recent_training_window(
    sources: dict[str, DataFrame],
    time: str,
    days: float,
    end: float | None = None,
    evaluation_fraction: float = 0.15,
    stop_fraction: float = 0.15,
    min_rows: int = 1_000,
) -> RetrainWindow:
    """Union the labelled sources, keep the recent window, carve fit / stop / evaluation."""
    window = union_sources(sources)
    if end is not None:
        window = ending_before(window, time, end)
    window = recent_days(window, time, days)
    size = window.agg(
        F.count("*").alias("n"), F.min(time).alias("low"), F.max(time).alias("high")
    ).select("n", seconds_of("low", window, time), seconds_of("high", window, time)).first()
    if size["n"] < min_rows:
        raise EmptyWindowError(f"{size['n']} rows in the window, need {min_rows}")
    head, evaluation, _ = temporal_holdout(window, time, evaluation_fraction)
    fit, stop, _ = temporal_holdout(head, time, stop_fraction)
    return RetrainWindow(fit, stop, evaluation, size["low"], size["high"], size["n"])


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Union-all aligned by name, each row tagged with the source it came from."""
    if not sources:
        raise EmptyWindowError("no labelled source")
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def replay_order(df: DataFrame, time: str, tie: list[str], limit: int | None = None,
                 start: float | None = None) -> DataFrame:
    """Event-time order with an explicit tie-break; optionally the earliest rows only."""
    if start is not None:
        df = starting_at(df, time, start)
    ordered = df.orderBy(F.col(time).asc(), *[F.col(t).asc() for t in tie])
    return ordered.limit(limit) if limit is not None else ordered


def partition_check(whole: DataFrame, earlier: DataFrame, later: DataFrame, key: list[str]) -> DataFrame:
    """One row: sizes of the parts, rows in both, rows of the whole in neither, and the verdict."""
    tagged = (
        whole.select(*key, F.lit("whole").alias("part"))
        .unionByName(earlier.select(*key, F.lit("earlier").alias("part")))
        .unionByName(later.select(*key, F.lit("later").alias("part")))
    )
    per_key = tagged.groupBy(*key).agg(
        F.count_if(F.col("part") == "whole").alias("w"),
        F.count_if(F.col("part") == "earlier").alias("e"),
        F.count_if(F.col("part") == "later").alias("l"),
    )
    sums = per_key.agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("whole_rows"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("earlier_rows"),
        F.coalesce(F.sum("l"), F.lit(0)).alias("later_rows"),
        F.coalesce(F.sum(F.abs(F.col("w") - F.col("e") - F.col("l"))), F.lit(0)).alias("mismatched_rows"),
        F.count_if((F.col("e") > 0) & (F.col("l") > 0)).alias("keys_in_both"),
    )
    return sums.withColumn(
        "is_partition", (F.col("mismatched_rows") == 0) & (F.col("keys_in_both") == 0)
    )
