"""Column histograms, exact order statistics and exact quantiles of many columns at once.

Spark's exact ``percentile`` keeps one hash map of distinct values per column in one
task. Here the search for a rank is *narrowed*: cut points guessed from a sample split
each column into intervals, one pass counts them exactly, intervals that hold a wanted
rank are cut again until they are small, and only their values are sorted at the end.
The guess decides how fast this ends, never what it returns. A value that fills a third
of the table becomes an interval of its own and is never sorted. A column of few distinct
values needs none of this: the first pass counts its values outright, and ranks and
intervals follow from the counts.

Each pass folds the rows of a partition into counts with numpy over Arrow batches, so a
table of hundreds of columns is neither exploded nor shuffled: a partition sends one
short row per column and interval. What reaches the driver is bounded by
columns x wanted ranks x grid.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import small_table

LEAF_ROWS = 500_000
GRID = 256
SAMPLE_ROWS = 500_000
MISSING = -1
#: Columns with no more distinct values than this are counted by value.
FEW_VALUES = 1_024
#: Whole numbers within such a span are counted by position.
SPAN = 65_536
#: Columns that travel to Python as one array; a writer per column costs several times more.
PACK = 64

COUNTS_SCHEMA = "side string, feature int, counts array<bigint>, low double, high double"
VALUES_SCHEMA = "feature int, interval int, value double, n bigint"
TALLY_SCHEMA = "side string, feature int, missing bigint, n bigint, low double, high double, values array<double>, counts array<bigint>"


@dataclass(frozen=True)
class ColumnSummary:
    """Non-null count and range of one column, and its distinct values with their counts if they are few."""

    count: int
    low: float | None
    high: float | None
    values: tuple[float, ...] | None = None
    counts: tuple[int, ...] | None = None

    def at(self, rank: int) -> float:
        """The value at a 0-based rank, where the values are known."""
        return self.values[int(np.searchsorted(np.cumsum(self.counts), rank, side="right"))]


def as_doubles(columns: Iterable[str]) -> list[str]:
    return [f"nullif(CAST(`{c}` AS DOUBLE), double('NaN'))" for c in columns]


def _packed(columns: list[str]) -> list[str]:
    """The column expressions as a few arrays of doubles."""
    doubles = [f"CAST({c} AS DOUBLE)" for c in columns]
    return [f"array({', '.join(doubles[a : a + PACK])}) AS p{a}" for a in range(0, len(doubles), PACK)]


def _arrays(batch: pa.RecordBatch, first: int):
    """Populated values of each packed column from ``first`` on, with the mask of populated rows."""
    if not batch.num_rows:
        return
    f = 0
    for pack in batch.columns[first:]:
        rows = pack.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for values in np.ascontiguousarray(rows.T):
            yield f, values, ~np.isnan(values)
            f += 1


def histogram(df: DataFrame, columns: list[str], cuts: Mapping[int, list[float]], side: str = "''") -> DataFrame:
    """Counts per (side, feature, interval), with the range of the feature; intervals without rows are left out.

    ``columns`` are SQL expressions of type double; ``feature`` is the position among them
    and ``interval`` the number of the feature's cuts strictly below the value, so interval
    bounds are open on the left and closed on the right. Missing values count as -1.
    A task ships one dense count array per side and feature, whatever the number of intervals;
    the arrays of one feature are added up where the shuffle brings them.
    """
    edges = [np.asarray(cuts.get(i, []), dtype=float) for i in range(len(columns))]

    def run(batches):
        totals: dict[tuple[str, int], np.ndarray] = {}
        ranges: dict[tuple[str, int], list[float]] = {}
        for batch in batches:
            tags = batch.column(0).to_numpy(zero_copy_only=False)
            for tag in dict.fromkeys(tags):
                mine = tags == tag
                every = bool(mine.all())
                for f, values, present in _arrays(batch, 1):
                    if not every:
                        values, present = values[mine], present[mine]
                    populated = values[present]
                    counts = totals.setdefault((tag, f), np.zeros(len(edges[f]) + 2, dtype=np.int64))
                    counts[0] += len(values) - len(populated)
                    if not len(populated):
                        continue
                    if len(edges[f]):
                        at = np.searchsorted(edges[f], populated, side="left")
                        counts[1:] += np.bincount(at, minlength=len(edges[f]) + 1)
                    else:
                        counts[1] += len(populated)
                    low, high = populated.min(), populated.max()
                    known = ranges.setdefault((tag, f), [low, high])
                    known[0], known[1] = min(known[0], low), max(known[1], high)
        yield _count_arrays((*key, counts, *ranges.get(key, (None, None))) for key, counts in totals.items())

    parts = df.selectExpr(f"{side} AS side", *_packed(columns)).mapInArrow(run, COUNTS_SCHEMA)
    summed = parts.repartition("side", "feature").mapInArrow(_add_counts, COUNTS_SCHEMA)
    return summed.select("side", "feature", F.posexplode("counts").alias("i", "n"), "low", "high").where("n > 0").select(
        "side", "feature", (F.col("i") + MISSING).alias("interval"), "n",
        *[F.when(F.col("i") + MISSING >= 0, F.col(c)).alias(c) for c in ("low", "high")])


def _count_arrays(rows: Iterable[tuple]) -> pa.RecordBatch:
    sides, features, counts, low, high = zip(*rows) if (rows := list(rows)) else ((), (), (), (), ())
    ends = np.cumsum([0, *map(len, counts)], dtype=np.int32)
    flat = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(sides, pa.string()), pa.array(features, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
         pa.array(low, pa.float64()), pa.array(high, pa.float64())], ["side", "feature", "counts", "low", "high"])


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the arrays of equal keys; a partition holds as many sums as it has keys."""
    sums: dict[tuple, list] = {}
    for batch in batches:
        arrays, offsets = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
        low, high = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            counts = arrays[offsets[i] : offsets[i + 1]]
            known = sums.get(key)
            if known is None:
                sums[key] = [counts.astype(np.int64), low[i], high[i]]
            else:
                known[0] += counts
                known[1], known[2] = np.fmin(known[1], low[i]), np.fmax(known[2], high[i])
    yield _count_arrays((*key, c, *(None if np.isnan(v) else v for v in ends)) for key, (c, *ends) in sums.items())


class _Tally:
    """Rows and range of one column, and its distinct values as long as they are few."""

    def __init__(self):
        self.missing, self.n, self.low, self.high = 0, 0, math.inf, -math.inf
        self.values: np.ndarray | None = np.zeros(0)
        self.counts = np.zeros(0, np.int64)

    def add(self, missing: int, n: int, low: float, high: float, values: np.ndarray | None, counts: np.ndarray | None, few: int) -> None:
        self.missing, self.n = self.missing + missing, self.n + n
        if not n:
            return
        self.low, self.high = min(self.low, low), max(self.high, high)
        if self.values is None or values is None:
            self.values = None
            return
        at = np.searchsorted(self.values, values)
        if len(self.values) and (self.values[np.minimum(at, len(self.values) - 1)] == values).all():
            self.counts[at] += counts
            return
        merged, place = np.unique(np.concatenate((self.values, values)), return_inverse=True)
        if len(merged) > few:
            self.values = None
            return
        sums = np.zeros(len(merged), np.int64)
        np.add.at(sums, place, np.concatenate((self.counts, counts)))
        self.values, self.counts = merged, sums


def _distinct(values: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and their counts."""
    if max(abs(low), abs(high)) < 2**53 and high - low < SPAN:
        whole = values.astype(np.int64)
        if (whole == values).all():
            counts = np.bincount(whole - int(low))
            at = np.flatnonzero(counts)
            return (at + int(low)).astype(float), counts[at]
    return np.unique(values, return_counts=True)


def _tally_batch(tallies: Mapping[tuple[str, int], _Tally]) -> pa.RecordBatch:
    known = [t.values is not None for t in tallies.values()]
    lists = [
        pa.array([getattr(t, part).tolist() if k else None for t, k in zip(tallies.values(), known)], type=pa.list_(kind))
        for part, kind in (("values", pa.float64()), ("counts", pa.int64()))]
    return pa.RecordBatch.from_arrays(
        [pa.array([s for s, _ in tallies], pa.string()), pa.array([f for _, f in tallies], pa.int32()),
         *[pa.array([getattr(t, part) for t in tallies.values()], pa.int64()) for part in ("missing", "n")],
         *[pa.array([getattr(t, part) if t.n else None for t in tallies.values()], pa.float64()) for part in ("low", "high")], *lists],
        ["side", "feature", "missing", "n", "low", "high", "values", "counts"])


def tally(df: DataFrame, columns: list[str], side: str = "''", few: int = FEW_VALUES) -> DataFrame:
    """One row per (side, feature): missing and populated rows, range, and the distinct values with their counts.

    ``values`` and ``counts`` are NULL where a column has more than ``few`` distinct values; a task
    then keeps none of them, so a task and a row are bounded by columns x ``few``.
    """

    def run(batches):
        found: dict[tuple[str, int], _Tally] = {}
        for batch in batches:
            tags = batch.column(0).to_numpy(zero_copy_only=False)
            for tag in dict.fromkeys(tags):
                mine = tags == tag
                every = bool(mine.all())
                for f, values, present in _arrays(batch, 1):
                    if not every:
                        values, present = values[mine], present[mine]
                    if not present.all():
                        values = values[present]
                    known = found.setdefault((tag, f), _Tally())
                    n = len(values)
                    low, high = (values.min(), values.max()) if n else (math.inf, -math.inf)
                    pair = _distinct(values, low, high) if n and known.values is not None else (None, None)
                    if pair[0] is not None and len(pair[0]) > few:
                        pair = (None, None)
                    known.add(len(present) - n, n, low, high, *pair, few)
        yield _tally_batch(found)

    def add(batches):
        found: dict[tuple[str, int], _Tally] = {}
        for batch in batches:
            numbers = [batch.column(i).to_pylist() for i in range(6)]
            for i, (tag, f, missing, n, low, high) in enumerate(zip(*numbers)):
                known = batch.column(6)[i].is_valid
                pair = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) if known else None for c in (6, 7)]
                found.setdefault((tag, f), _Tally()).add(missing, n, low, high, *pair, few)
        yield _tally_batch(found)

    parts = df.selectExpr(f"{side} AS side", *_packed(columns)).mapInArrow(run, TALLY_SCHEMA)
    return parts.repartition("side", "feature").mapInArrow(add, TALLY_SCHEMA)


def summary_of(row) -> ColumnSummary:
    """A row of :func:`tally` as a summary."""
    known = row["values"] is not None
    return ColumnSummary(row["n"], row["low"], row["high"], tuple(row["values"]) if known else None, tuple(row["counts"]) if known else None)


def values_in(df: DataFrame, columns: list[str], cuts: Mapping[int, list[float]],
              intervals: Mapping[int, set[int]]) -> DataFrame:
    """(feature, interval, value, n) of the values inside the named intervals."""
    wanted = sorted(intervals)
    edges = {f: np.asarray(cuts.get(f, []), dtype=float) for f in wanted}

    def run(batches):
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for j, values, present in _arrays(batch, 0):
                f = wanted[j]
                populated = values[present]
                at = np.searchsorted(edges[f], populated, side="left") if len(edges[f]) else None
                for interval in intervals[f]:
                    inside = populated if at is None else populated[at == interval]
                    distinct, counts = np.unique(inside, return_counts=True)
                    size = len(distinct)
                    parts.append((np.full(size, f, np.int32), np.full(size, interval, np.int32), distinct, counts))
            if not parts:
                continue
            columns_out = [np.concatenate(c) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns_out, (pa.int32(), pa.int32(), pa.float64(), pa.int64()))],
                names=["feature", "interval", "value", "n"])

    parts = df.selectExpr(*_packed([columns[f] for f in wanted])).mapInArrow(run, VALUES_SCHEMA)
    return parts.groupBy("feature", "interval", "value").agg(F.sum("n").alias("n"))


def _record_batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def summarise(df: DataFrame, columns: list[str]) -> dict[int, ColumnSummary]:
    found = {r["feature"]: summary_of(r) for r in tally(df, columns).collect()}
    return {i: found.get(i, ColumnSummary(0, None, None)) for i in range(len(columns))}


def grid_points(grid: int) -> Column:
    """The fractions 1/grid .. (grid-1)/grid as one literal; a literal per point would swell the plan."""
    return F.split(F.lit(",".join(repr(i / grid) for i in range(1, grid))), ",").cast("array<double>")


def _guess(df: DataFrame, columns: list[str], cuts: Mapping[int, list[float]],
           crowded: list[tuple[int, int, int, int, list[int]]], grid: int, share: float) -> dict[tuple[int, int], list[float]]:
    """Values near which to cut the crowded intervals, from a share of the rows."""
    sample = df if share >= 1.0 else df.sample(fraction=share, seed=17)
    intervals: dict[int, set[int]] = {}
    for f, interval, *_ in crowded:
        intervals.setdefault(f, set()).add(interval)
    rows = values_in(sample, columns, cuts, intervals).groupBy("feature", "interval").agg(
        F.percentile_approx(F.col("value"), grid_points(grid), 10 * grid).alias("values"),
        F.max_by("value", "n").alias("mode"),
    ).collect()
    # Distinct values guide the cuts; the most frequent one is cut out on its own.
    return {(r["feature"], r["interval"]): sorted({*r["values"], r["mode"]}) for r in rows}


def order_statistics_of(
    df: DataFrame,
    columns: list[str],
    ranks: Mapping[int, set[int]],
    summaries: Mapping[int, ColumnSummary],
    leaf_rows: int = LEAF_ROWS,
    grid: int = GRID,
) -> dict[int, dict[int, float]]:
    """Values at 0-based ascending ranks of the populated values of each column expression."""
    found: dict[int, dict[int, float]] = {}
    wanted: dict[int, set[int]] = {}
    for f, asked in ranks.items():
        s = summaries[f]
        asked = {r for r in asked if 0 <= r < s.count}
        if s.values is not None:
            found[f], wanted[f] = {r: s.at(r) for r in asked}, set()
            continue
        found[f] = {r: s.low for r in asked if r == 0 or s.low == s.high}
        found[f].update({r: s.high for r in asked if r == s.count - 1})
        wanted[f] = asked - set(found[f])

    cuts: dict[int, list[float]] = {f: [] for f, w in wanted.items() if w}
    # (feature, interval, rows before it, ranks inside it)
    leaves: list[tuple[int, int, int, list[int]]] = []
    crowded: list[tuple[int, int, int, int, list[int]]] = []
    for f in cuts:
        if summaries[f].count <= leaf_rows:
            leaves.append((f, 0, 0, sorted(wanted[f])))
        else:
            crowded.append((f, 0, 0, summaries[f].count, sorted(wanted[f])))

    boost = 1.0
    while crowded:
        # The largest intervals go first, so that one sample suits all that are cut together.
        largest = max(c[3] for c in crowded)
        open_features = sorted({c[0] for c in crowded if c[3] * 16 >= largest})
        waiting = [c for c in crowded if c[0] not in set(open_features)]
        now = [c for c in crowded if c[0] in set(open_features)]
        share = min(1.0, boost * SAMPLE_ROWS / largest)
        guesses = _guess(df, columns, cuts, now, grid, share)
        stuck = False
        for f, interval, _, _, _ in now:
            points = set(cuts[f])
            for g in guesses.get((f, interval), []):
                points |= {math.nextafter(g, -math.inf), g}
            stuck |= len(points) == len(cuts[f])
            cuts[f] = sorted(points)
        boost = boost * 16 if stuck else boost
        # Cutting again renumbers a feature's intervals, so its ranks are all placed anew.
        leaves = [leaf for leaf in leaves if leaf[0] not in set(open_features)]
        counted = histogram(df, [columns[f] for f in open_features],
                            {i: cuts[f] for i, f in enumerate(open_features)}).where("interval >= 0").collect()
        sizes: dict[int, dict[int, int]] = {f: {} for f in open_features}
        for row in counted:
            sizes[open_features[row["feature"]]][row["interval"]] = row["n"]
        crowded = waiting
        for f in open_features:
            offset, kept = 0, []
            for interval in range(len(cuts[f]) + 1):
                n = sizes[f].get(interval, 0)
                inside = sorted(r for r in wanted[f] if offset <= r < offset + n)
                if inside:
                    kept.append((interval, offset, n, inside))
                offset += n
            # Only the cuts that bound an interval with a wanted rank are kept.
            edges = sorted({cuts[f][i] for interval, *_ in kept for i in (interval - 1, interval)
                            if 0 <= i < len(cuts[f])})
            number = {low: i + 1 for i, low in enumerate(edges)}
            for interval, before, n, inside in kept:
                low = cuts[f][interval - 1] if interval else None
                high = cuts[f][interval] if interval < len(cuts[f]) else None
                renumbered = number[low] if low is not None else 0
                if low is not None and high is not None and math.nextafter(high, -math.inf) == low:
                    found[f].update({r: high for r in inside})
                elif n <= leaf_rows:
                    leaves.append((f, renumbered, before, inside))
                else:
                    crowded.append((f, renumbered, before, n, inside))
            cuts[f] = edges

    if leaves:
        intervals: dict[int, set[int]] = {}
        for f, interval, _, _ in leaves:
            intervals.setdefault(f, set()).add(interval)
        table = small_table(
            df.sparkSession, leaves, "feature int, interval int, offset bigint, ranks array<bigint>"
        )
        # Each window holds one leaf: at most ``leaf_rows`` values.
        upto = (
            Window.partitionBy("feature", "interval").orderBy("value")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        hits = (
            values_in(df, columns, cuts, intervals)
            .withColumn("until", F.sum("n").over(upto))
            .join(F.broadcast(table), ["feature", "interval"])
            .withColumn("until", F.col("until") + F.col("offset"))
            .withColumn(
                "hit",
                F.filter("ranks", lambda r: (r >= F.col("until") - F.col("n")) & (r < F.col("until"))),
            )
            .where(F.size("hit") > 0)
            .select("feature", "value", "hit")
            .collect()
        )
        for row in hits:
            found[row["feature"]].update({r: row["value"] for r in row["hit"]})
    return found


def order_statistics(
    df: DataFrame, ranks_of: Mapping[str, Callable[[int], list[int]]],
    leaf_rows: int = LEAF_ROWS, grid: int = GRID,
) -> dict[str, dict[int, float]]:
    """The same by column name; wanted ranks are a function of the populated count."""
    names = list(ranks_of)
    columns = as_doubles(names)
    summaries = summarise(df, columns)
    ranks = {i: set(ranks_of[c](summaries[i].count)) for i, c in enumerate(names)}
    at = order_statistics_of(df, columns, ranks, summaries, leaf_rows, grid)
    return {c: at[i] for i, c in enumerate(names)}


def _neighbours(probability: float, count: int) -> tuple[int, int, float]:
    position = probability * (count - 1)
    low = math.floor(position)
    return low, min(low + 1, count - 1), position - low


def exact_quantiles_of(
    df: DataFrame, columns: list[str], summaries: Mapping[int, ColumnSummary], probabilities: list[float],
    leaf_rows: int = LEAF_ROWS, grid: int = GRID,
) -> dict[int, list[float]]:
    """Linearly interpolated quantiles of every column expression that has populated values."""
    populated = {f: s for f, s in summaries.items() if s.count}
    ranks = {
        f: {r for p in probabilities for r in _neighbours(p, s.count)[:2]} for f, s in populated.items()
    }
    at = order_statistics_of(df, columns, ranks, populated, leaf_rows, grid)
    out: dict[int, list[float]] = {}
    for f, s in populated.items():
        values = []
        for p in probabilities:
            low, high, fraction = _neighbours(p, s.count)
            a, b = at[f][low], at[f][high]
            values.append(a if a == b or fraction == 0 else a + (b - a) * fraction)
        out[f] = values
    return out


def exact_quantiles(df: DataFrame, names: list[str], probabilities: list[float],
                    leaf_rows: int = LEAF_ROWS, grid: int = GRID) -> dict[str, list[float] | None]:
    """Quantiles by column name; ``None`` where nothing is populated."""
    if not names:
        return {}
    columns = as_doubles(names)
    values = exact_quantiles_of(df, columns, summarise(df, columns), probabilities, leaf_rows, grid)
    return {c: values.get(i) for i, c in enumerate(names)}


def approximate_quantiles(df: DataFrame, names: list[str], probabilities: list[float],
                          accuracy: int) -> dict[int, list[float]]:
    """One JVM sketch pass, for tables where a rank error of 1/accuracy is good enough."""
    row = df.agg(*[F.percentile_approx(F.col(f"`{c}`"), probabilities, accuracy).alias(c) for c in names]).first()
    return {i: list(row[c]) for i, c in enumerate(names) if row[c] is not None}
