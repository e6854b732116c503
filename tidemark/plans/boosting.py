"""Boosted trees that grow from a prefix: histograms of gradients are added up over partitions.

Inputs become one byte each, cut at exact quantiles of the fitting rows. For every level of a tree,
tasks add gradients and hessians per (node, feature, bin) over blocks of rows that the executors hold; a shuffle
brings the arrays of one node and feature together, where they are summed and the best cut is found. The driver sees one row per node and
feature. Sums are whole numbers (gradients times a power of two), so neither the layout of the rows nor a repeated
task changes a tree. Rows and columns are drawn by hashes of key, seed and round: a fit that goes on repeats
nothing, and equals the longer fit. The running margin is written every few rounds, so no tree meets a row
more often than a fixed number of times.

Rows that agree in label, weight and all bytes have the same gradient: they are one stored row with the hashes of
their keys, and count in a round as often as they are drawn for it. The draws of the next few rounds are counted
when the margin is written, so the pass over all rows comes once in those rounds, and levels read stored rows only.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.order_stats import exact_quantiles_of, summarise
from tidemark.plans.trees import Leaf, TreeTables, matrix
from tidemark.session import discard, materialise_at, small_table

#: Bins of an input, the shrinkage of leaf values and the least hessian of a child.
BINS, SHRINK, LEAST_HESSIAN = 64, 1.0, 1.0
#: Rounds between two writings of the margin, and stored rows to a task.
CARRY, ROWS_PER_TASK = 10, 200_000
#: Rows that a task brings together at a time; rows that agree are dealt on their own from `_HOT` on.
_FOLD_ROWS, _HOT = 1_000_000, 64
#: Stored rows to a block of a task, and arrays that one reducing task sums up.
_BLOCK_ROWS, _REDUCE_ROWS = 50_000, 4_096

NODE_SCHEMA = "round int, node int, feature int, cut int, threshold double, value double, cover double"


@dataclass(frozen=True)
class GrownTree:
    """A tree in heap order (children of i: 2i+1, 2i+2); feature -1 ends a path."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @staticmethod
    def bare(depth: int) -> GrownTree:
        n = 2 ** (depth + 1) - 1
        return GrownTree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros(n))

    def ends(self, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The node each row comes to rest in; `cuts` are bins or thresholds, as `x` is."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            right = x[rows, np.maximum(f, 0)] > cuts[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.ends(bins, self.cut)]

    def of_inputs(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.ends(x, self.threshold)]


@dataclass(frozen=True)
class BoostedTrees:
    """The trees of a fit; the margin is the sum of their values, the probability its sigmoid."""

    trees: tuple[GrownTree, ...]

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - the name model code asks for
        return len(self.trees)

    def prefix(self, rounds: int) -> BoostedTrees:
        return BoostedTrees(self.trees[:rounds])

    def append(self, df: DataFrame, column: str) -> DataFrame:
        """All columns of `df` and the probability from its array column ``inputs``."""
        shared = df.sparkSession.sparkContext.broadcast(self.trees)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(batch.schema.get_field_index("inputs")))
                margin = np.zeros(len(x))
                for tree in shared.value:
                    margin += tree.of_inputs(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_sigmoid(margin))], [*batch.schema.names, column])

        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
        return df.mapInArrow(run, ", ".join([*fields, f"`{column}` double"]))

    def tables(self) -> TreeTables:
        """Root-to-leaf paths for attribution; shares are those of the hessians."""
        return TreeTables(tuple(1.0 for _ in self.trees), tuple(map(_paths, self.trees)), 1.0)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(r, i, int(t.feature[i]), int(t.cut[i]), float(t.threshold[i]), float(t.value[i]), float(t.cover[i]))
                for r, t in enumerate(self.trees) for i in range(len(t.feature))]
        small_table(spark, rows, NODE_SCHEMA).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        nodes = spark.read.schema(NODE_SCHEMA).parquet(path).toPandas().sort_values(["round", "node"])
        return BoostedTrees(tuple(
            GrownTree(p["feature"].to_numpy(np.int32), p["cut"].to_numpy(np.int32), *(p[c].to_numpy(float) for c in ("threshold", "value", "cover")))
            for _, p in nodes.groupby("round")))


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


def _paths(tree: GrownTree) -> tuple[Leaf, ...]:
    out, pending = [], [(0, {})]
    while pending:
        i, path = pending.pop()
        f = int(tree.feature[i])
        if f < 0:
            names = tuple(path)
            out.append(Leaf(float(tree.value[i]), names, *(tuple(float(path[n][k]) for n in names) for k in range(3))))
            continue
        for child, left in ((2 * i + 1, True), (2 * i + 2, False)):
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            share *= tree.cover[child] / tree.cover[i] if tree.cover[i] else 0.5
            low, high = (low, min(high, tree.threshold[i])) if left else (max(low, tree.threshold[i]), high)
            pending.append((child, {**path, f: (low, high, share)}))
    return tuple(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def bin_edges(df: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Exact quantiles of every input, each once."""
    columns = [f"nullif(inputs[{i}], double('NaN'))" for i in range(width)]
    found = exact_quantiles_of(df, columns, summarise(df, columns), [k / bins for k in range(1, bins)])
    return [np.unique(found.get(i, [])) for i in range(width)]


def binned(df: DataFrame, edges: list[np.ndarray], keep: Iterable[str]) -> DataFrame:
    """(keep..., bins, margin): the inputs as one byte each, and a margin of zero."""
    keep = list(keep)
    shared = df.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(len(keep)))
            bins = np.empty(x.shape, np.uint8)
            for f, cuts in enumerate(shared.value):
                bins[:, f] = np.searchsorted(cuts, x[:, f], side="left")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], _bytes(bins), pa.array(np.zeros(len(x)))], [*keep, "bins", "margin"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    return df.select(*keep, "inputs").mapInArrow(run, ", ".join([*fields, "bins binary, margin double"]))


def _bytes(bins: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in bins], pa.binary())


def _bins(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _folded(label: np.ndarray, weight: np.ndarray, bins: np.ndarray, rids: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    """[label, weight, bins, rids, n]: rows that agree in the first three are one, with the packed hashes of their keys."""
    wide = np.concatenate([np.ascontiguousarray(label)[:, None].view(np.uint8), np.ascontiguousarray(weight)[:, None].view(np.uint8), bins], axis=1)
    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide.shape[1]), len(wide), [None, pa.py_buffer(np.ascontiguousarray(wide))])
    group = keys.dictionary_encode().indices.to_numpy().astype(np.int64)
    groups = int(group.max()) + 1
    first = np.empty(groups, np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    owner = np.repeat(group, sizes)
    n = np.bincount(owner, minlength=groups)
    offsets = np.concatenate([[0], np.cumsum(8 * n)]).astype(np.int32)
    packed = rids[np.argsort(owner, kind="stable")]
    return [pa.array(label[first]), pa.array(weight[first]), _bytes(bins[first]),
            pa.Array.from_buffers(pa.binary(), groups, [None, pa.py_buffer(offsets), pa.py_buffer(packed)]), pa.array(n)]


_STORED = ["label", "weight", "bins", "rids", "n"]
_STORED_SCHEMA = "label double, weight double, bins binary, rids binary, n bigint"


def _fold(batches: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Stored rows of (label, weight, bins, rids, sizes), brought together by the million."""
    def packed():
        return pa.RecordBatch.from_arrays(_folded(*(np.concatenate(c) for c in zip(*held))), _STORED)

    held, size = [], 0
    for part in batches:
        if held and size + len(part[3]) > _FOLD_ROWS:
            yield packed()
            held, size = [], 0
        held.append(part)
        size += len(part[3])
    if held:
        yield packed()


def stored_parts(df: DataFrame, n: int) -> int:
    """Tasks that bring `n` rows together."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(math.ceil(n / _FOLD_ROWS), min(cores, math.ceil(n / ROWS_PER_TASK)), 1)


def stored_rows(df: DataFrame, edges: list[np.ndarray], tasks: int) -> DataFrame:
    """(label, weight, bins, rids, n) of (rid, label, weight, inputs): equal rows meet by one shuffle, and stay apart where they are many."""
    rows = binned(df, edges, ["rid", "label", "weight"]).drop("margin")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy(), _bins(b.column(3))) for b in batches if len(b))
        return _fold((label, weight, bins, rid.to_numpy(), np.ones(len(label), np.int64)) for rid, label, weight, bins in parts)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _fold((b.column(0).to_numpy(), b.column(1).to_numpy(), _bins(b.column(2)), _rids(b.column(3)), b.column(4).to_numpy()) for b in batches if len(b))

    first = rows.mapInArrow(near, _STORED_SCHEMA)
    hot = F.when(F.col("n") >= _HOT, F.xxhash64("rids")).otherwise(0)
    return first.repartition(tasks, "label", "weight", "bins", hot).mapInArrow(far, _STORED_SCHEMA)


def _rids(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def carried(stored: DataFrame, trees: list[GrownTree], settings, start: int, rounds: int) -> DataFrame:
    """The stored rows with `trees` added to their margin, and how many of each are drawn for `rounds` rounds from `start` (d0, d1, ...)."""
    shared = stored.sparkSession.sparkContext.broadcast(list(trees))
    salts = [_salt(settings.seed, start + j) for j in range(rounds)]
    limit = float(settings.row_share) * 2.0**64
    fresh = "margin" not in stored.columns
    names = _STORED if fresh else [*_STORED, "margin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bins, n = _bins(batch.column(2)), batch.column(4).to_numpy()
            margin = np.zeros(len(bins)) if fresh else batch.column(5).to_numpy().copy()
            for tree in shared.value:
                margin += tree.of_bins(bins)
            rid, starts = _rids(batch.column(3)).view(np.uint64), np.concatenate([[0], np.cumsum(n)[:-1]])
            draws = [pa.array(np.add.reduceat((_mix(rid ^ s).astype(np.float64) < limit).astype(np.int64), starts)) for s in salts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(margin), *draws], [*_STORED, "margin", *[f"d{j}" for j in range(rounds)]])

    return stored.select(*names).mapInArrow(run, ", ".join([_STORED_SCHEMA, "margin double", *[f"d{j} bigint" for j in range(rounds)]]))


def _salt(seed: int, round_: int) -> np.uint64:
    return np.random.default_rng([seed, round_]).integers(0, 1 << 63, dtype=np.uint64)


@dataclass
class Growth:
    """A fit under way: rows with their margin after ``carried`` trees, and all trees so far."""

    rows: DataFrame
    path: str
    edges: list[np.ndarray]
    settings: object
    bits: int
    tasks: int
    carried: int = 0
    trees: list[GrownTree] = field(default_factory=list)
    held: RDD | None = None

    @staticmethod
    def start(fit: DataFrame, settings) -> Growth:
        """From (key..., label, weight, inputs); the key names a row in the draws of every round."""
        key = [c for c in fit.columns if c not in ("label", "weight", "inputs", "features")] or ["inputs", "label"]
        size = fit.agg(F.count("*").alias("n"), F.max("weight").alias("w"), F.max(F.size("inputs")).alias("width")).first()
        edges = bin_edges(fit, size["width"])
        rows = fit.select(F.xxhash64(*key).alias("rid"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), "inputs")
        rows, path = materialise_at(carried(stored_rows(rows, edges, stored_parts(fit, size["n"])), [], settings, 0, CARRY), "boosting")
        bits = min(30, 61 - math.ceil(math.log2(max(2.0, size["n"] * max(1.0, size["w"])))))
        return Growth(rows, path, edges, settings, bits, max(1, math.ceil(rows.count() / ROWS_PER_TASK)))

    @property
    def model(self) -> BoostedTrees:
        return BoostedTrees(tuple(self.trees))

    def grow(self, rounds: int) -> Growth:
        """Add `rounds` trees to those that are there."""
        for _ in range(rounds):
            if len(self.trees) - self.carried >= CARRY:
                self._carry()
            self.trees.append(self._tree(len(self.trees)))
        return self

    def root_cuts(self) -> list:
        """What the next tree's root would gain by each input's best cut, all rows and inputs drawn; one row per input."""
        return sorted(self._splits(GrownTree.bare(1), [0], np.arange(len(self.edges)), CARRY), key=lambda r: r["feature"])

    def close(self) -> None:
        self._let_go()
        discard(self.rows.sparkSession, self.path)

    def _let_go(self) -> None:
        if self.held is not None:
            self.held.unpersist()
            self.held = None

    def _carry(self) -> None:
        """Write the margin with all trees so far and the draws of the next rounds; the table before is no longer read."""
        before, start = self.path, len(self.trees)
        self._let_go()
        self.rows, self.path = materialise_at(carried(self.rows, self.trees[self.carried:], self.settings, start, CARRY), "boosting")
        self.carried = start
        discard(self.rows.sparkSession, before)

    def _tree(self, round_: int) -> GrownTree:
        depth, width = self.settings.depth, len(self.edges)
        draw = np.random.default_rng([self.settings.seed, round_])
        columns = np.sort(draw.permutation(width)[: max(1, round(self.settings.column_share * width))])
        tree = GrownTree.bare(depth)
        nodes = [0]
        for _ in range(depth):
            found: dict[int, object] = {}
            for row in self._splits(tree, nodes, columns, round_ - self.carried):
                best = found.get(row["node"])
                if best is None or (-row["gain"], row["feature"]) < (-best["gain"], best["feature"]):
                    found[row["node"]] = row
            nodes = []
            for i, row in sorted(found.items()):
                if i == 0:
                    tree.value[0], tree.cover[0] = self._value(row["g"], row["h"]), row["h"]
                if row["gain"] <= 1e-12:
                    continue
                tree.feature[i], tree.cut[i] = row["feature"], row["cut"]
                tree.threshold[i] = self.edges[row["feature"]][row["cut"]]
                sides = ((2 * i + 1, row["gl"], row["hl"]), (2 * i + 2, row["g"] - row["gl"], row["h"] - row["hl"]))
                for child, g, h in sides:
                    tree.value[child], tree.cover[child] = self._value(g, h), h
                    nodes.append(child)
            if not nodes:
                break
        return tree

    def _value(self, g: float, h: float) -> float:
        return -self.settings.step * g / (h + SHRINK)

    def _splits(self, tree: GrownTree, nodes: list[int], columns: np.ndarray, drawn: int) -> list[Row]:
        """The best cut of each node and feature, each stored row counted as often as its draw number `drawn` says."""
        if self.held is None:
            self.held = blocks(self.rows).persist(StorageLevel.MEMORY_AND_DISK)
        sums = gradient_sums(self.held, self.trees[self.carried:], tree, nodes, columns, self.bits, drawn)
        reducers = max(1, math.ceil(self.tasks * len(nodes) * len(columns) / _REDUCE_ROWS))
        bits = self.bits
        return sums.reduceByKey(np.add, reducers).map(lambda found: best_cut(*found[0], found[1], bits)).collect()


def blocks(rows: DataFrame) -> RDD:
    """(label, weight, bins, margin, draws) as arrays; the last draw is the number of rows a stored row stands for."""
    draws = [c for c in rows.columns if c[0] == "d" and c[1:].isdigit()]

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        label, weight, margin = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1, 3))
        bins = np.concatenate([_bins(b.column(2)) for b in held])
        drawn = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(4, held[0].num_columns)]
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((label, weight, bins, margin, drawn), 5)], pa.binary())], ["block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] * (len(batch) > 0)
            if sum(map(len, held)) >= _BLOCK_ROWS:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return rows.select("label", "weight", "bins", "margin", *draws, "n").mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))


def add_trees(rows: DataFrame, trees: list[GrownTree], scores: bool = False) -> DataFrame:
    """The same rows with the trees' values in their margin; on request the probability after each tree, too."""
    shared = rows.sparkSession.sparkContext.broadcast(list(trees))
    names = [c for c in rows.columns if c != "scores"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _bins(batch.column(names.index("bins")))
            margin = batch.column(names.index("margin")).to_numpy().copy()
            after = np.empty((len(bins), len(shared.value)))
            for k, tree in enumerate(shared.value):
                margin += tree.of_bins(bins)
                after[:, k] = _sigmoid(margin)
            columns = [pa.array(margin) if n == "margin" else batch.column(i) for i, n in enumerate(names)]
            if scores:
                columns.append(pa.FixedSizeListArray.from_arrays(pa.array(after.ravel()), after.shape[1]).cast(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names + ["scores"] * scores)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields]
    return rows.select(*names).mapInArrow(run, ", ".join(fields + ["scores array<double>"] * scores))


def gradient_sums(held: RDD, trees: list[GrownTree], tree: GrownTree, nodes: list[int], columns: np.ndarray, bits: int, drawn: int) -> RDD:
    """((node, feature), sums): per task, the summed gradients and hessians by bin of the rows drawn."""
    shared = held.context.broadcast((list(trees), tree, list(nodes), columns))

    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        trees, tree, nodes, columns = shared.value
        place = np.full(len(tree.feature), -1, np.int64)
        place[nodes] = np.arange(len(nodes))
        sums = np.zeros((2, len(columns), len(nodes) * 256), np.int64)
        for label, weight, bins, margin, draws in part:
            times = draws[drawn]
            at = place[tree.ends(bins, tree.cut)]
            used = (times > 0) & (at >= 0)
            bins, at, margin, times = bins[used], at[used], margin[used], times[used]
            for earlier in trees:
                margin += earlier.of_bins(bins)
            p, weight = _sigmoid(margin), weight[used]
            whole = [np.rint(v * 2.0**bits).astype(np.int64) * times for v in (weight * (p - label[used]), weight * p * (1.0 - p))]
            # bincount adds in doubles: halves of 31 bits stay whole numbers there
            halves = [((v & 0x7FFFFFFF).astype(np.float64), (v >> 31).astype(np.float64)) for v in whole]
            for k, f in enumerate(columns):
                cell = at * 256 + bins[:, f]
                for s, (low, high) in zip(sums, halves):
                    both = [np.bincount(cell, v, minlength=s.shape[1]).astype(np.int64) for v in (low, high)]
                    s[k] += both[0] + (both[1] << 31)
        sums = sums.reshape(2, len(columns), len(nodes), 256)[:, :, :, :BINS]
        for k, f in enumerate(columns):
            for i, node in enumerate(nodes):
                yield (int(node), int(f)), sums[:, k, i]

    return held.mapPartitions(run)


def best_cut(node: int, feature: int, sums: np.ndarray, bits: int) -> Row:
    """The best cut of a node by a feature: its gain, and the sums of its left side and of the node.

    The gain is G²/(H+1) of both sides less that of the node; ties take the lowest cut, and without
    a cut that leaves enough hessian on both sides the gain is zero.
    """
    left = np.cumsum(sums, axis=1) / 2.0**bits
    (g, h), (gl, hl) = left[:, -1], left[:, :-1]
    gr, hr = g - gl, h - hl
    gain = gl**2 / (hl + SHRINK) + gr**2 / (hr + SHRINK) - g**2 / (h + SHRINK)
    gain[(hl < LEAST_HESSIAN) | (hr < LEAST_HESSIAN)] = 0.0
    cut = int(np.argmax(gain))
    return Row(node=node, feature=feature, cut=cut, gain=float(gain[cut]), gl=float(gl[cut]), hl=float(hl[cut]), g=float(g), h=float(h))
