"""Random forests on stored rows: bootstrapped trees that split by Gini, grown level by level.

Rows that agree in label, weight and all bytes are one stored row, as in the booster. For every tree each of
the rows it stands for is drawn with replacement (a Poisson count from a hash of key, seed and tree), so the forest is that of
the rows themselves. Tasks hold a block of stored rows with the draws of a group of trees and add up weights per
(tree, node, bin); a shuffle brings the counts of one node together, where the best cut among the node's own draw of inputs is
found. The driver sees one row per node. Sums are whole numbers, so neither the layout of the rows nor a repeated task changes a tree.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.boosting import ROWS_PER_TASK, GrownTree, _bins, _mix, _rids, _salt, bin_edges, stored_parts, stored_rows
from tidemark.plans.trees import matrix
from tidemark.session import discard, materialise_at

#: Draws (stored rows times trees) that are held at a time, and trees to a task.
DRAWS_HELD, TREES_PER_TASK = 2_000_000_000, 10
#: Rows that a tree is evaluated on at a time.
_SCORE_ROWS = 4_096


@dataclass(frozen=True)
class Forest:
    """The trees of a forest; the probability is the mean share of positives in the leaves a row comes to."""

    trees: tuple[GrownTree, ...]

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - the name model code asks for
        return len(self.trees)

    def append(self, df: DataFrame, column: str) -> DataFrame:
        """All columns of `df` and the probability from its array column ``inputs``."""
        shared = df.sparkSession.sparkContext.broadcast(self.trees)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(batch.schema.get_field_index("inputs")))
                total = np.zeros(len(x))
                for low in range(0, len(x), _SCORE_ROWS):
                    part = x[low : low + _SCORE_ROWS]
                    for tree in shared.value:
                        total[low : low + _SCORE_ROWS] += tree.of_inputs(part)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total / len(shared.value))], [*batch.schema.names, column])

        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
        return df.mapInArrow(run, ", ".join([*fields, f"`{column}` double"]))


def fit_forest(fit: DataFrame, settings) -> Forest:
    """From (key..., label, weight, inputs); the key names a row in the draws of every tree."""
    key = [c for c in fit.columns if c not in ("label", "weight", "inputs", "features")] or ["inputs", "label"]
    size = fit.agg(F.count("*").alias("n"), F.max("weight").alias("w"), F.max(F.size("inputs")).alias("width")).first()
    edges = bin_edges(fit, size["width"])
    rows = fit.select(F.xxhash64(*key).alias("rid"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), "inputs")
    stored, path = materialise_at(stored_rows(rows, edges, stored_parts(fit, size["n"])), "forest")
    # counts of a Poisson draw stay far below eight a row, so sums stay whole in double precision
    bits = max(0, min(20, 49 - math.ceil(math.log2(max(2.0, size["n"] * max(1.0, size["w"]))))))
    held = stored.count()
    at_once = max(1, min(settings.forest_trees, DRAWS_HELD // max(1, held)))
    try:
        trees: list[GrownTree] = []
        for low in range(0, settings.forest_trees, at_once):
            numbers = list(range(low, min(low + at_once, settings.forest_trees)))
            blocks = drawn_blocks(stored, numbers, settings, math.ceil(held / ROWS_PER_TASK)).persist(StorageLevel.MEMORY_AND_DISK)
            trees += _grown(blocks, numbers, edges, settings, bits, math.ceil(held / ROWS_PER_TASK))
            blocks.unpersist()
    finally:
        discard(fit.sparkSession, path)
    return Forest(tuple(trees))


def poisson_counts(rid: np.ndarray, salt: np.uint64, rate: float) -> np.ndarray:
    """A Poisson(rate) count for each row's hash."""
    steps, term = [], math.exp(-rate)
    while len(steps) < 20:
        steps.append(term + (steps[-1] if steps else 0.0))
        term *= rate / len(steps)
    return np.searchsorted(np.array(steps) * 2.0**64, _mix(rid ^ salt).astype(np.float64), "right")


def drawn_blocks(stored: DataFrame, numbers: list[int], settings, tasks: int) -> RDD:
    """(trees, (label, weight, bins, draws)): stored rows with the draws of a group of trees, a block of rows to a task."""
    groups = [numbers[i : i + TREES_PER_TASK] for i in range(0, len(numbers), TREES_PER_TASK)]
    salts = {t: _salt(settings.seed, t) for t in numbers}
    rate, parts = float(settings.row_share), max(1, tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n, rid = batch.column(4).to_numpy(), _rids(batch.column(3)).view(np.uint64)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            label, weight, bins = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _bins(batch.column(2))
            block = int(rid[0] % np.uint64(parts))
            packed = []
            for trees in groups:
                draws = np.stack([np.add.reduceat(poisson_counts(rid, salts[t], rate), starts) for t in trees])
                draws = draws.astype(np.min_scalar_type(int(draws.max())))
                packed.append(pickle.dumps((label, weight, bins, draws), 5))
            at = [block * len(groups) + g for g in range(len(groups))]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed, pa.binary())], ["at", "block"])

    pairs = stored.mapInArrow(run, "at bigint, block binary").rdd.map(lambda r: (r["at"], r["block"]))
    size = len(groups)

    def whole(part: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[int, list[tuple]] = {}
        for at, block in part:
            held.setdefault(at % size, []).append(pickle.loads(block))
        for g, found in held.items():
            yield groups[g], tuple(np.concatenate(c, axis=-1 if k == 3 else 0) for k, c in enumerate(zip(*found)))

    # one task to each group of trees and block of rows
    return pairs.partitionBy(parts * size, int).mapPartitions(whole)


def _grown(blocks: RDD, numbers: list[int], edges: list[np.ndarray], settings, bits: int, tasks: int) -> list[GrownTree]:
    depth, width = settings.forest_depth, len(edges)
    trees = {t: GrownTree.bare(depth) for t in numbers}
    nodes = {t: [0] for t in numbers}
    offsets = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])
    chosen = max(1, math.ceil(settings.column_share * width))
    for level in range(depth):
        wanted = sum(map(len, nodes.values()))
        if not wanted:
            break
        sums = node_sums(blocks, trees, nodes, level, offsets, bits)
        # about 16 MB of counts to a reducing task
        reducers = max(1, math.ceil(max(1, tasks) * wanted * offsets[-1] * 16 / (1 << 24)))
        seed = settings.seed
        found = sums.reduceByKey(np.add, reducers).map(lambda kv: (kv[0], best_gini(kv[1], offsets, _inputs_of(seed, *kv[0], width, chosen)))).collect()
        following: dict[int, list[int]] = {t: [] for t in numbers}
        for (t, i), (feature, cut, total, left) in sorted(found):
            tree = trees[t]
            if i == 0:
                tree.value[0], tree.cover[0] = _share(total), total.sum() / 2.0**bits
            if feature < 0:
                continue
            tree.feature[i], tree.cut[i], tree.threshold[i] = feature, cut, edges[feature][cut]
            for child, counts in ((2 * i + 1, left), (2 * i + 2, total - left)):
                tree.value[child], tree.cover[child] = _share(counts), counts.sum() / 2.0**bits
                if counts.min() > 0:
                    following[t].append(child)
        nodes = following
    return [trees[t] for t in numbers]


def _share(counts: np.ndarray) -> float:
    return float(counts[1] / counts.sum()) if counts.sum() else 0.0


def _inputs_of(seed: int, tree: int, node: int, width: int, chosen: int) -> np.ndarray:
    """The inputs that a node may split by."""
    return np.sort(np.random.default_rng([seed, tree, node, width]).permutation(width)[:chosen])


def node_sums(blocks: RDD, trees: dict[int, GrownTree], nodes: dict[int, list[int]], level: int, offsets: np.ndarray, bits: int) -> RDD:
    """((tree, node), counts): per task, the weights of either class by bin, the bins of all inputs side by side."""
    shared = blocks.context.broadcast((trees, nodes))

    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        trees, nodes = shared.value
        width = int(offsets[-1])
        sums: dict[int, np.ndarray] = {}
        for group, (label, weight, bins, draws) in part:
            whole = np.rint(weight * 2.0**bits)
            columns = np.ascontiguousarray(bins.T)
            for t, times in zip(group, draws):
                if not nodes[t]:
                    continue
                tree, used = trees[t], np.flatnonzero(times)
                at = np.zeros(len(used), np.int64)
                for _ in range(level):
                    f = tree.feature[at]
                    right = bins[used, np.maximum(f, 0)] > tree.cut[at]
                    at = np.where(f >= 0, 2 * at + 1 + right, at)
                place = np.full(len(tree.feature), -1, np.int64)
                place[nodes[t]] = np.arange(len(nodes[t]))
                open_ = place[at] >= 0
                used, at = used[open_], place[at[open_]]
                # counts of class 0 lie before those of class 1
                cell = (at * 2 + (label[used] == 1)) * width
                weights = whole[used] * times[used]
                size = len(nodes[t]) * 2 * width
                found = np.zeros(size, np.int64)
                for f in range(len(offsets) - 1):
                    found += np.bincount(cell + (offsets[f] + columns[f][used]), weights, minlength=size).astype(np.int64)
                sums[t] = sums[t] + found if t in sums else found
        for t, found in sums.items():
            for node, counts in zip(nodes[t], found.reshape(-1, 2, width)):
                yield (t, node), counts

    return blocks.mapPartitions(run)


def best_gini(counts: np.ndarray, offsets: np.ndarray, inputs: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(input, cut, counts of the node, of its left side) of the cut that lowers Gini impurity most; input -1 without one.

    Ties take the first input and the lowest cut.
    """
    total = counts[:, : offsets[1]].sum(axis=1)
    best, found = 1e-12, (-1, 0, total, total)
    if not total.min():
        return found
    weight = total.sum()
    for f in inputs.tolist():
        left = np.cumsum(counts[:, offsets[f] : offsets[f + 1]], axis=1)[:, :-1].astype(float)
        right = total[:, None] - left
        a, b = left.sum(axis=0), right.sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            # the sum of squares over weight of both sides, less that of the node: impurity lost, times one over two
            gain = ((left**2).sum(axis=0) / a + (right**2).sum(axis=0) / b - (total.astype(float) ** 2).sum() / weight) / weight
        gain = np.where((a > 0) & (b > 0), gain, 0.0)
        if len(gain) and gain.max() > best:
            cut = int(np.argmax(gain))
            best, found = float(gain[cut]), (f, cut, total, left[:, cut].astype(np.int64))
    return found
