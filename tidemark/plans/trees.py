"""Tree tables of a fitted booster, staged scores and exact attribution over them.

The model is read back from its own saved node table, whose size depends on the model
and not on the data, and travels to the tasks once. Tasks only evaluate it, a block of
rows at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

ROW_BLOCK = 20_000
#: A tree whose thresholds cut the inputs it uses into at most so many cells is evaluated once per cell.
MOST_CELLS = 1_024


@dataclass(frozen=True)
class Leaf:
    """One root-to-leaf path: per feature its value range and the share of rows that follow it."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


@dataclass(frozen=True)
class TreeTables:
    """Leaves by tree; the log-odds are ``link`` times the weighted sum of leaf values."""

    weights: tuple[float, ...]
    trees: tuple[tuple[Leaf, ...], ...]
    link: float = 2.0


def tree_tables(model) -> TreeTables:
    """Paths of a Spark ML booster, or of one that knows its own."""
    if not isinstance(model, GBTClassificationModel):
        return model.tables()
    spark = SparkSession.active()
    path = scratch_path(spark, "model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.get("nodeData.impurityStats", F.lit(0)).alias("cover"),
    ).collect()
    by_tree: dict[int, dict[int, object]] = {}
    for row in nodes:
        by_tree.setdefault(row["treeID"], {})[row["id"]] = row
    trees = tuple(_leaves(by_tree[t]) for t in sorted(by_tree))
    return TreeTables(tuple(float(w) for w in model.treeWeights), trees)


def _leaves(nodes: dict[int, object]) -> tuple[Leaf, ...]:
    out: list[Leaf] = []
    pending = [(nodes[0], {})]
    while pending:
        node, path = pending.pop()
        if node["leftChild"] < 0:
            names = tuple(path)
            out.append(Leaf(float(node["prediction"]), names, *(
                tuple(float(path[f][i]) for f in names) for i in range(3))))
            continue
        for child, goes_left in ((node["leftChild"], True), (node["rightChild"], False)):
            low, high, share = path.get(node["feature"], (-np.inf, np.inf, 1.0))
            share *= nodes[child]["cover"] / node["cover"] if node["cover"] else 0.5
            if goes_left:
                high = min(high, node["threshold"])
            else:
                low = max(low, node["threshold"])
            pending.append((nodes[child], {**path, node["feature"]: (low, high, share)}))
    return tuple(out)


def _inside(leaf: Leaf, x: np.ndarray) -> list[np.ndarray]:
    return [(x[:, f] > lo) & (x[:, f] <= hi) for f, lo, hi in zip(leaf.features, leaf.low, leaf.high)]


def _tree_value(leaves: tuple[Leaf, ...], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for leaf in leaves:
        hit = np.ones(len(x), dtype=bool)
        for inside in _inside(leaf, x):
            hit &= inside
        out[hit] = leaf.value
    return out


def staged_block(tables: TreeTables, df: DataFrame, low: int, high: int) -> DataFrame:
    """(label, inputs, margin, scores): the scores of rounds low+1..high and the margin after them.

    A ``margin`` column of ``df`` is taken as the margin after round ``low``; without one
    the earlier trees are evaluated first.
    """
    carried = "margin" in df.columns
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        t = shared.value
        for batch in batches:
            x = np.stack(batch["inputs"].to_numpy())
            margin = batch["margin"].to_numpy() if carried else np.zeros(len(x))
            for k in range(0 if not carried else low, low):
                margin = margin + t.weights[k] * _tree_value(t.trees[k], x)
            scores = np.empty((len(x), high - low))
            for k in range(low, high):
                margin = margin + t.weights[k] * _tree_value(t.trees[k], x)
                scores[:, k - low] = 1.0 / (1.0 + np.exp(-2.0 * margin))
            yield pd.DataFrame({"label": batch["label"], "inputs": batch["inputs"], "margin": margin,
                                "scores": list(scores)})

    kept = ["label", "inputs", "margin"] if carried else ["label", "inputs"]
    return df.select(*kept).mapInPandas(
        run, "label int, inputs array<double>, margin double, scores array<double>")


def rounds_of(block: DataFrame, low: int) -> DataFrame:
    """(round, score, label) of a block that starts after round ``low``."""
    return block.select("label", F.posexplode("scores").alias("i", "score")).select(
        (F.col("i") + low + 1).alias("round"), "score", "label")


def staged_probabilities(tables: TreeTables, df: DataFrame, low: int, high: int) -> DataFrame:
    """(round, score, label) for rounds low+1..high of a booster, from ``inputs`` and ``label``."""
    return rounds_of(staged_block(tables, df.select("label", "inputs"), low, high), low)


def _shapley_weights(m: int) -> np.ndarray:
    return np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])


def _leaf_attribution(leaf: Leaf, x: np.ndarray, scale: float, phi: np.ndarray, owner: np.ndarray) -> float:
    """Adds one leaf's exact Shapley values; returns its share of the base value.

    The product over the path of (share + inside * t) holds, at t^s, what all subsets of s known
    features add up to. The path is extended by one factor at a time; each feature's own factor is then
    unwound by division, so a leaf costs the square of its path length, not a power of two.
    """
    m = len(leaf.features)
    if not m:
        return scale * leaf.value
    inside = [i.astype(float) for i in _inside(leaf, x)]
    weights = _shapley_weights(m)
    path = np.zeros((m + 1, len(x)))
    path[0] = 1.0
    for j in range(m):
        path[1 : j + 2] = leaf.share[j] * path[1 : j + 2] + inside[j] * path[: j + 1]
        path[0] *= leaf.share[j]
    for j in range(m):
        share = leaf.share[j]
        # where the row follows the feature, the factor is share + t: divide from the highest power down
        follows = np.zeros(len(x))
        rest = np.zeros(len(x))
        for s in range(m - 1, -1, -1):
            rest = path[s + 1] - share * rest
            follows += weights[s] * rest
        # where it does not, the factor is share alone
        strays = weights @ path[:m] / share if share else 0.0
        total = np.where(inside[j] > 0, follows, strays)
        phi[:, owner[leaf.features[j]]] += scale * leaf.value * (inside[j] - share) * total
    return scale * leaf.value * float(np.prod(leaf.share))


@dataclass(frozen=True)
class Cells:
    """What a tree says of every cell that its thresholds cut out: (contributions, margin) by cell, and the base."""

    features: tuple[int, ...]
    cuts: tuple[np.ndarray, ...]
    phi: np.ndarray
    margin: np.ndarray
    base: float

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: bounds are open on the left and closed on the right, as those of leaves are."""
        at = np.zeros(len(x), np.int64)
        for f, cuts in zip(self.features, self.cuts):
            at = at * (len(cuts) + 1) + np.searchsorted(cuts, x[:, f], side="left")
        return at


def _direct(leaves: tuple[Leaf, ...], x: np.ndarray, scale: float, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    phi = np.zeros((len(x), int(owner.max()) + 1))
    base = sum(_leaf_attribution(leaf, x, scale, phi, owner) for leaf in leaves)
    return phi, scale * _tree_value(leaves, x), base


def cells(tables: TreeTables, width: int, owner: np.ndarray) -> list[Cells | None]:
    """Each tree by its cells; None for a tree with too many of them."""
    out: list[Cells | None] = []
    for weight, leaves in zip(tables.weights, tables.trees):
        cuts: dict[int, set[float]] = {}
        for leaf in leaves:
            for f, low, high in zip(leaf.features, leaf.low, leaf.high):
                cuts.setdefault(f, set()).update(v for v in (low, high) if np.isfinite(v))
        features, ordered = tuple(cuts), tuple(np.array(sorted(c)) for c in cuts.values())
        if np.prod([len(c) + 1.0 for c in ordered]) > MOST_CELLS:
            out.append(None)
            continue
        # one row in every cell: the upper bound of each interval lies in it
        x = np.zeros((int(np.prod([len(c) + 1 for c in ordered], dtype=np.int64)), width))
        for f, values in zip(features, np.meshgrid(*[np.append(c, np.inf) for c in ordered], indexing="ij")):
            x[:, f] = values.ravel()
        out.append(Cells(features, ordered, *_direct(leaves, x, tables.link * weight, owner)))
    return out


def evaluate(tables: TreeTables, x: np.ndarray, owner: np.ndarray, known: list[Cells | None] | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """(contributions, base, margin) in log-odds for a block of input rows."""
    phi, base = np.zeros((len(x), int(owner.max()) + 1)), 0.0
    margin = np.zeros(len(x))
    whole = not np.isnan(x).any()  # a missing input follows neither side, so it lies in no cell
    for k, (weight, leaves) in enumerate(zip(tables.weights, tables.trees)):
        cell = known[k] if known and whole else None
        if cell is None:
            one, value, start = _direct(leaves, x, tables.link * weight, owner)
        else:
            at, start = cell.of(x), cell.base
            one, value = cell.phi[at], cell.margin[at]
        phi += one
        margin += value
        base += start
    return phi, base, margin


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def attributions(tables: TreeTables, df: DataFrame, owner: list[int], keep: list[str]) -> DataFrame:
    """(keep..., phi, base, margin, probability): log-odds contributions per feature."""
    shared = df.sparkSession.sparkContext.broadcast((tables, np.asarray(owner)))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]

    def run(batches):
        (t, own), known = shared.value, None
        for batch in batches:
            for start in range(0, len(batch), ROW_BLOCK):
                part = batch.slice(start, ROW_BLOCK)
                x = matrix(part.column(len(keep)))
                known = cells(t, x.shape[1], own) if known is None else known
                phi, base, margin = evaluate(t, x, own, known)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(phi.ravel()), phi.shape[1]).cast(pa.list_(pa.float64()))
                found = [lists, pa.array(np.full(len(x), base)), pa.array(margin), pa.array(1.0 / (1.0 + np.exp(-margin)))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *found], [*keep, "phi", "base", "margin", "probability"])

    schema = ", ".join([*fields, "phi array<double>", "base double", "margin double", "probability double"])
    return df.select(*keep, "inputs").mapInArrow(run, schema)
