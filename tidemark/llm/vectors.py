"""Embedding near-duplicates: a pigeonhole join over rotated subspaces.

Unit vectors within cosine t are within squared distance 2 - 2t. After a random rotation the
dimensions are split into blocks, each with a share of that budget in proportion to its size; a
pair within the budget of the whole is within the share of one block at least. Every block is
range-joined over a grid of its first coordinates, and what one block admits is verified exactly.

Inside the join a vector is its 8-bit codes, with the rounding added to every bound, so all tasks
decide alike: a pair is passed on by the first block that admits it, and by no other. Pairs so
near that no rounding can part them are links already: of these a tile ships weights per vector
and a spanning forest. Vectors of different lengths never meet.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import group_starts, map_arrow, mix64, whole_groups
from tidemark.llm.graph import components
from tidemark.llm.registry import query, table
from tidemark.session import materialise

THRESHOLD, BLOCKS = 0.95, 8
#: Rows of one side of a tile; denser cells become several tiles.
TILE = 16_384
_STEP = 1 / 127


@functools.lru_cache(maxsize=16)
def rotation(dims: int, seed: int = 17) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0]


class Plan:
    """Bounds of the blocks for one dimension, threshold and number of vectors."""

    def __init__(self, dims: int, threshold: float, blocks: int, rows: int):
        self.dims = dims
        self.edges = np.linspace(0, dims, min(blocks, dims) + 1).astype(int)
        self.budget = 2 - 2 * threshold
        sizes = np.diff(self.edges)
        # a code is at most half a step from its coordinate, on either side of a pair
        self.radius = np.sqrt(self.budget * sizes / dims) + _STEP * np.sqrt(sizes) + 1e-6
        self.whole = (math.sqrt(self.budget) + _STEP * math.sqrt(dims) + 1e-6) / _STEP
        #: pairs of codes this near are links whatever the rounding was
        self.sure = (math.sqrt(self.budget) - _STEP * math.sqrt(dims) - 1e-6) / _STEP
        self.axes = max(1, min(int(sizes.min()), round(math.log10(max(rows, 10))) - 3, 4))
        self.axes = max(self.axes, min(2, int(sizes.min())))
        self.offsets = [o for o in itertools.product((-1, 0, 1), repeat=self.axes)]
        forward = [o for o in self.offsets if o > (0,) * self.axes]
        #: two cells around each other meet once: the later one in order probes the earlier one
        self.steps = [sum(o * 128 ** (self.axes - 1 - i) for i, o in enumerate(offset)) for offset in forward]

    def cells(self, codes: np.ndarray, block: int) -> np.ndarray:
        first = codes[:, self.edges[block] : self.edges[block] + self.axes].astype(float) * _STEP
        return np.clip(np.floor(first / self.radius[block]).astype(np.int64) + 64, 1, 126)

    def keys(self, cells: np.ndarray, block: int) -> np.ndarray:
        key = np.full(len(cells), block, np.int64)
        for axis in range(self.axes):
            key = key * 128 + cells[:, axis]
        return key + (self.dims << 32)


def _by_length(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each length."""
    order = np.argsort(sizes, kind="stable")
    starts = np.append(group_starts(sizes[order]), len(order))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield int(sizes[order[a]]), order[a:b]


def _doubles(column: pa.Array, rows: np.ndarray, dims: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _codes(vectors: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vector, cid, n, codes = batch.column(1), [], [], []
        for dims, rows in _by_length(pc.list_value_length(vector).to_numpy()):
            values = _doubles(vector, rows, dims)
            unit = values / np.sqrt((values * values).sum(axis=1, keepdims=True))
            codes += [c.tobytes() for c in np.rint(unit @ rotation(dims).T / _STEP).astype(np.int8)]
            cid.append(batch.column(0).to_numpy()[rows])
            n.append(batch.column(2).to_numpy()[rows])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(cid)), pa.array(np.concatenate(n)), pa.array(codes, pa.binary())], ["cid", "n", "code"])

    return map_arrow(vectors.select("cid", "vector", "n"), "cid bigint, n bigint, code binary", work)


def _matrix(column: pa.Array, rows: np.ndarray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), np.int8).reshape(-1, dims)


def _cell_counts(codes: DataFrame, plans: dict[int, Plan]) -> dict[int, int]:
    """Vectors per cell. Coordinates lie in [-1, 1], so blocks x (2 / radius) ** axes bounds the cells of a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for dims, rows in _by_length(pc.binary_length(batch.column(0)).to_numpy()):
                plan, code = plans[dims], _matrix(batch.column(0), rows, dims)
                for block in range(len(plan.radius)):
                    key, count = np.unique(plan.keys(plan.cells(code, block), block), return_counts=True)
                    for k, c in zip(key.tolist(), count.tolist()):
                        total[k] = total.get(k, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["key", "n"])

    counted = codes.select("code").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return {r.key: r.n for r in counted.collect()}


def _tiles(codes: DataFrame, plans: dict[int, Plan], counts: dict[int, int], tile: int) -> DataFrame:
    """Each vector at home in its cell, and as a probe there and in half of the cells around."""
    near: dict[int, int] = {}
    for key, n in counts.items():
        for s in [0, *plans[key >> 32].steps]:
            near[key + s] = near.get(key + s, 0) + n

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        salt = mix64(batch.column(0).to_numpy().astype(np.uint64)).astype(np.int64) & 0x7FFFFFFF
        keys, homes, probes, role, rows = [], [], [], [], []
        for dims, inside in _by_length(pc.binary_length(batch.column(2)).to_numpy()):
            plan, code = plans[dims], _matrix(batch.column(2), inside, dims)
            for block in range(len(plan.radius)):
                key = plan.keys(plan.cells(code, block), block)
                for cell in np.unique(key).tolist():
                    at = inside[key == cell]
                    for s in [None, 0, *plan.steps]:
                        target = cell + (s or 0)
                        if target not in counts:
                            continue
                        over_homes = -(-counts[target] // tile)
                        over_probes = -(-near[target] // tile)
                        for copy in range(over_probes if s is None else over_homes):
                            keys.append(np.full(len(at), target))
                            homes.append(salt[at] % over_homes if s is None else np.full(len(at), copy))
                            probes.append(np.full(len(at), copy) if s is None else salt[at] % over_probes)
                            role.append(np.full(len(at), 0 if s is None else 1 if s == 0 else 2))
                            rows.append(at)
        take = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([
            *(pa.array(np.concatenate(c)) for c in (keys, homes, probes, role)), *(batch.column(i).take(take) for i in range(3)),
        ], ["key", "home", "probe", "role", "cid", "n", "code"])

    return map_arrow(codes, "key bigint, home bigint, probe bigint, role bigint, cid bigint, n bigint, code binary", work)


class _Forest:
    """Sure links of a tile: what they weigh for each row, and a spanning forest instead of all of them."""

    def __init__(self, cid: np.ndarray, n: np.ndarray):
        # a vector comes at home and as a probe: both rows are one node
        self.cid, self.node = np.unique(cid, return_inverse=True)
        self.weight = np.zeros(len(self.cid), np.int64)
        self.n = np.zeros(len(self.cid), np.int64)
        self.n[self.node] = n
        self.top = np.arange(len(self.cid))
        self.edges: list[np.ndarray] = []

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        u, v = self.node[left], self.node[right]
        np.add.at(self.weight, u, self.n[v])
        np.add.at(self.weight, v, self.n[u])
        while True:
            x, y = self.top[u], self.top[v]
            apart = x != y
            if not apart.any():
                return
            u, v, x, y = u[apart], v[apart], x[apart], y[apart]
            high, first = np.unique(np.maximum(x, y), return_index=True)
            self.edges.append(np.stack([u[first], v[first]]))
            parent = np.arange(len(self.top))
            parent[high] = np.minimum(x, y)[first]
            while not np.array_equal(above := parent[parent], parent):
                parent = above
            self.top = parent[self.top]

    def batches(self) -> Iterator[pa.RecordBatch]:
        held = np.flatnonzero(self.weight)
        if len(held):
            yield _found(_WEIGHT, self.cid[held], self.weight[held])
            edges = np.concatenate(self.edges, axis=1)
            yield _found(_SURE, self.cid[edges[0]], self.cid[edges[1]])


_ASK, _SURE, _WEIGHT = 0, 1, 2


def _found(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])


def _range_join(part: pa.Table, plans: dict[int, Plan]) -> Iterator[pa.RecordBatch]:
    """Pairs to verify, a forest of the links that are sure by their codes, and the weights of these links."""
    key, home, probe, role, cid, n = (part.column(c).to_numpy() for c in ("key", "home", "probe", "role", "cid", "n"))
    column = part.column("code").combine_chunks()
    starts = np.append(group_starts(key, home, probe), len(key))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        at_home, others = np.flatnonzero(role[a:b] == 0), np.flatnonzero(role[a:b] > 0)
        if not len(at_home) or not len(others):
            continue
        plan = plans[int(key[a]) >> 32]
        block = (int(key[a]) & 0xFFFFFFFF) >> 7 * plan.axes
        code = _matrix(column, np.arange(a, b), plan.dims).astype(np.float32)
        tile_cid, tile_role = cid[a:b], role[a:b]
        forest = _Forest(tile_cid, n[a:b])
        lo, hi = plan.edges[block], plan.edges[block + 1]
        limits = (plan.radius / _STEP) ** 2
        # squared gap minus its limit as one matrix product, in pieces that stay in the processor's cache
        ones = np.ones((b - a, 1), np.float32)
        side = code[:, lo:hi]
        square = (side * side).sum(axis=1, keepdims=True)
        probes = np.hstack([side, square - limits[block], ones])[others]
        homes = np.ascontiguousarray(np.hstack([-2 * side, ones, square])[at_home].T)
        for i in range(0, len(others), 128):
            for k in range(0, len(at_home), 2048):
                hits = np.flatnonzero(probes[i : i + 128] @ homes[:, k : k + 2048] <= 0)
                if not len(hits):
                    continue
                x, y = np.divmod(hits, min(2048, len(at_home) - k))
                left, right = others[i + x], at_home[k + y]
                keep = (tile_cid[left] != tile_cid[right]) & ((tile_role[left] == 2) | (tile_cid[left] < tile_cid[right]))
                left, right = left[keep], right[keep]
                for j in range(0, len(left), 65_536):
                    u, v = left[j : j + 65_536], right[j : j + 65_536]
                    gaps = (code[u] - code[v]) ** 2
                    total = gaps.sum(axis=1)
                    ok = total <= plan.whole**2
                    # the blocks before this one pass on what they admit
                    for earlier in range(block):
                        ok &= gaps[:, plan.edges[earlier] : plan.edges[earlier + 1]].sum(axis=1) > limits[earlier]
                    sure = ok & (plan.sure > 0) & (total <= plan.sure * abs(plan.sure))
                    if sure.any():
                        forest.add(u[sure], v[sure])
                    ok &= ~sure
                    if ok.any():
                        yield _found(_ASK, tile_cid[u[ok]], tile_cid[v[ok]])
        yield from forest.batches()


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Candidates whose cosine, in double precision, reaches the threshold."""
    left = vectors.select(F.col("cid").alias("a"), F.col("vector").alias("x"))
    right = vectors.select(F.col("cid").alias("b"), F.col("vector").alias("y"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = np.zeros(batch.num_rows, bool)
        for dims, rows in _by_length(pc.list_value_length(batch.column(2)).to_numpy()):
            x, y = (_doubles(batch.column(i), rows, dims) for i in (2, 3))
            good[rows] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= threshold
        return batch.select(["a", "b"]).filter(pa.array(good))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return map_arrow(joined, "a bigint, b bigint", work)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of `vectors`.

    Rows of equal vectors are one class, joined once; vectors of each length are joined among themselves.
    Vectors that are NULL, empty or zero, or hold NULL or non-finite components link with nothing.
    Repeated rows are vectors of their own that link; a NULL id counts as a link and never names
    a component that has another id. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    classes = rows.filter(good).groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    codes = materialise(_codes(classes), "codes")
    # a row per length, not per vector
    lengths = codes.groupBy(F.octet_length("code").alias("dims")).count().collect()
    plans = {r["dims"]: Plan(r["dims"], threshold, blocks, r["count"]) for r in lengths}
    counts = _cell_counts(codes, plans)
    tiles = _tiles(codes, plans, counts, tile)
    found = whole_groups(tiles, ["key", "home", "probe"], "kind int, a bigint, b bigint", lambda part: _range_join(part, plans))
    found = materialise(found, "found")
    asked = materialise(_verified(found.filter(f"kind = {_ASK}").select("a", "b"), classes, threshold), "links")
    links = asked.union(found.filter(f"kind = {_SURE}").select("a", "b"))
    both = asked.union(asked.select("b", "a"))
    asked_weights = both.join(classes.select(F.col("cid").alias("b"), "n"), "b").select("a", "n")
    weights = asked_weights.union(found.filter(f"kind = {_WEIGHT}").select("a", "b")).groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(links).withColumnsRenamed({"node": "cid", "root": "top"})
    placed = classes.join(roots, "cid", "left").withColumn("top", F.coalesce("top", "cid"))
    least = placed.groupBy("top").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "top").join(weights.withColumnRenamed("a", "cid"), "cid", "left")
    named = named.select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.filter(good).join(named, "vector").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op9_subspace_pigeonhole")
def op9(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
