"""Conversation prefix trie: which first turns conversations share, and what sharing them saves.

Every first-d-turns sequence has a 128-bit digest: the combined hashes of its turns and their places.
Distinct digests are the nodes. A node's tier is the power of `TIER` its members reach; connected
nodes of one tier are a fragment with at most `TIER` nodes a level, so a third of all conversations
may share their first turns and still no fragment is large. A fragment becomes a flat table: a minimal
perfect hash gives each digest a slot (checked against the stored digest), counts are scattered into
arrays, and sums flow through the parent slots from the deepest level up. Fragments hand the sums of
their tops to the next tier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SQL_CRC_TABLE, mix64, sql_crc, whole_groups
from tidemark.llm.registry import query, table
from tidemark.session import materialise

#: Members up to which a node is of the lowest tier; each tier reaches this many times as far.
TIER = 4096
#: Conversations whose number agrees but for the last two digits take up to this many first turns from the first of them.
SHARED, BLOCK = 6, 100

_DIGEST = ["d1", "d2"]


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, at, n_own, h1, h2, size``: turns by place from 0, as two hashes and the code points of the text.

    Ordered by turn, NULL first, ties by role and text hash; NULL roles and texts are empty; rows
    that repeat are turns of their own; rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit("second"), role, text).alias("h2"), F.length(text).cast("long").alias("size"))
    one = Window.partitionBy("conv_id")
    place = F.row_number().over(one.orderBy(F.col("turn").asc_nulls_first(), "role", "h1", "h2")) - 1
    return rows.withColumn("at", place).withColumn("n_own", F.count("*").over(one)).drop("turn", "role")


def rebuilt(own: DataFrame) -> DataFrame:
    """``conv_id, depth, n, h1, h2, size``: conversations that begin as their block's first one does.

    Conversation c takes the first h turns of ``c - c % BLOCK`` (what there is of them), h being
    the CRC-32 of its decimal number modulo `SHARED`, and keeps its own turns after the first h.
    ``depth`` counts from 1; depth 0 stands for the conversation itself, with or without turns.
    """
    turn = F.struct("at", "h1", "h2", "size")
    starts = own.filter((F.col("conv_id") % BLOCK == 0) & (F.col("at") < SHARED - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("starts"))
    convs = own.filter("at = 0").select(
        "conv_id", "n_own", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int").alias("h"))
    taken = F.coalesce(F.slice("starts", F.lit(1), F.col("h")), F.array().cast("array<struct<at:int,h1:bigint,h2:bigint,size:bigint>>"))
    info = convs.join(starts, "base", "left").select("conv_id", "h", "n_own", taken.alias("taken"))
    info = materialise(info.select("conv_id", "h", "taken", (F.size("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    zero = F.struct(F.lit(-1).alias("at"), *[F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "size")])
    begin = info.select("conv_id", "n", F.explode(F.concat(F.array(zero), "taken")).alias("t")).select("conv_id", (F.col("t.at") + 1).alias("depth"), "n", "t.h1", "t.h2", "t.size")
    rest = own.join(info, "conv_id").filter("at >= h").select("conv_id", (F.size("taken") + F.col("at") - F.col("h") + 1).alias("depth"), "n", "h1", "h2", "size")
    return begin.union(rest)


def whole(own: DataFrame) -> DataFrame:
    """The rows of ``rebuilt`` for conversations as they are."""
    roots = own.filter("at = 0").select("conv_id", F.lit(0).alias("depth"), F.col("n_own").alias("n"), *[F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "size")])
    return roots.union(own.select("conv_id", F.col("at") + 1, "n_own", "h1", "h2", "size"))


def _prefixes(rows: DataFrame) -> DataFrame:
    """The digest of each prefix and of the one before it."""
    term = lambda *c: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*c))
    terms = rows.withColumn("t1", term("depth", "h1", "h2")).withColumn("t2", term(F.lit("second"), "depth", "h2", "h1"))
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = terms.withColumn("d1", F.bit_xor("t1").over(so_far)).withColumn("d2", F.bit_xor("t2").over(so_far))
    return sums.select("conv_id", "depth", "d1", "d2", F.col("d1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("t2")).alias("p2"),
                       "size", (F.col("depth") == F.col("n")).alias("ends"))


class SlotTable:
    """A minimal perfect hash of distinct 128-bit digests: levels of bits, ranks over them, digests to check against."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.hi, self.lo = np.zeros_like(hi), np.zeros_like(lo)
        self.slots = np.full(len(hi), -1, np.int64)
        rest, first = np.arange(len(hi)), 0
        while len(rest):
            if len(self.levels) == 64:
                raise ValueError("two nodes share a digest")
            size = max(8, 2 * len(rest))
            at = self._place(hi[rest], lo[rest], len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            ranks = first + np.cumsum(bits) - 1
            self.slots[rest[alone]] = ranks[at[alone]]
            self.levels.append((size, bits, ranks))
            first += int(alone.sum())
            rest = rest[~alone]
        self.hi[self.slots], self.lo[self.slots] = hi, lo
        if not ((self.hi[self.slots] == hi) & (self.lo[self.slots] == lo)).all():
            raise ValueError("a slot holds another digest")

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
        return (mix64(mix64(hi ^ salt) ^ lo) % np.uint64(size)).astype(np.int64)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slots of digests, -1 where the table does not hold them."""
        found, rest = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = self._place(hi[rest], lo[rest], level, size)
            hit = bits[at]
            found[rest[hit]] = ranks[at[hit]]
            rest = rest[~hit]
        held = found >= 0
        held[held] = (self.hi[found[held]] == hi[held]) & (self.lo[found[held]] == lo[held])
        return np.where(held, found, -1)


_KEEP = "p1 bigint, p2 bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint"
_SUMS = "n_children bigint, n_leaves bigint, saved_tokens bigint"
_SCHEMA = f"d1 bigint, d2 bigint, {_KEEP}, {_SUMS}, top boolean"


def _accumulate(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """Whole fragments: children, leaves and saved tokens of every node, from the deepest level up."""
    column = lambda name: part.column(name).to_numpy().astype(np.int64)
    digest = lambda name: column(name).view(np.uint64)
    nodes = SlotTable(digest("d1"), digest("d2"))
    slot, above = nodes.slots, nodes.find(digest("p1"), digest("p2"))
    n = len(slot)
    children, leaves, saved, depth = (np.zeros(n, np.int64) for _ in range(4))
    parent = np.full(n, -1, np.int64)
    root = column("depth") == 0
    parent[slot] = np.where(root, -1, above)  # the root is its own parent's digest
    for array, name in ((children, "n_children"), (leaves, "n_leaves"), (saved, "saved_tokens"), (depth, "depth")):
        array[slot] = column(name)
    np.add.at(children, parent[parent >= 0], 1)
    leaves[children == 0] = 1
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        inner = level[parent[level] >= 0]
        np.add.at(leaves, parent[inner], leaves[inner])
        np.add.at(saved, parent[inner], saved[inner])
    out = {name: part.column(name) for name in ("d1", "d2", "p1", "p2", "conv_id", "depth", "parent_conv_id", "n_convs")}
    out |= {"n_children": children[slot], "n_leaves": leaves[slot], "saved_tokens": saved[slot], "top": (parent[slot] < 0) & ~root}
    yield from pa.table(out).combine_chunks().to_batches()


def _tier(n: Column) -> Column:
    reached = F.lit(0)
    power = TIER
    while power < 1 << 62:
        reached = reached + (n > power).cast("int")
        power *= TIER
    return reached


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one digest in sorted rows as text: fewer rows for the node in which many conversations end."""
    for batch in batches:
        d1, d2, ids = (batch.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero((d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])) + 1
        starts, ends = np.r_[0, cuts][: len(d1)], np.r_[cuts, len(d1)][: len(d1)]
        text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, ends)]
        if text:
            yield pa.RecordBatch.from_arrays([pa.array(d1[starts]), pa.array(d2[starts]), pa.array(ids[starts]), pa.array(text, pa.string())], ["d1", "d2", "least", "ids"])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per digest over sorted pieces of its list, fed as they come."""
    key, state, done = None, None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.string())], ["d1", "d2", "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (a, b) != key:
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield out()
            done = []
    if key:
        done = [(*key, state.hexdigest())]
        yield out()


def _ends(rows: DataFrame) -> DataFrame:
    """``d1, d2, ends_sha256``: the conversations that end in a node, ascending; a hot node's list is cut over partitions first."""
    ids = rows.filter("ends").select(*_DIGEST, "conv_id")
    parts = ids.repartitionByRange(*_DIGEST, "conv_id").sortWithinPartitions(*_DIGEST, "conv_id").mapInArrow(_pack, "d1 bigint, d2 bigint, least bigint, ids string")
    return parts.repartition(*_DIGEST).sortWithinPartitions(*_DIGEST, "least").mapInArrow(_hash, "d1 bigint, d2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of prefixes; `turns` as ``rebuilt`` or ``whole`` return them.

    ``conv_id``: smallest member; ``depth``; ``parent_conv_id``: smallest member of the parent, NULL
    for the root; ``n_convs``: members; ``n_children``; ``n_leaves``: nodes without children in the
    subtree; ``saved_tokens``: over the subtree, members but one times code points of the last
    turn; ``ends_sha256``: hash of the ascending list of members that end here. The root is there
    as soon as there is a conversation; no conversations, no rows.
    """
    rows = materialise(_prefixes(turns), "prefixes")
    nodes = rows.groupBy(*_DIGEST).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least"))
    by_depth = Window.partitionBy("conv_id").orderBy("depth")
    placed = rows.drop("ends").join(nodes, _DIGEST).withColumn("tier", _tier(F.col("n_convs"))).withColumn("parent_conv_id", F.lag("least").over(by_depth))
    first = Window.partitionBy("conv_id", "tier").orderBy("depth")
    topped = placed.withColumn("top1", F.first("d1").over(first)).withColumn("top2", F.first("d2").over(first))
    # the smallest member's row speaks for the node
    placed = materialise(topped.filter("conv_id = least").withColumn("depth", F.col("depth").cast("long")), "nodes")
    done: list[DataFrame] = []
    for tier in range((placed.agg(F.max("tier")).first()[0] or 0) + 1):
        part = placed.filter(F.col("tier") == tier).withColumn("own", (F.col("n_convs") - 1) * F.col("size"))
        if done:
            tops = done[0]
            for more in done[1:]:
                tops = tops.union(more)
            tops = tops.filter("top").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(
                F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("arrived"))
            part = part.join(tops, _DIGEST, "left")
        else:
            part = part.withColumns({c: F.lit(None).cast("long") for c in ("n_children", "n_leaves", "arrived")})
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        sums = part.withColumns({"n_children": zero("n_children"), "n_leaves": zero("n_leaves"), "saved_tokens": F.col("own") + zero("arrived")})
        names = ["d1", "d2", *[x.split()[0] for x in f"{_KEEP}, {_SUMS}".split(", ")], "top1", "top2"]
        done.append(materialise(whole_groups(sums.select(*names), ["top1", "top2"], _SCHEMA, _accumulate), "sums"))
    result = done[0]
    for more in done[1:]:
        result = result.union(more)
    empty = hashlib.sha256(b"").hexdigest()
    return result.join(_ends(rows), _DIGEST, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


_SQL = f"""
WITH {SQL_CRC_TABLE}, turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS at_turn
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), ids AS (
  SELECT conv_id, {sql_crc("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % {SHARED} AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc
), rebuilt AS (
  SELECT i.conv_id, at_turn, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % {BLOCK} AND at_turn < h
  UNION ALL SELECT i.conv_id, at_turn, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND at_turn >= h
), paths AS (
  SELECT conv_id, row_number() OVER w AS depth, list({{'role': role, 'text': text}}) OVER w AS path, length(text) AS size
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY at_turn)
  UNION ALL SELECT conv_id, 0, [], 0 FROM ids
), members AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path, depth
), childs AS (
  SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
), known AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN childs c ON n.path = c.path AND n.depth = c.depth
), below AS (
  SELECT path[1:k] AS path, k AS depth, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS k FROM known) GROUP BY 1, 2
)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
  n.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM known n JOIN below b ON n.path = b.path AND n.depth = b.depth
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1] AND p.depth = n.depth - 1"""


@query("op12_prefix_trie", _SQL)
def op12(spark, sf_dir):
    return prefix_trie(rebuilt(materialise(numbered(table(spark, sf_dir, "conversations")), "turns")))
