"""SimHash near-duplicates: fingerprints searched in Burkhard-Keller trees, one tree per shard.

Two fingerprints within three bits agree on one of four 16-bit blocks, so every link lies
inside a shard of fingerprints that share a block. A shard is one tree: children are keyed
by their integer Hamming distance to the parent, and a search follows only the edges within
the radius of its own distance. Fingerprints grow with the corpus, so the trees are built
where a shuffle brings the shard, rather than broadcast from the driver.

The pipeline's stage asks for more than three bits can show: its trees are searched within a
wide radius, in shards of texts that share a smallest shingle hash, and sets of shingles decide.
What the trees leave apart meets once more, through the rarest shingles of each text, so no link is lost.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch_bytes, group_starts, map_arrow, mix64, ranges, whole_groups
from tidemark.llm.graph import components
from tidemark.llm.registry import query, table
from tidemark.session import discard, free_shuffles, materialise, materialise_at

RADIUS = 3
#: Larger shards are dealt again by the blocks of their remaining bits.
SHARD_ROWS = 4096
#: The search by sets: at a Jaccard similarity of 0.8 about 10 of 64 bits differ, 16 are two deviations more.
WIDE_RADIUS, SIMILAR = 16, (4, 5)
#: Larger shards of that search are cut into parts; members of the sets found meet again, at most this many times in all.
TREE_ROWS, LEVELS = 512, 4
#: Postings of rare shingles to a part of the exact search, and pairs of them that are looked at together.
POSTINGS_PER_PART, PAIRS_AT_ONCE = 400_000, 1_000_000
#: Shingles are ordered from rare to common by a table of so many counts; any order is exact.
_RARITY_BITS = 16
_SALTS = mix64(np.arange(1, 3 * LEVELS + 1, dtype=np.uint64))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, n: int = 3, seed: int = 42) -> list[int]:
    words = text.translate(_LOWER).split()
    if not words:
        return []
    if len(words) < n:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(part), seed) for part in zip(*(words[i:] for i in range(n)))]


def fingerprint(hashes: list[int]) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half the hashes."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: one row per row of `docs`; NULL and empty texts have fingerprint zero."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = batch_bytes(batch.column(1))
        whole = data.tobytes()
        marks = [fingerprint(shingle_hashes(whole[a:b], shingle)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(chosen, f"doc_id {id_type}, fp bigint", work)


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while new:
            distance = (self.values[at] ^ value).bit_count()
            below = self.children[at].setdefault(distance, new)
            if below == new:
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values at most `radius` bits away."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    stack.append(child)
        return found


def _links(table_: pa.Table, radius: int):
    """Per shard, a tree is grown value by value; each value is tied to the set its neighbours are in."""
    keys = table_.column("shard").to_numpy()
    values = table_.column("fp").to_numpy()
    starts = np.append(group_starts(keys), len(keys))
    left, right = [], []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a < 2:
            continue
        tree, parent = BKTree(), []
        group = [v & 0xFFFFFFFFFFFFFFFF for v in values[a:b].tolist()]
        for i, value in enumerate(group):
            parent.append(i)
            for j in tree.within(value, radius):
                while parent[j] != j:
                    parent[j] = parent[parent[j]]
                    j = parent[j]
                top = i
                while parent[top] != top:
                    top = parent[top]
                parent[max(top, j)] = min(top, j)
            tree.add(value)
        for i in range(len(group)):
            top = i
            while parent[top] != top:
                top = parent[top]
            if top != i:
                left.append(int(values[a + i]))
                right.append(int(values[a + top]))
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _deal(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """A row per block of the remaining `width` bits; the block leaves the remaining bits."""
    block = width // parts
    out = rows.withColumn("t", F.explode(F.array(*[F.lit(t) for t in range(parts)])))
    choices, rests = None, None
    for t in range(parts):
        low = t * block
        size = block if t < parts - 1 else width - low
        value = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << size) - 1))
        below = F.col("rest").bitwiseAND(F.lit((1 << low) - 1)) if low else F.lit(0).cast("bigint")
        above = F.shiftleft(F.shiftrightunsigned("rest", low + size), low) if low + size < 64 else F.lit(0).cast("bigint")
        rest = below.bitwiseOR(above)
        choices = F.when(F.col("t") == t, value) if choices is None else choices.when(F.col("t") == t, value)
        rests = F.when(F.col("t") == t, rest) if rests is None else rests.when(F.col("t") == t, rest)
    # shards whose hashes collide are merely searched together
    return out.select("fp", F.xxhash64("shard", "t", choices).alias("shard"), rests.alias("rest"))


def links(marks: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``a, b``: edges among distinct fingerprints that join exactly what lies within `radius` bits.

    A shard contributes a spanning forest of its links, never all pairs. Shards above
    `shard_rows` are dealt again, twice at most, by blocks of the bits they do not share yet.
    """
    parts = radius + 1
    rows = _deal(marks.select("fp", F.lit(0).cast("bigint").alias("shard"), F.col("fp").alias("rest")), 64, parts)
    cold, width = [], 64 - 64 // parts
    for _ in range(2):
        heavy = rows.groupBy("shard").count().filter(F.col("count") > shard_rows).select("shard")
        cold.append(rows.join(heavy, "shard", "left_anti").select("shard", "fp"))
        rows = _deal(rows.join(heavy, "shard", "left_semi"), width, parts)
        width -= width // parts
    cold.append(rows.select("shard", "fp"))
    dealt = cold[0].union(cold[1]).union(cold[2])
    return whole_groups(dealt, ["shard"], "a bigint, b bigint", lambda part: _links(part, radius))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of `docs`.

    Fingerprints at most `radius` bits apart are linked; ``component_id`` is the smallest id
    reachable, the document itself included. Texts that are NULL, empty or blank share the
    fingerprint zero and are linked like any other. Rows that repeat are linked with
    themselves; a NULL id counts only where a component has no other. No rows, no result.
    """
    marks = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, radius)).withColumnsRenamed({"node": "fp", "root": "top"})
    placed = distinct.join(roots, "fp", "left").withColumn("top", F.coalesce("top", "fp"))
    least = placed.groupBy("top").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "top").join(least, "top").select("fp", "component_id")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marks.join(named, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``doc_id, digest, fp, keys, bag``: fingerprint, smallest scrambled hashes and hashes of the shingles.

    ``digest`` names the shingles with their repeats, so equal digests are equal bags. ``bag``
    holds the distinct shingles as sorted 32-bit hashes. NULL and blank texts have no shingle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = batch_bytes(batch.column(1))
        whole = data.tobytes()
        digests, marks, keys, bags = [], [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            hashes = shingle_hashes(whole[a:b], shingle)
            marks.append(fingerprint(hashes))
            hashes = np.sort(np.array(hashes, np.uint64))
            digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest())
            least = np.full(len(_SALTS), 0xFFFFFFFFFFFFFFFF, np.uint64)
            for low in range(0, len(hashes), 1 << 16):
                scrambled = mix64(hashes[low : low + (1 << 16)] ^ _SALTS[:, None])
                least = np.minimum(least, scrambled.min(axis=1))
            keys.append(least.view(np.int64))
            bags.append(np.unique((hashes >> np.uint64(32)).astype(np.uint32)).tobytes())
        lists = pa.ListArray.from_arrays(pa.array(range(0, len(_SALTS) * (len(keys) + 1), len(_SALTS)), pa.int32()), pa.array(np.concatenate(keys)))
        columns = [batch.column(0), pa.array(digests), pa.array(marks, pa.int64()), lists, pa.array(bags, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "fp", "keys", "bag"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(chosen, f"doc_id {id_type}, digest string, fp bigint, keys array<bigint>, bag binary", work)


def similar(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the fraction `threshold`."""
    over, under = threshold
    if under * min(len(a), len(b)) < over * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return under * shared >= over * (len(both) - shared)


def _bag_links(table_: pa.Table, radius: int, threshold: tuple[int, int]):
    """Trees as in :func:`_links`; a neighbour counts if the sets are similar, and is not asked if both are linked already.

    Shards marked as cut also name the least member of each of their sets, as a pair with itself.
    """
    shards, parts = (table_.column(c).to_numpy() for c in ("shard", "part"))
    values, cut = table_.column("fp").to_numpy(), table_.column("cut").to_numpy(zero_copy_only=False)
    names, packed = table_.column("cid").to_numpy(), table_.column("bag")
    starts = np.append(group_starts(shards, parts), len(shards))
    out_shard, left, right = [], [], []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        tree, parent = BKTree(), []
        bags = [np.frombuffer(packed[i].as_py(), np.uint32) for i in range(a, b)]

        def top(j):
            while parent[j] != j:
                parent[j] = parent[parent[j]]
                j = parent[j]
            return j

        for i, value in enumerate([v & 0xFFFFFFFFFFFFFFFF for v in values[a:b].tolist()]):
            parent.append(i)
            for j in tree.within(value, radius):
                mine, other = top(i), top(j)
                if mine != other and similar(bags[i], bags[j], threshold):
                    parent[max(mine, other)] = min(mine, other)
            tree.add(value)
        for i in range(b - a):
            if top(i) != i or cut[a]:
                out_shard.append(int(shards[a]))
                left.append(int(names[a + i]))
                right.append(int(names[a + top(i)]))
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_shard, left, right)], ["shard", "a", "b"])


def similar_links(classes: DataFrame, radius: int = WIDE_RADIUS, threshold: tuple[int, int] = SIMILAR, shard_rows: int = TREE_ROWS) -> DataFrame:
    """``a, b``: classes (`cid`) whose sets reach `threshold`, a spanning forest per shard; `classes` holds one row per bag.

    A shard holds what shares one of three smallest scrambled hashes: two sets agree on one of them with their
    similarity s as its chance, so 1 - (1 - s)^3 of the pairs meet (0.992 at 0.8). A shard above `shard_rows` is cut
    into parts by class; each part is searched, and one member of each set found goes on to shards by the next three
    hashes too. No pair below the threshold is named; those that did not meet are left to :func:`missed_links`.
    """
    rows, found = classes.select("cid", "fp", "keys", F.lit(0).cast("bigint").alias("shard")), None
    bags = classes.select("cid", "bag")
    for level in range(LEVELS):
        tags = F.array(*[F.struct(F.lit(t).alias("t"), F.col("keys")[t].alias("key")) for t in range(3 * level, 3 * level + 3)])
        dealt = rows.withColumn("_k", F.explode(tags)).select("cid", "fp", F.xxhash64("shard", "_k.t", "_k.key").alias("shard"))
        sizes = dealt.groupBy("shard").count().filter("count > 1")
        parts = F.ceil(2 * F.col("count") / shard_rows).cast("bigint")
        met = dealt.join(sizes, "shard").withColumn("cut", F.col("count") > shard_rows)
        met = met.withColumn("part", F.when(F.col("cut"), F.pmod(F.xxhash64("cid"), parts)).otherwise(0)).drop("count")
        work = functools.partial(_bag_links, radius=radius, threshold=threshold)
        pairs = materialise(whole_groups(met.join(bags, "cid"), ["shard", "part"], "shard bigint, a bigint, b bigint", work, rows=2000), "similar")
        found = pairs.select("a", "b") if found is None else found.union(pairs.select("a", "b"))
        ahead = pairs.filter("a = b").select("shard", F.col("a").alias("cid"))
        if level + 1 == LEVELS or ahead.isEmpty():
            break
        rows = ahead.join(classes.select("cid", "fp", "keys"), "cid")
    return found.filter("a <> b")


def _rarity(classes: DataFrame) -> np.ndarray:
    """Rank of each bucket of shingles by the number of sets that hold them, rarest first; 65,536 ranks at any size."""
    size, shift = 1 << _RARITY_BITS, np.uint32(32 - _RARITY_BITS)

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            data, _ = batch_bytes(batch.column(0))
            total += np.bincount(np.frombuffer(data.tobytes(), np.uint32) >> shift, minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counts = classes.select("bag").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size, np.int64)
    total[counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    ranks = np.zeros(size, np.uint64)
    ranks[np.argsort(total, kind="stable")] = np.arange(size, dtype=np.uint64)
    return ranks


_SET = np.dtype([("cid", "<i8"), ("top", "<i8"), ("size", "<u4")])
_POSTING = np.dtype([("word", "<u4"), ("place", "<u4"), ("set", "<u2")])


def _prefixes(sets: DataFrame, ranks: np.ndarray, threshold: tuple[int, int], parts: int) -> DataFrame:
    """``part, sets, postings``: per batch and part, the rarest shingles of each set, and the sets they are of.

    Two sets that reach the threshold share one of the size - ceil(threshold * size) + 1 rarest of both.
    """
    over, under = threshold
    shift = np.uint32(32 - _RARITY_BITS)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = batch_bytes(batch.column(2))
        words, size = np.frombuffer(data.tobytes(), np.uint32), np.diff(offsets) // 4
        owner = np.repeat(np.arange(len(size)), size)
        words = words[np.lexsort((ranks[words >> shift] << np.uint64(32) | words, owner))]
        take = np.where(size > 0, size - -(-over * size // under) + 1, 0)
        posts = np.empty(int(take.sum()), _POSTING)
        posts["word"] = words[ranges(offsets[:-1] // 4, take)]
        posts["place"] = ranges(np.zeros(len(take), np.int64), take)
        owner = np.repeat(np.arange(len(size)), take)
        part = (mix64(posts["word"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        posts, part, owner = posts[order], part[order], owner[order]
        known = np.empty(len(size), _SET)
        known["cid"], known["top"], known["size"] = batch.column(0).to_numpy(), batch.column(1).to_numpy(), size
        starts, blocks = group_starts(part), []
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(posts)).tolist()):
            # a batch has at most 1,000 rows where the session is settled, and two bytes hold any of its own
            of, posts["set"][a:b] = np.unique(owner[a:b], return_inverse=True)
            blocks.append((known[of].tobytes(), posts[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(part[starts]), *[pa.array([x[i] for x in blocks], pa.binary()) for i in (0, 1)]], ["part", "sets", "postings"])

    def small(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                yield work(batch.slice(at, 1 << 16))

    return sets.select("cid", "top", "bag").mapInArrow(small, "part bigint, sets binary, postings binary")


def _apart(table_: pa.Table, threshold: tuple[int, int], at_once: int):
    """Pairs of sets that share a rare shingle, lie in different components and may reach the threshold by size and place."""
    over, under = threshold
    key = table_.column("part").to_numpy()
    bounds = np.append(group_starts(key), len(key))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        sets = [np.frombuffer(x, _SET) for x in table_.column("sets").slice(a, b - a).to_pylist()]
        posts = [np.frombuffer(x, _POSTING) for x in table_.column("postings").slice(a, b - a).to_pylist()]
        base = np.cumsum([0, *map(len, sets)])[:-1]
        of = np.concatenate([p["set"].astype(np.int64) + low for p, low in zip(posts, base)])
        sets, posts = np.concatenate(sets), np.concatenate(posts)
        # a word's sets by size: the partners of a set stand behind it, up to the largest size that can still match
        order = np.lexsort((sets["size"][of], posts["word"]))
        of, word, place = of[order], posts["word"][order].astype(np.int64), posts["place"][order].astype(np.int64)
        cid, top, size = sets["cid"][of], sets["top"][of], sets["size"][of].astype(np.int64)
        wide = word << 31
        reach = np.searchsorted(wide | size, wide | (under * size // over), "right") - np.arange(len(of)) - 1
        before = np.append(0, np.cumsum(reach))
        low = 0
        while low < len(of):
            high = max(low + 1, int(np.searchsorted(before, before[low] + at_once, "right")) - 1)
            i = np.repeat(np.arange(low, high), reach[low:high])
            j = ranges(np.arange(low, high) + 1, reach[low:high])
            low = high
            i, j = (x[top[i] != top[j]] for x in (i, j))
            needed = -(-over * (size[i] + size[j]) // (over + under))
            ok = np.minimum(size[i] - place[i], size[j] - place[j]) >= needed
            x, y = np.minimum(cid[i[ok]], cid[j[ok]]), np.maximum(cid[i[ok]], cid[j[ok]])
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            if len(x):
                once = group_starts(x, y)
                yield pa.RecordBatch.from_arrays([pa.array(x[once]), pa.array(y[once])], ["a", "b"])


def missed_links(classes: DataFrame, placed: DataFrame, threshold: tuple[int, int] = SIMILAR, at_once: int = PAIRS_AT_ONCE, per_part: int = POSTINGS_PER_PART) -> DataFrame:
    """``a, b``: every pair of classes that reaches `threshold` and has different ``top`` in `placed` (``cid, top``).

    An exact search: each set is posted under its rarest shingles, sets of one shingle are paired, and the whole sets decide.
    Components that are known already bring no pairs of their own, so a large group of near copies is not expanded.
    """
    over, under = threshold
    sets = classes.join(placed, "cid").select("cid", "top", "bag")
    size = F.octet_length("bag") / 4
    postings = classes.agg(F.sum(size - F.ceil(size * over / under) + 1)).first()[0] or 0
    parts = max(1, math.ceil(postings / per_part))
    dealt = _prefixes(sets, _rarity(classes), threshold, parts)
    pairs = materialise(whole_groups(dealt, ["part"], "a bigint, b bigint", lambda t: _apart(t, threshold, at_once), rows=1).distinct(), "apart")
    side = lambda name: classes.select(F.col("cid").alias(name), F.col("bag").alias(f"{name}_bag"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        keep = [similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), threshold) for x, y in both]
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_bag", "b_bag"), "a bigint, b bigint", work)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = SIMILAR, radius: int = WIDE_RADIUS,
                      shard_rows: int = TREE_ROWS) -> DataFrame:
    """``doc_id, component_id`` for every row: documents linked by the Jaccard similarity of their shingles.

    Trees of fingerprints propose neighbours within a wide radius and the sets decide, so no pair below the threshold
    is linked; an exact search then looks for the links between what the trees left apart, so none at or above it is
    missed. Equal bags of shingles are one class; texts without a word are one class. A NULL id counts only where a
    component has no other. No rows, no result.
    """
    spark = docs.sparkSession
    marks, marks_at = materialise_at(sketches(docs, id_col, text_col, shingle), "sketches")
    grouped = marks.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("bag").alias("bag"))
    classes = materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = materialise(marks.select("doc_id", "digest"), "members")
    discard(spark, marks_at)
    free_shuffles(spark)
    linked = materialise(similar_links(classes, radius, threshold, shard_rows), "linked")
    free_shuffles(spark)
    placed = materialise(_placed(classes.select("cid"), linked), "placed")
    # the components found are one edge per class here; the links missed join them
    every = placed.select(F.col("cid").alias("a"), F.col("top").alias("b")).union(missed_links(classes, placed, threshold))
    top = materialise(_placed(classes.select("cid", "digest", "least"), every), "placed")
    least = top.groupBy("top").agg(F.min("least").alias("component_id"))
    named = top.select("digest", "top").join(least, "top").select("digest", "component_id")
    return members.join(named, "digest").select("doc_id", "component_id")


def _placed(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """`classes` with the smallest class of their component, ``top``."""
    roots = components(edges).withColumnsRenamed({"node": "cid", "root": "top"})
    return classes.join(roots, "cid", "left").withColumn("top", F.coalesce("top", "cid"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of :func:`similar_documents` (five words, Jaccard 0.8): the one with the smallest
    id (text hash on a tie). Rows that repeat stay once; texts without a word are one component."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = similar_documents(keyed.select(F.struct("doc_id", "_row").alias("doc_id"), "text"))
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id")["_row"].alias("_kept")).distinct()
    # the join deals the rows by their hash, so no second shuffle brings repeated rows together
    return keyed.join(kept, keyed["_row"] == kept["_kept"], "left_semi").dropDuplicates(["_row", "doc_id"]).drop("_row")


@query("op5_simhash_bk_trees")
def op5(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
