"""Suffix-array deduplication: maximal repeats from the common-prefix interval tree.

Every 400-byte string has one anchor, the 64 bytes of least hash in it. Neighbouring starts
with one anchor form a run, and equal strings lie in runs of one anchor at equal distance,
so runs meet by anchor instead of by suffix. Runs of equal bytes are one class, counted before
anything is shipped. The distinct classes of an anchor are laid into an enhanced suffix array;
a stack scan over its common prefixes visits the interval tree, and intervals whose occurrences
differ in the byte to their left are the maximal repeats, reported with all their occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch_bytes, group_starts, keyed_documents, map_arrow, prefix_hashes, ranges, same_document, slice_hashes, whole_groups
from tidemark.llm.registry import query, table
from tidemark.session import materialise

LENGTH, ANCHOR = 400, 64
#: Anchors with more distinct runs are dealt again by longer shared cores; where even a core has more,
#: its starts are counted by their bytes instead of being put into one array.
ARRAY_CLASSES = 1000
#: Runs of a hot anchor are cut by the distance from the anchor; all starts of a piece share a core.
PIECE = 43
#: Bits of a key that hold the place; fixed, so that ties fall alike in every batch.
_PLACE_BITS = 24


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, size: int) -> tuple[np.ndarray, ...]:
    """Per run: row, first start (in the row), number of starts, anchor hash, hash of the bytes of the run."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(5))
    n, width = len(data), length - size + 1
    starts_per_row = np.maximum(np.diff(offsets) - length + 1, 0)
    if not starts_per_row.any():
        return empty
    sums = prefix_hashes(data)
    place = np.arange(n - size + 1)
    grams = slice_hashes(sums, place, place + size)
    low = np.uint64(max(_PLACE_BITS, int(n).bit_length()))
    keys = (grams >> low << low) | place.astype(np.uint64)
    padded = np.full(-(-len(keys) // width) * width + width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    start = ranges(offsets[:-1], starts_per_row)
    least = np.minimum(behind[start], ahead[start + width - 1])
    anchor = (least & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(starts_per_row)), starts_per_row)
    first = group_starts(row, anchor)
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    digest = slice_hashes(sums, begin, begin + count + length - 1)
    return row[first], begin - offsets[:-1][row[first]], count, grams[anchor[first]].view(np.int64), digest.view(np.int64)


class EnhancedSuffixArray:
    """Suffixes that begin in the first `counts` bytes of each text, sorted, with common prefix lengths.

    Ranks of prefixes of 8, 16, ... 256 bytes are found by doubling and kept, for order and for lengths.
    """

    def __init__(self, texts: list[bytes], counts: np.ndarray):
        sizes = np.array([len(t) for t in texts])
        self.begin = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(texts) + bytes(1024), np.uint8)
        n = len(data) - 1024
        word = np.zeros(n + 512, np.uint64)
        for i in range(8):
            word = (word << np.uint64(8)) | data[i : i + n + 512]
        ranks = [np.unique(word, return_inverse=True)[1].astype(np.int32)]
        step = 8
        while step < 256:
            last = ranks[-1]
            pair = last.astype(np.int64) * (int(last.max()) + 1)
            pair[:-step] += last[step:]
            ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
            step *= 2
        self.data = data
        start = ranges(self.begin, counts)
        text = np.repeat(np.arange(len(texts)), counts)
        top = ranks[-1]
        far = np.minimum(start + 512, len(top) - 1)
        order = np.lexsort((top[far], top[np.minimum(start + 256, len(top) - 1)], top[start]))
        self.suffix, self.text = start[order], text[order]
        # the byte before a suffix; what stands before a text is unknown, so it equals nothing
        self.left = np.where(self.suffix > self.begin[self.text], data[np.maximum(self.suffix - 1, 0)].astype(np.int64), -1 - self.text)
        end = (self.begin + sizes)[self.text]
        room = np.minimum(end[1:] - self.suffix[1:], end[:-1] - self.suffix[:-1])
        common = np.zeros(len(room), np.int64)
        going = np.arange(len(room))
        for _ in range(3):
            a, b = self.suffix[1:][going] + common[going], self.suffix[:-1][going] + common[going]
            keep = (common[going] + 256 <= room[going]) & (top[np.minimum(a, len(top) - 1)] == top[np.minimum(b, len(top) - 1)])
            going = going[keep]
            common[going] += 256
        for level in range(len(ranks) - 2, -1, -1):
            size = 8 << level
            fits = common + size <= room
            a, b = np.where(fits, self.suffix[1:] + common, 0), np.where(fits, self.suffix[:-1] + common, 0)
            common += np.where(fits & (ranks[level][a] == ranks[level][b]), size, 0)
        for _ in range(7):
            fits = common < room
            a, b = np.where(fits, self.suffix[1:] + common, 0), np.where(fits, self.suffix[:-1] + common, 0)
            same = fits & (data[a] == data[b])
            common += same
            if not same.any():
                break
        self.common = common

    def repeats(self, length: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(length, occurrences)`` of the maximal repeats of at least `length` bytes."""
        close = np.concatenate(([False], self.common >= length, [False]))
        opens = np.flatnonzero(close[1:] & ~close[:-1])
        ends = np.flatnonzero(close[:-1] & ~close[1:])
        if not len(opens):
            return
        # an interval that has one byte to its left is part of a longer one; so are all below it
        different = np.concatenate(([0], np.cumsum(self.left[1:] != self.left[:-1])))
        diverse = different[ends] > different[opens]
        for a, b in zip(opens[diverse].tolist(), ends[diverse].tolist()):
            yield from self._scan(a, b, different)

    def _scan(self, a: int, b: int, different: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Stack scan of the suffixes a..b, each interval once, when its last suffix has passed."""
        stack: list[tuple[int, int]] = []
        common = self.common[a:b].tolist() + [-1]
        for i, depth in enumerate(common, start=a):
            left = i
            while stack and stack[-1][0] > depth:
                size, left = stack.pop()
                if different[i] > different[left]:
                    yield size, self.suffix[left : i + 1]
            if depth >= 0 and (not stack or stack[-1][0] < depth):
                stack.append((depth, left))


def covered(texts: list[bytes], counts: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Per text, the maximal runs of bytes that its maximal repeats cover."""
    array = EnhancedSuffixArray(texts, counts)
    sizes = np.array([len(t) for t in texts])
    change = np.zeros(int(sizes.sum()) + 1, np.int64)
    for size, places in array.repeats(length):
        np.add.at(change, places, 1)
        np.add.at(change, places + size, -1)
    inside = np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False]))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    opens, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    owner = np.searchsorted(array.begin, opens, "right") - 1
    for a, b, t in zip(opens.tolist(), ends.tolist(), owner.tolist()):
        # a run may touch the next text, never belong to it
        while b > array.begin[t] + sizes[t]:
            stop = int(array.begin[t] + sizes[t])
            out[t].append((a - int(array.begin[t]), stop - int(array.begin[t])))
            a, t = stop, t + 1
        out[t].append((a - int(array.begin[t]), b - int(array.begin[t])))
    return out


def _runs(keyed: DataFrame, length: int, size: int) -> DataFrame:
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = batch_bytes(batch.column(2))
        row, first, count, anchor, digest = anchors_of(data, offsets, length, size)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor), pa.array(digest),
            pa.array(first), pa.array(count)], ["doc_id", "_h", "anchor", "digest", "first", "count"])

    return map_arrow(keyed, f"doc_id {id_type}, _h bigint, anchor bigint, digest bigint, first bigint, count bigint", work)


def _lead(blob: bytes, count: int, length: int, size: int) -> int:
    """Distance from the first start of a run to its anchor."""
    data = np.frombuffer(blob, np.uint8)[count - 1 : count - 1 + length]
    place = np.arange(length - size + 1)
    grams = slice_hashes(prefix_hashes(data), place, place + size) >> np.uint64(_PLACE_BITS)
    return count - 1 + int(grams.argmin())


def _pieces(anchor: int, blob: bytes, count: int, length: int, size: int) -> Iterator[tuple[int, int, int]]:
    """Cut the starts of a run by their distance from the anchor: ``(key of the shared core, first start, starts)``."""
    lead = _lead(blob, count, length, size)
    at = 0
    while at < count:
        band = (lead - at) // PIECE
        # starts of the band lie `band * PIECE` to that plus PIECE - 1 bytes before the anchor
        stop = min(count, lead - band * PIECE + 1)
        core = blob[lead - band * PIECE : lead - (band + 1) * PIECE + 1 + length]
        key = xxhash.xxh64_intdigest(core, (anchor + band) & 0xFFFFFFFFFFFFFFFF)
        yield key - (1 << 64) if key >> 63 else key, at, stop - at
        at = stop


def _cut(asked: DataFrame, length: int, size: int) -> DataFrame:
    """The bytes of the asked runs of each document; those of hot anchors in pieces."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for text, runs in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
            for r in runs:
                blob = text[r["first"] : r["first"] + r["count"] + length - 1]
                if not r["hot"]:
                    out.append((r["anchor"], r["anchor"], r["digest"], 0, r["count"], r["one"], blob))
                    continue
                for key, at, count in _pieces(r["anchor"], blob, r["count"], length, size):
                    out.append((key, r["anchor"], r["digest"], at, count, r["one"], blob[at : at + count + length - 1]))
        kinds = (pa.int64(),) * 5 + (pa.bool_(), pa.binary())
        columns = zip(*out) if out else ((),) * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], _SHIPPED)

    return map_arrow(asked, "key bigint, anchor bigint, digest bigint, at bigint, count bigint, one boolean, blob binary", work)


_SHIPPED = ["key", "anchor", "digest", "at", "count", "one", "blob"]
_SPANS = "anchor bigint, digest bigint, begin bigint, end bigint"


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "digest", "begin", "end"])


def _array_spans(part: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    found = covered(part.column("blob").to_pylist(), part.column("count").to_numpy(), length)
    keys = zip(*(part.column(c).to_pylist() for c in ("anchor", "digest", "at", "one")), found)
    yield _span_batch([(a, d, at + x, at + y) for a, d, at, one, spans in keys if one for x, y in spans])


def _starts(part: DataFrame, length: int) -> DataFrame:
    """Every start of the pieces of a hot core, keyed by its bytes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = batch_bytes(batch.column(5))
        count = batch.column(2).to_numpy()
        sums = prefix_hashes(data)
        at = ranges(offsets[:-1], count)
        row = np.repeat(np.arange(len(count)), count)
        take = pa.array(row)
        weight = np.where(batch.column(3).to_numpy(zero_copy_only=False)[row], 1, 2)
        base = batch.column(4).to_numpy()[row]
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(take), batch.column(1).take(take), pa.array(slice_hashes(sums, at, at + length).view(np.int64)),
            pa.array(base + at - offsets[:-1][row]), pa.array(weight.astype(np.int64))], ["anchor", "digest", "bytes", "begin", "weight"])

    return map_arrow(part.select("anchor", "digest", "count", "one", "at", "blob"), "anchor bigint, digest bigint, bytes bigint, begin bigint, weight bigint", work)


def repeated_spans(keyed: DataFrame, length: int = LENGTH, size: int = ANCHOR, array_classes: int = ARRAY_CLASSES) -> DataFrame:
    """``doc_id, _h, begin, end``: byte ranges covered by repeats, overlapping ranges included."""
    runs = materialise(_runs(keyed, length, size), "runs")
    classes = runs.groupBy("anchor", "digest").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "_h", "first")).alias("place"), F.min("count").alias("count"))
    classes = materialise(classes, "classes")
    several = classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.min("n").alias("fewest"))
    several = several.filter((F.col("classes") > 1) & (F.col("fewest") == 1))
    asked = classes.join(several, "anchor").select(
        "place.*", "anchor", "digest", "count", (F.col("n") == 1).alias("one"), (F.col("classes") > array_classes).alias("hot"))
    asked = asked.groupBy("doc_id", "_h").agg(F.collect_list(F.struct("anchor", "digest", "first", "count", "one", "hot")).alias("runs"))
    shipped = materialise(_cut(keyed.join(asked, same_document(keyed, asked)).select("text", "runs"), length, size), "shipped")
    heavy = shipped.groupBy("key").count().filter(F.col("count") > array_classes).select("key")
    arrays = whole_groups(shipped.join(heavy, "key", "left_anti").select(*_SHIPPED), ["key"], _SPANS,
                          lambda part: _array_spans(part, length), rows=1500)
    starts = _starts(shipped.join(heavy, "key", "left_semi"), length)
    twice = starts.groupBy("anchor", "bytes").agg(F.sum("weight").alias("weight")).filter("weight > 1")
    single = starts.filter("weight = 1").join(twice.select("anchor", "bytes"), ["anchor", "bytes"])
    single = single.select("anchor", "digest", "begin", (F.col("begin") + length).alias("end"))
    whole = classes.filter("n > 1").select("anchor", "digest", F.lit(0).cast("bigint").alias("begin"), (F.col("count") + (length - 1)).alias("end"))
    spans = whole.union(arrays).union(single)
    return runs.join(spans, ["anchor", "digest"]).select(
        "doc_id", "_h", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end")).alias("end"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: removed byte ranges (maximal, in order) and the bytes that stay.

    A byte goes if a string of `length` bytes that covers it starts anywhere else too, in the
    same document or another; all judgements are on the input. NULL and empty texts have no
    bytes; repeated rows are copies of each other; an empty table gives no rows.
    """
    keyed = keyed_documents(docs, id_col, text_col)
    spans = repeated_spans(keyed, length).groupBy("doc_id", "_h").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    joined = keyed.join(spans, same_document(keyed, spans), "left").select(keyed["doc_id"], keyed["text"], "found")
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, ranges_, kept = [], [], []
        found = batch.column(2)
        lists = found.is_valid().to_pylist()
        for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            sizes.append(len(text))
            if not lists[i]:
                ranges_.append([])
                kept.append(text)
                continue
            change = np.zeros(len(text) + 1, np.int64)
            values = found[i].values
            np.add.at(change, values.field("begin").to_numpy(), 1)
            np.add.at(change, values.field("end").to_numpy(), -1)
            inside = np.cumsum(change[:-1]) > 0
            edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
            ranges_.append([{"begin": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
            kept.append(np.frombuffer(text, np.uint8)[~inside].tobytes())
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ranges_, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return map_arrow(joined, f"doc_id {id_type}, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary", work)


@query("op4_suffix_intervals")
def op4(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
