"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Words are ordered from rare to common by a table of fixed size
that counts hashed words over the whole corpus; any order is exact, a good one keeps lists short.
Lines of equal sets are one class. Classes meet through the words of their prefix; length, position
and parity filters thin the pairs, the Jaccard similarity of the whole sets decides, and of
two lines that match the later one goes. The parity sketch of a long line is wider, as 64 bits of
many words differ by chance in no more places than a match may.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch_bytes, group_starts, keyed_documents, map_arrow, mix64, prefix_hashes, ranges, same_document, slice_hashes, whole_groups, words_of
from tidemark.llm.registry import query, table
from tidemark.session import discard, free_shuffles, materialise, materialise_at

THRESHOLD = 0.8
#: Of the pairs that pass the filters in one list, a line brings its first FIRST; if it has more and none of
#: those it brings anywhere matches, it is compared with all lines of its lists again.
FIRST = 4
#: Pairs of lists that are looked at together; a list with more of its own is walked in blocks.
PAIRS_AT_ONCE = 1_000_000
POSTINGS_PER_PART = 400_000
_RARITY_BITS = 16
#: Sets of more words than these have parity sketches of 2, 4 and 8 times 64 bits.
_WIDER = np.array([64, 150, 330])
#: Bits of the filter that keeps unconcerned documents out of the second shuffle of texts.
_FILTER_BITS = 1 << 23


def _line_sets(data: np.ndarray, offsets: np.ndarray, rarity: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Row and number of each line that has words, the bounds of its set, and the sorted words of all sets.

    With a rarity table, words are recoded so that their numeric order runs from rare to common.
    """
    breaks = np.flatnonzero(data == 10)
    begin, end = words_of(data, offsets)
    words = slice_hashes(prefix_hashes(data), begin, end)
    if rarity is not None:
        words = rarity[(words >> np.uint64(48)).astype(np.int64)].astype(np.uint64) << np.uint64(48) | words & np.uint64((1 << 48) - 1)
    row = np.searchsorted(offsets, begin, "right") - 1
    broken = np.searchsorted(breaks, begin)
    number = broken - np.searchsorted(breaks, offsets[row])
    line = broken + row  # grows with the row and with each line break
    starts = group_starts(line)
    row, number = row[starts], number[starts]
    line = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(line))))
    # one key of the line and the upper bits of the word; words that differ below them are rare and sorted by both
    bits = np.uint64(len(starts).bit_length())
    key = line.astype(np.uint64) << np.uint64(64) - bits | words >> bits if len(starts) else words
    order = np.argsort(key)
    key, sorted_ = key[order], words[order]
    if ((key[1:] == key[:-1]) & (sorted_[1:] != sorted_[:-1])).any():
        sorted_ = words[np.lexsort((words, line))]
    first = group_starts(line, sorted_)
    words, line = sorted_[first], line[first]
    starts = group_starts(line)
    return row, number, starts, np.diff(np.append(starts, len(line))), words


def rarity_table(docs: DataFrame) -> np.ndarray:
    """Rank of each bucket of hashed words by its count over all texts, rarest first; 65,536 ranks at any size."""
    size = 1 << _RARITY_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data, offsets = batch_bytes(batch.column(0))
            if len(data):
                begin, end = words_of(data, offsets)
                words = slice_hashes(prefix_hashes(data), begin, end)
                total += np.bincount((words >> np.uint64(64 - _RARITY_BITS)).astype(np.int64), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counts = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size, np.int64)
    total[counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    ranks = np.zeros(size, np.int64)
    ranks[np.argsort(total, kind="stable")] = np.arange(size)
    return ranks


def _prefix(size: np.ndarray, threshold: float) -> np.ndarray:
    """Words of a set that must hold one shared word; sets that only their equals can match need none."""
    least = np.ceil(threshold * size - 1e-9).astype(np.int64)
    return np.where(size * (1 / threshold - 1) >= 1 - 1e-9, size - least + 1, 0)


def _cells(size: np.ndarray) -> np.ndarray:
    """Cells of 64 bits in the parity sketch of a set."""
    return np.left_shift(1, np.searchsorted(_WIDER, size, "left"))


def _wide_sketches(mixed: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the sketches of all sets that have more than one, end to end, and how many each set has (0 for one)."""
    cells = _cells(size)
    cells[cells == 1] = 0
    ends = np.cumsum(cells)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for n in np.unique(cells[cells > 0]).tolist():
        sets = np.flatnonzero(cells == n)
        words = mixed[ranges(starts[sets], size[sets])]
        first = np.cumsum(size[sets]) - size[sets]
        bits, cell = np.uint64(1) << (words & np.uint64(63)), words >> np.uint64(6) & np.uint64(n - 1)
        for i in range(n):
            out[ends[sets] - n + i] = np.bitwise_xor.reduceat(np.where(cell == i, bits, np.uint64(0)), first)
    return out, cells


def _binary(data: bytes, lengths: np.ndarray) -> pa.Array:
    """Consecutive pieces of `data` as a binary column."""
    cut = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(cut), pa.py_buffer(data)])


def _classes(keyed: DataFrame, rarity: np.ndarray, threshold: float) -> DataFrame:
    """One row per set of words: the first line that has it, its size, parity sketch and prefix."""
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = batch_bytes(batch.column(2))
        row, number, starts, size, words = _line_sets(data, offsets, rarity)
        # sums do not depend on order; two of them name a set
        mixed = mix64(words)
        one, two = (np.add.reduceat(m, starts) if len(starts) else m for m in (mixed, mix64(mixed ^ np.uint64(0x5851F42D4C957F2D))))
        parity = np.bitwise_xor.reduceat(np.uint64(1) << (mixed & np.uint64(63)), starts) if len(starts) else mixed
        take = _prefix(size, threshold)
        prefix = _binary((words[ranges(starts, take)] >> np.uint64(32)).astype("<u4").tobytes(), 4 * take)
        wide, cells = _wide_sketches(mixed, starts, size)
        rows = pa.array(row)
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number.astype(np.int32)), pa.array(one.view(np.int64)),
            pa.array(two.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(parity.view(np.int64)), _binary(wide.tobytes(), 8 * cells), prefix,
        ], ["doc_id", "_h", "line", "k1", "k2", "size", "parity", "wide", "prefix"])

    lines = map_arrow(keyed, f"doc_id {id_type}, _h bigint, line int, k1 bigint, k2 bigint, size int, parity bigint, wide binary, prefix binary", work)
    first = lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "_h", "line", "size", "parity", "wide", "prefix")).alias("c")).select("c.*")
    # sorted by first occurrence over all partitions, so that a smaller cid is an earlier line
    at = ("doc_id", "_h", "line")
    return first.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("cid", F.monotonically_increasing_id())


_POSTING = np.dtype([("word", "<u4"), ("cid", "<i8"), ("size", "<u4"), ("place", "<u4"), ("parity", "<u8")])


def _dealt(classes: DataFrame, parts: int) -> DataFrame:
    """Postings of the prefixes and the wide sketches of each, packed into one block per batch and part."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = batch_bytes(batch.column(3))
        words = np.frombuffer(raw.tobytes(), "<u4")
        count = np.diff(offsets) // 4
        out = np.empty(len(words), _POSTING)
        out["word"] = words
        for name, column in (("cid", 0), ("size", 1)):
            out[name] = np.repeat(batch.column(column).to_numpy(), count)
        out["parity"] = np.repeat(batch.column(2).to_numpy().view(np.uint64), count)
        out["place"] = ranges(np.zeros(len(count), np.int64), count)
        part = (mix64(words.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        out, part = out[order], part[order]
        starts = group_starts(part)
        blocks = [out[a:b].tobytes() for a, b in zip(starts, np.append(starts[1:], len(out)))]
        raw, offsets = batch_bytes(batch.column(4))
        owner = np.repeat(np.arange(len(count)), count)[order]
        cells = np.diff(offsets)[owner] // 8
        wide = np.frombuffer(raw.tobytes(), "<u8")[ranges(offsets[owner] // 8, cells)]
        lengths = 8 * np.add.reduceat(cells, starts) if len(starts) else starts
        return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(blocks, pa.binary()), _binary(wide.tobytes(), lengths)], ["part", "block", "wide"])

    return map_arrow(classes.select("cid", "size", "parity", "prefix", "wide"), "part bigint, block binary, wide binary", work)


class _Lists:
    """Sorted postings of words that several lines have, and the filters on pairs of them."""

    def __init__(self, rows: np.ndarray, wide: np.ndarray, threshold: float):
        cells = _cells(rows["size"])
        cells[cells == 1] = 0
        begin = np.cumsum(cells) - cells
        # by time within a list, as long lists want it
        order = np.lexsort((rows["cid"], rows["word"]))
        word = rows["word"][order]
        first = group_starts(word)
        length = np.diff(np.append(first, len(word)))
        order = order[np.repeat(length > 1, length)]
        rows, cells, begin = rows[order], cells[order], begin[order]
        self.threshold, self.cid, self.cells = threshold, rows["cid"], cells
        self.size, self.place, self.parity = rows["size"].astype(np.int32), rows["place"].astype(np.int32), np.ascontiguousarray(rows["parity"])
        self.first = group_starts(rows["word"])
        self.bounds = np.append(self.first, len(rows))
        # sketches folded to each width that a pair of rows can share, and where a row has its own
        self.folded = {}
        for n in np.unique(cells[cells > 0]).tolist():
            slot, parts, at = np.zeros(len(rows), np.int32), [], 0
            for own in np.unique(cells[cells >= n]).tolist():
                held = np.flatnonzero(cells == own)
                slot[held] = at + np.arange(len(held))
                at += len(held)
                parts.append(np.bitwise_xor.reduce(wide[ranges(begin[held], cells[held])].reshape(len(held), own // n, n), axis=1))
            self.folded[n] = slot, np.concatenate(parts)

    def __len__(self) -> int:
        return len(self.cid)

    def may_match(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows that the length, position and parity filters leave; only pairs that cannot reach the threshold go."""
        nx, ny = self.size[i], self.size[j]
        needed = np.ceil(self.threshold / (1 + self.threshold) * (nx + ny) - 1e-9).astype(np.int32)
        ok = (
            (np.bitwise_count(self.parity[i] ^ self.parity[j]) <= nx + ny - 2 * needed)
            & (np.minimum(nx - self.place[i], ny - self.place[j]) >= needed)
            & (np.minimum(nx, ny) >= self.threshold * np.maximum(nx, ny) - 1e-9)
        )
        i, j, most = i[ok], j[ok], (nx + ny - 2 * needed)[ok]
        shared = np.minimum(self.cells[i], self.cells[j])
        ok = np.ones(len(i), bool)
        for n, (slot, sketch) in self.folded.items():
            at = np.flatnonzero(shared == n)
            # about 8 MB of sketches at once
            for part in np.array_split(at, max(1, len(at) * n >> 19)):
                ok[part] = np.bitwise_count(sketch[slot[i[part]]] ^ sketch[slot[j[part]]]).sum(axis=1, dtype=np.int64) <= most[part]
        return i[ok], j[ok]


def _kept_first(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of an earlier and a later row: the first `most` of each later row, and the rows that have more."""
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    starts = group_starts(y)
    count = np.diff(np.append(starts, len(y)))
    first = np.arange(len(y)) - np.repeat(starts, count) < most
    return x[first], y[first], y[starts][count > most]


def _long_list(lists: _Lists, begin: int, end: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one long list, in blocks: lines that have enough pairs are not looked at again."""
    found = np.zeros(end - begin, np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, end - begin, 256):
        stop = min(at + 256, end - begin)
        open_ = at + np.flatnonzero(found[at:] <= most)
        for part in np.array_split(open_, max(1, len(open_) // 1024)):
            i, j = np.divmod(np.arange((stop - at) * len(part)), max(1, len(part)))
            i, j = i + at, part[j]
            i, j = lists.may_match(begin + i[j > i], begin + j[j > i])
            few = found[j - begin] < most
            left.append(i[few])
            right.append(j[few])
            np.add.at(found, j - begin, 1)
    x, y, _ = _kept_first(np.concatenate(left), np.concatenate(right), most)
    return x, y, begin + np.flatnonzero(found > most)


def _candidates(part: pa.Table, threshold: float, most: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: an earlier and a later line that may match. Kind 1: a line with more pairs."""
    key = part.column("part").to_numpy()
    starts = np.append(group_starts(key), len(key))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        rows = np.frombuffer(b"".join(part.column("block").slice(a, b - a).to_pylist()), _POSTING)
        wide = np.frombuffer(b"".join(part.column("wide").slice(a, b - a).to_pylist()), "<u8")
        lists = _Lists(rows, wide, threshold)
        del rows, wide
        size, first, bounds = lists.size, lists.first, lists.bounds
        list_of = np.repeat(np.arange(len(first)), np.diff(bounds))
        by_size = np.lexsort((size, list_of))
        key_of = list_of[by_size] << 33
        # partners of a row stand behind it, up to the largest size that can still match
        limit = np.floor(size[by_size] / threshold + 1e-9).astype(np.int64)
        reach = np.searchsorted(key_of | size[by_size], key_of | limit, "right") - np.arange(len(lists)) - 1
        load = np.add.reduceat(reach, first) if len(first) else reach
        left, right, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        long = load > at_once
        for i in np.flatnonzero(long).tolist():
            x, y, open_ = _long_list(lists, int(bounds[i]), int(bounds[i + 1]), most)
            left.append(x)
            right.append(y)
            more.append(open_)
        load = np.where(long, 0, load)
        reach = np.where(long[list_of], 0, reach)
        cuts = np.searchsorted(np.cumsum(load), np.arange(0, int(load.sum()) + at_once, at_once), "right") if len(load) else [0]
        for low, high in zip(cuts[:-1], np.maximum(cuts[1:], cuts[:-1])):
            span = slice(int(bounds[low]), int(bounds[high]))
            i = np.repeat(np.arange(span.start, span.stop), reach[span])
            j = ranges(np.arange(span.start, span.stop) + 1, reach[span])
            i, j = lists.may_match(by_size[i], by_size[j])
            x, y, open_ = _kept_first(np.minimum(i, j), np.maximum(i, j), most)
            left.append(x)
            right.append(y)
            more.append(open_)
        x, y = np.concatenate(left), np.concatenate(right)
        cid = lists.cid
        same = cid[x] == cid[y]
        x, y = x[~same], y[~same]
        order = np.lexsort((cid[x], cid[y]))
        x, y = x[order], y[order]
        once = group_starts(cid[y], cid[x]) if len(x) else x
        x, y = x[once], y[once]
        again = np.unique(cid[np.concatenate(more)])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(np.zeros(len(x), np.int32), np.ones(len(again), np.int32))),
            pa.array(np.append(cid[x], again)), pa.array(np.append(cid[y], again))], ["kind", "a", "b"])


def _bits(slots: DataFrame, size: int) -> np.ndarray:
    """A filter of `size` bits, set at the numbers of the column ``slot``; at most size / 64 rows come back."""
    words = slots.selectExpr("shiftright(slot, 6) AS w", "shiftleft(1L, CAST(slot & 63 AS INT)) AS bit")
    bits = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[bits["w"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _concerned(keyed: DataFrame, asked: DataFrame) -> DataFrame:
    """Documents that a filter of fixed size takes for asked; it errs only by letting others through."""
    slot = F.pmod(F.xxhash64("doc_id", "_h"), F.lit(_FILTER_BITS))
    table_ = _bits(asked.select(slot.alias("slot")), _FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(3).to_numpy()
            hit = table_[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)
            yield batch.select([0, 1, 2]).filter(pa.array(hit == 1))

    return keyed.withColumn("slot", slot).mapInArrow(run, keyed.schema)


def _sets(keyed: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cid, doc_id, _h, line, words``: the whole sets of the wanted classes, from their first lines."""
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    asked = materialise(classes.join(wanted, "cid").select("doc_id", "_h", "line", "cid"), "asked")
    keyed = _concerned(keyed, asked)
    asked = asked.groupBy("doc_id", "_h").agg(F.collect_list(F.struct("line", "cid")).alias("asked"))
    joined = keyed.join(asked, same_document(keyed, asked)).select(keyed["doc_id"], keyed["_h"], "text", "asked")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = batch_bytes(batch.column(2))
        row, number, starts, size, words = _line_sets(data, offsets, None)
        lists = batch.column(3)
        counts = pa.compute.list_value_length(lists).to_numpy()
        flat = lists.flatten()
        want = np.repeat(np.arange(len(counts)), counts) << 32 | flat.field("line").to_numpy().astype(np.int64)
        have = row.astype(np.int64) << 32 | number.astype(np.int64)
        at = np.searchsorted(have, want)
        blob = [words[starts[i] : starts[i] + size[i]].tobytes() for i in at.tolist()]
        take = pa.array(want >> 32)
        return pa.RecordBatch.from_arrays([
            flat.field("cid"), batch.column(0).take(take), batch.column(1).take(take), flat.field("line"), pa.array(blob, pa.binary())],
            ["cid", "doc_id", "_h", "line", "words"])

    return map_arrow(joined, f"cid bigint, doc_id {id_type}, _h bigint, line int, words binary", work)


def _numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row, value and how often the value stood before in the row, as one number; and the values of each row."""
    data, offsets = batch_bytes(column)
    count = np.diff(offsets) // 2
    key = np.repeat(np.arange(len(count)), count) << 32 | np.frombuffer(data.tobytes(), "<u2").astype(np.int64) << 16
    starts = group_starts(key)
    return key + np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key)))), count


def _plausible(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs that two bytes of each word do not rule out; words that agree there count as shared, so no match is lost."""
    brief = map_arrow(sets.select("cid", "words"), "cid bigint, brief binary", lambda batch: pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array([(np.frombuffer(x, np.uint64) >> np.uint64(48)).astype("<u2").tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["cid", "brief"]))
    side = lambda name: brief.select(F.col("cid").alias(name), F.col("brief").alias(f"{name}_brief"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_brief", "b_brief")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        (x, nx), (y, ny) = _numbered(batch.column(2)), _numbered(batch.column(3))
        both = x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x] if len(y) else x[:0]
        shared = np.bincount(both >> 32, minlength=len(nx))
        return batch.select([0, 1]).filter(pa.array(shared >= threshold * (nx + ny - shared) - 1e-9))

    return map_arrow(joined, "a bigint, b bigint", work)


def _later(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``cid`` of the later line of each pair whose sets reach the threshold."""
    side = lambda name: sets.select(
        F.col("cid").alias(name), F.struct("doc_id", "_h", "line").alias(f"{name}_at"), F.col("words").alias(f"{name}_words"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    last = joined.select(F.when(F.col("a_at") < F.col("b_at"), F.col("b")).otherwise(F.col("a")).alias("cid"), "a_words", "b_words")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(y, x)
            shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(shared >= threshold * (len(x) + len(y) - shared) - 1e-9)
        return batch.select(["cid"]).filter(pa.array(keep))

    return map_arrow(last, "cid bigint", work).distinct()


def _postings(classes: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """``word, cid, size, parity, place``: a row for each word of a prefix, at least for those that the filter `asked` takes for asked."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = batch_bytes(batch.column(3))
        word, count = np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), np.diff(offsets) // 4
        owner, place = np.repeat(np.arange(len(count)), count), ranges(np.zeros(len(count), np.int64), count)
        if asked is not None:
            slot = word % _FILTER_BITS
            hit = (asked[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)) == 1
            word, owner, place = word[hit], owner[hit], place[hit]
        columns = [batch.column(i).take(pa.array(owner)) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(word), *columns, pa.array(place.astype(np.int32))], ["word", "cid", "size", "parity", "place"])

    return map_arrow(classes.select("cid", "size", "parity", "prefix"), "word bigint, cid bigint, size int, parity bigint, place int", work)


def _second_look(classes: DataFrame, lines: DataFrame, threshold: float) -> tuple[DataFrame, str]:
    """Pairs of the given lines with every line that shares a word of their prefixes."""
    mine, mine_at = materialise_at(_postings(classes.join(lines, "cid", "left_semi")), "mine")
    asked = _bits(mine.select((F.col("word") % _FILTER_BITS).alias("slot")), _FILTER_BITS)
    side = lambda df, n: df.select("word", *[F.col(c).alias(f"{n}_{c}") for c in ("cid", "size", "parity", "place")])
    joined = side(mine, "y").join(side(_postings(classes, asked), "x"), "word")
    total = F.col("x_size") + F.col("y_size")
    needed = F.ceil(threshold / (1 + threshold) * total - 1e-9)
    room = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place"))
    joined = joined.filter(
        (F.col("x_cid") != F.col("y_cid")) & (F.least("x_size", "y_size") >= threshold * F.greatest("x_size", "y_size") - 1e-9)
        & (room >= needed) & (F.bit_count(F.col("x_parity").bitwiseXOR(F.col("y_parity"))) <= total - 2 * needed))
    more = materialise_at(joined.select(F.col("x_cid").alias("a"), F.col("y_cid").alias("b")).distinct(), "more")
    discard(classes.sparkSession, mine_at)
    return more


def kept_lines(keyed: DataFrame, threshold: float = THRESHOLD, most: int = FIRST, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """``doc_id, _h, kept``: numbers of the lines with words that stay, in documents that keep any."""
    spark = keyed.sparkSession
    classes, classes_at = materialise_at(_classes(keyed, rarity_table(keyed), threshold), "classes")
    free_shuffles(spark)
    postings = classes.agg(F.sum(F.octet_length("prefix") / 4)).first()[0] or 0
    parts = max(1, math.ceil(postings / POSTINGS_PER_PART))
    blocks = _dealt(classes.filter(F.octet_length("prefix") > 0), parts)
    found, found_at = materialise_at(whole_groups(blocks, ["part"], "kind int, a bigint, b bigint", lambda t: _candidates(t, threshold, most, at_once), rows=1), "candidates")
    free_shuffles(spark)
    pairs = found.filter("kind = 0")
    sets, sets_at = materialise_at(_sets(keyed, classes, pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()), "sets")
    free_shuffles(spark)
    # most lines that match anything match the first line they are paired with
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    gone = materialise(_later(first, sets, threshold), "gone")
    free_shuffles(spark)
    rest = pairs.select("a", "b").distinct().join(gone, F.col("b") == gone["cid"], "left_anti")
    # most of the rest do not match: they are looked at in a quarter of the bytes before whole sets travel
    rest = materialise(_plausible(rest, sets, threshold), "rest")
    free_shuffles(spark)
    gone = materialise(gone.union(_later(rest, sets, threshold)), "gone")
    discard(spark, sets_at)
    alone = materialise(found.filter("kind = 1").select(F.col("a").alias("cid")).distinct().join(gone, "cid", "left_anti"), "alone")
    # what follows reads written tables alone, so a lost executor needs neither folder again
    discard(spark, found_at)
    free_shuffles(spark)
    if not alone.isEmpty():
        more, more_at = _second_look(classes, alone, threshold)
        free_shuffles(spark)
        sets, sets_at = materialise_at(_sets(keyed, classes, more.select(F.col("a").alias("cid")).union(more.select("b")).distinct()), "sets")
        free_shuffles(spark)
        gone = materialise(gone.union(_later(materialise(_plausible(more, sets, threshold), "rest"), sets, threshold)), "gone")
        discard(spark, sets_at)
        discard(spark, more_at)
        free_shuffles(spark)
    stay = classes.select("cid", "doc_id", "_h", "line").join(gone, "cid", "left_anti")
    kept = materialise(stay.groupBy("doc_id", "_h").agg(F.collect_list("line").alias("kept")), "kept")
    discard(spark, classes_at)
    free_shuffles(spark)
    return kept


def _worded() -> Column:
    numbers = F.transform(F.split("text", "\n"), lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i))
    return F.filter(numbers, lambda i: i.isNotNull())


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", most: int = FIRST, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """``doc_id, n_lines, removed``: lines with words, and the numbers (from 0) of those that go.

    A line goes if its set of words has a Jaccard similarity of `threshold` or more with that of any earlier
    line, in order of document id, text hash and line number, removed or not. Lines without words
    always stay; NULL and empty texts have none. Rows that repeat in id and text are one document and get one
    answer; NULL ids come first. An empty table gives no rows.
    """
    keyed = keyed_documents(docs, id_col, text_col)
    kept = kept_lines(keyed, threshold, most, at_once)
    rows = keyed.select("doc_id", "_h", _worded().alias("worded"))
    joined = rows.join(kept, same_document(rows, kept), "left").select(rows["doc_id"], "worded", "kept")
    removed = F.array_except("worded", F.coalesce("kept", F.array().cast("array<int>")))
    return joined.select("doc_id", F.size("worded").cast("long").alias("n_lines"), F.array_sort(removed).alias("removed"))


def remove_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the text of each row rid of the lines that :func:`repeated_lines` names; NULL stays NULL."""
    kept = kept_lines(keyed_documents(docs, id_col, text_col), threshold)
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("_h").alias("_kept_h"), "kept")
    row = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"))
    joined = row.join(kept, row["row"][id_col].eqNullSafe(kept["_kept_id"]) & (row["_h"] == kept["_kept_h"]), "left")
    numbered = F.transform(F.split(F.col("row")[text_col], "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    stay = F.filter(numbered, lambda s: ~s["x"].rlike(r"[^\x20\x09-\x0D]") | F.coalesce(F.array_contains("kept", s["i"]), F.lit(False)))
    text = F.array_join(F.transform(stay, lambda s: s["x"]), "\n")
    return joined.select(F.col("row").withField(text_col, text).alias("row")).select("row.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without the lines that an earlier line resembles."""
    out = remove_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


@query("op3_line_set_join")
def op3(spark, sf_dir):
    out = repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"))
