"""Helpers the text operators share: document access, Arrow map stages, token hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches of whole texts: small enough that two Python workers fit beside one JVM.
BATCH_ROWS, BATCH_BYTES = 1000, 3 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def settle(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by bytes and rows, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


#: Text in which only ASCII can change under lower(): Latin-1 without its capitals, and scripts or signs without case.
_CASELESS = r"[^\x00-\xBF\xDF-\xFF\u0590-\u08FF\u2000-\u209F\u3000-\u9FFF\uAC00-\uD7A3\x{1F300}-\x{1FAFF}]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else, with the fast built-in where no other letter could change."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.rlike(_CASELESS), slow).otherwise(F.lower(text))


def fits_broadcast(df: DataFrame, width: Column | int, limit: int) -> bool:
    """Whether the rows of a table, `width` bytes each, stay within `limit` bytes in all; one small job."""
    total = df.agg(F.sum(width if isinstance(width, Column) else F.lit(width))).first()[0]
    return (total or 0) <= limit


#: CRC-32 in DuckDB, which has no such function: the table of its 256 steps, and the fold of a list of bytes.
SQL_CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda v: list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps
)"""


def sql_crc(codes: str) -> str:
    """CRC-32 of the list of byte values `codes`; the query must join ``crc``."""
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda a, b: xor(a >> 8, steps[xor(a & 255, b) + 1])), 4294967295)"


def give_back() -> None:
    """Return freed memory to the system: a Python worker idles, or serves the next stage, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, schema: str | T.StructType, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Apply a function of one Arrow batch to every batch of every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)
        give_back()

    return df.mapInArrow(run, schema)


def keyed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, _h, text``: the id as it is, a hash of the text, the text with NULL as empty.

    Id and hash together name a document, so rows that share an id but not a text are
    kept apart; rows that repeat in both are one document and get the same decisions.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_h"), text.alias("text"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on id and text hash; a NULL id equals a NULL id."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["_h"] == right["_h"])


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows, without copying."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1 << 16)
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS[:n]


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of byte codes weighted by descending powers: the hash of any slice in two reads."""
    # h[i] = sum of code(b[j]) * base**j for j < i, modulo 2**64; the base is odd, so it has an inverse
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers(len(data)), out=sums[1:])
    return sums


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_INVERSES = np.ones(1, np.uint64)


def inverses(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        size = max(n, 2 * len(_INVERSES), 1 << 16)
        steps = np.full(size, _INVERSE, np.uint64)
        steps[0] = 1
        _INVERSES = np.multiply.accumulate(steps)
    return _INVERSES


def slice_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices ``[start, end)``, equal for equal bytes wherever they lie."""
    raw = (sums[end] - sums[start]) * inverses(int(start.max()) + 1 if len(start) else 1)[start]
    return mix64(raw ^ (end - start).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are not white space; rows never share a run."""
    inside = ~_SPACES[data] if len(data) else np.zeros(0, bool)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[inside[cuts] & inside[cuts - 1]]
    begins[both] = True
    ends[both - 1] = True
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``range(start, start + count)``."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts.astype(np.int64) - before, counts)


def whole_groups(df: DataFrame, keys: list[str], schema: str | T.StructType, work: Callable[[pa.Table], Iterator[pa.RecordBatch] | list], order: list[str] = (), rows: int = 20_000, partitions: int | None = None) -> DataFrame:
    """Bring equal keys together and hand `work` tables that hold only whole groups, in key order.

    Many small groups share one call, so the cost per group is that of numpy, not of a
    task. A group is held by one worker: callers split groups whose size is not bounded.
    """
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        n_held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n_held += batch.num_rows
            if n_held < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = _last_group(table, keys)
            if cut:
                yield from work(table.slice(0, cut))
            held, n_held = table.slice(cut).to_batches(), 0
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())
        del held
        give_back()

    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _last_group(table: pa.Table, keys: list[str]) -> int:
    """Where the last group of a sorted table begins."""
    last = table.num_rows - 1
    same = np.ones(table.num_rows, bool)
    for key in keys:
        column = table.column(key).combine_chunks()
        value = column[last]
        if value.is_valid:
            same &= pa.compute.fill_null(pa.compute.equal(column, value), False).to_numpy(zero_copy_only=False)
        else:
            same &= pa.compute.is_null(column).to_numpy(zero_copy_only=False)
    return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """First row of each run of equal keys in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)
