"""Benchmark decontamination by winnowing: fingerprints of both sides meet, then hits are extended to whole shared spans.

A span counts from `window` words on (an item with fewer words counts as one span of its own
length). For spans of L words, k-grams of about half that length are hashed and the smallest hash of
every L - k + 1 neighbours is a fingerprint. Both sides choose the same one inside an equal span, so
no shared span is missed; each hit is then extended over the spans that contain it and compared word
by word with the benchmark. DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, fits_broadcast
from tidemark.llm.registry import query, table
from tidemark.session import materialise

WINDOW = 10
#: Long texts are cut into pieces of about this many characters, at word ends, before they become word arrays.
PIECE_CHARS = 1 << 16
#: Fingerprints or windows of the benchmark are broadcast up to this many bytes, else joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEY = ["doc_id", "_h"]


def _plain(text: Column) -> Column:
    """The words of a text, one space between them."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), _GAPS, " "))


def _count(plain: Column) -> Column:
    return F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1)


def _gram(size):
    """Words to a k-gram of spans of `size` words: k-grams and their windows are about half as long as the span."""
    return (size + 1) // 2 if isinstance(size, int) else F.floor((size + 1) / 2).cast("int")


def _mark(size: int, words: Column, i: Column) -> Column:
    """Hash of the k-gram at place `i`, from 0; single reads, since a slice inside a lambda walks the whole array."""
    return F.xxhash64(F.lit(size), *[F.get(words, i + j) for j in range(_gram(size))])


def _fingerprints(size: int) -> Column:
    """``mark, pos, size`` of the k-grams of ``words`` that are smallest in a window of k-grams; `size` words are always hit."""
    near = size - _gram(size) + 1
    least = F.least if near > 1 else lambda only: only
    most = F.greatest if near > 1 else lambda only: only
    marks = F.transform(F.sequence(F.lit(0), F.size("words") - _gram(size)), lambda i: _mark(size, F.col("words"), i))
    lows = lambda m: F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda j: least(*[F.get(m, j + d) for d in range(near)]))
    # bound variables keep hashes and minima from being computed once per use
    chosen = F.transform(F.array(marks), lambda m: F.transform(F.array(lows(m)), lambda low: F.filter(
        F.transform(m, lambda mark, i: F.when(mark == most(*[F.get(low, i - d) for d in range(near)]), F.struct(mark.alias("mark"), i.alias("pos"), F.lit(size).alias("size")))),
        lambda x: x.isNotNull())))
    empty = F.array().cast("array<struct<mark:bigint,pos:int,size:int>>")
    return F.when(F.size("words") >= size, F.flatten(F.flatten(chosen))).otherwise(empty)


def _pieces(docs: DataFrame, overlap: int) -> DataFrame:
    """``doc_id, _h, base, words``: whole texts in pieces that repeat the next `overlap` words; ``base`` words precede."""
    long = F.length("plain") > PIECE_CHARS
    cut = docs.withColumn("cut", F.when(long, F.regexp_extract_all("plain", F.lit(rf"(?s).{{1,{PIECE_CHARS}}}[^ ]*"), F.lit(0))))
    head = cut.withColumns({
        "counts": F.transform("cut", lambda p: _count(F.trim(p))),
        "heads": F.transform("cut", lambda p: F.regexp_extract(p, rf"^(?: [^ ]+){{0,{overlap}}}", 0))})
    follow = lambda i: F.regexp_extract(F.array_join(F.slice("heads", i + 2, max(overlap, 1)), ""), rf"^(?: [^ ]+){{0,{overlap}}}", 0)
    parts = F.when(F.col("plain") == "", None).when(long, F.transform("cut", lambda p, i: F.struct(
        F.aggregate(F.slice("counts", F.lit(1), i), F.lit(0), lambda a, n: a + n).alias("base"), F.concat(F.trim(p), follow(i)).alias("text")
    ))).otherwise(F.array(F.struct(F.lit(0).alias("base"), F.col("plain").alias("text"))))
    # explode() would add a filter below that repeats its whole input expression; the outer form does not
    return head.select(*_KEY, F.explode_outer(parts).alias("p")).select(*_KEY, "p.base", F.split("p.text", " ").alias("words"))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows ``span, size, mark, cid`` and ``cid, item``: which items hold the windows of a class.

    Windows held by the same items are one class (count and two sums of hashes agree), so a
    template that is in many items meets a document once and not once per window.
    """
    plain = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), _plain(F.col(text_col)).alias("plain")).filter("plain <> ''")
    words = plain.select("item", F.split("plain", " ").alias("words")).withColumn("size", F.least(F.size("words"), F.lit(window)))
    at = words.select("item", "size", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("i"))
    at = at.select("item", "size", F.slice("words", F.col("i"), F.col("size")).alias("words"))
    marks = [F.when(F.col("size") == n, F.array_min(F.array(*[_mark(n, F.col("words"), F.lit(i)) for i in range(n - _gram(n) + 1)]))) for n in range(1, window + 1)]
    held = materialise(at.select("item", "size", F.array_join("words", " ").alias("span"), F.coalesce(*marks).alias("mark")).distinct(), "windows")
    total = lambda c: F.sum(c.cast("decimal(38,0)")).cast("string")
    spans = held.groupBy("span", "size", "mark").agg(F.md5(F.concat_ws(":", F.count("*").cast("string"),
        total(F.xxhash64("item")), total(F.xxhash64(F.lit("second"), "item")))).alias("cid"))
    spans = materialise(spans, "spans")
    one = spans.groupBy("cid").agg(F.min("span").alias("span"))
    return spans, materialise(one.join(held, "span").select("cid", "item"), "holders")


def _context(rows: DataFrame) -> DataFrame:
    """The words around a fingerprint that a span with it can reach, and their first position."""
    first = F.greatest(F.col("pos") - F.col("size") + _gram(F.col("size")), F.lit(0))
    return rows.select(*_KEY, "mark", "size", (F.col("base") + first).alias("first"), F.least(F.col("pos") - first + 1, F.size("words") - F.col("size") - first + 1).alias("starts"),
                       F.slice("words", first + 1, F.col("pos") - first + F.col("size")).alias("words"))


def shared_windows(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, _h, start, size, cid``: every place of a document (words from `start`) that equals a benchmark window."""
    sizes = sorted(r[0] for r in spans.select("size").distinct().collect()) or [WINDOW]
    marks = materialise(spans.select("mark").distinct(), "marks")
    small = fits_broadcast(marks, 16, BROADCAST_BYTES)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), _plain(F.col(text_col)).alias("plain"))
    found = _pieces(plain, sizes[-1] - 1).withColumn("found", F.concat(*map(_fingerprints, sizes)))
    rows = found.select(*_KEY, "base", "words", F.explode_outer("found").alias("f")).select(*_KEY, "base", "words", "f.*")
    # word arrays never cross a shuffle: a large benchmark meets the few words around each fingerprint
    hits = _context(rows.join(F.broadcast(marks), "mark")) if small else _context(rows).join(marks, "mark")
    near = hits.filter("starts > 0").select(*_KEY, "size", "first", "words", F.explode(F.sequence(F.lit(0), F.col("starts") - 1)).alias("i"))
    named = near.select(*_KEY, (F.col("first") + F.col("i")).alias("start"), F.array_join(F.slice("words", F.col("i") + 1, F.col("size")), " ").alias("span"))
    known = F.broadcast(spans.drop("mark")) if fits_broadcast(spans, F.octet_length("span") + 64, BROADCAST_BYTES) else spans.drop("mark")
    return named.join(known, "span").select(*_KEY, "start", "size", "cid").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of `docs`.

    Words are runs of digits, letters a-z (A-Z lower-cased) and anything beyond ASCII. A word is
    hit if it lies in `window` words in a row that an item has too; an item with fewer words is
    found as a whole, one without words never. NULL and empty texts have no words. Rows that
    repeat in id and text get the same result each; rows that share only an id are kept apart;
    a NULL item id counts as the empty string; items that share an id are one item. Empty tables
    give no rows, or rows without hits. Columns beside the named ones are not read.
    """
    spans, holders = benchmark_windows(items, item_col, item_text, window)
    hits = materialise(shared_windows(docs, spans, id_col, text_col), "hits")
    end = F.col("start") + F.col("size")
    before = F.max(end).over(Window.partitionBy(*_KEY).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    fresh = hits.select(*_KEY, F.greatest(end - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))), F.lit(0)).alias("n"))
    covered = fresh.groupBy(*_KEY).agg(F.sum("n").alias("n_hit"))
    held = F.broadcast(holders) if fits_broadcast(holders, F.octet_length("item") + 64, BROADCAST_BYTES) else holders
    names = hits.select(*_KEY, "cid").distinct().join(held, "cid").select(*_KEY, "item").distinct()
    listed = names.groupBy(*_KEY).agg(F.sort_array(F.collect_list("item")).alias("items"))
    at = lambda right: F.col("d.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col("d._h") == F.col(f"{right}._h"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), _count(_plain(F.col(text_col))).cast("long").alias("n_words"))
    joined = base.alias("d").join(covered.alias("c"), at("c"), "left").join(listed.alias("i"), at("i"), "left")
    return joined.select(
        "d.doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark
), spans AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM spans
), places AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs JOIN sizes ON len(w) >= n)
), hits AS (
  SELECT p.rid, p.n, p.i, s.item FROM places p JOIN spans s ON p.span = s.span AND p.n = s.n
), covered AS (
  SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid
), listed AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)"""


@query("op11_winnowing", _SQL)
def op11(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
