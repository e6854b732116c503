"""Spelling variants: words one edit apart, found by dense tiles of padded code-point matrices.

Two words, the longer of L code points, are one edit apart if their common prefix and suffix together
reach L - 1. Then they share the first half or the second half of L - 1 code points, so words meet in
blocks of equal length class and half. A block that is too large is dealt again by longer shared
parts, which ends where the parts leave one code point open. Blocks become code-point matrices,
aligned left and right, that are compared with themselves column by column. A pair belongs to exactly one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SQL_CRC_TABLE, ascii_lower, group_starts, ranges, sql_crc, whole_groups
from tidemark.llm.registry import query, table
from tidemark.session import materialise

MIN_CHARS, MIN_COUNT, TYPOS = 5, 3, 97
#: Words a block may hold before it is dealt again.
BLOCK_WORDS = 512
#: Long texts are cut into pieces of about this many characters, at the end of a run of letters.
PIECE_CHARS = 1 << 16
#: Cells of one comparison of stacked blocks.
_CELLS = 1 << 21


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the runs of Latin letters of all texts, A-Z lower-cased, that are long and frequent enough.

    A run loses one code point where `TYPOS` divides the CRC-32 of its document's id and itself.
    NULL texts have no runs; a NULL id counts as the empty string.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    pieces = F.when(F.length("text") > PIECE_CHARS, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE_CHARS}}}[a-zÀ-ÿ]*"), F.lit(0))).otherwise(F.array("text"))
    # explode() would add a filter below that repeats its whole input expression; the outer form does not
    cut = base.select("id", F.explode_outer(pieces).alias("piece"))
    runs = cut.select("id", F.explode_outer(F.regexp_extract_all("piece", F.lit(r"[a-zÀ-ÿ]+"), F.lit(0))).alias("run")).filter(F.length("run") >= MIN_CHARS)
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % TYPOS == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= MIN_CHARS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _key() -> Column:
    return F.concat_ws("|", "size", "i", "j", "cap", F.substring("word", F.lit(1), F.col("i")),
                       F.when(F.col("j") > 0, F.substring("word", F.length("word") - F.col("j") + 1, F.col("j"))).otherwise(""))


def _deal(rows: DataFrame) -> DataFrame:
    """Each row of ``word, n, size, i, j, cap`` into two: a longer prefix, or a longer suffix and a prefix that stays shorter."""
    rest = F.col("size") - 1 - F.col("i") - F.col("j")
    half = F.floor((rest + 1) / 2).cast("int")
    longer = F.array(
        F.struct((F.col("i") + half).alias("i"), F.col("j").alias("j"), F.col("cap").alias("cap")),
        F.struct(F.col("i").alias("i"), (F.col("j") + rest - half + 1).alias("j"), F.least(F.col("cap"), F.col("i") + half).alias("cap")))
    dealt = rows.select("word", "n", "size", F.explode(longer).alias("b")).select("word", "n", "size", "b.*")
    return dealt.withColumn("key", _key())


def _codes(words: list[str], wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, aligned left and right, and the lengths; 0 pads."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row, at = np.repeat(np.arange(len(words)), sizes), ranges(np.zeros(len(words), np.int64), sizes)
    left, right = np.zeros((len(words), wide), np.uint32), np.zeros((len(words), wide), np.uint32)
    left[row, at] = flat
    right[row, np.repeat(sizes, sizes) - 1 - at] = flat
    return left, right, sizes


def _shared(codes: np.ndarray) -> np.ndarray:
    """Code points that each two rows of the stacked blocks have in common before the first that differs."""
    blocks, words, wide = codes.shape
    alive = np.broadcast_to(~np.eye(words, dtype=bool), (blocks, words, words)).copy()
    shared = np.zeros((blocks, words, words), np.int32)
    for at in range(wide):
        column = np.ascontiguousarray(codes[:, :, at])
        alive &= column[:, :, None] == column[:, None, :]
        if not alive.any():
            break
        shared += alive
    return shared


def _compare(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """Whole blocks: for each word with a near word in its block, how many and the most frequent of them."""
    words = part.column("word").to_pylist()
    n, size, cap, i, j = (part.column(c).to_numpy().astype(np.int64) for c in ("n", "size", "cap", "i", "j"))
    keys = part.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
    starts = group_starts(keys)
    counts = np.diff(np.r_[starts, len(keys)])
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    order = np.array(order)
    near_count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    # blocks of equally many words and like length are stacked, so that small ones share a comparison
    classes = counts * 4096 + np.minimum(size[starts], 4095)
    for kind in np.unique(classes[counts > 1]):
        of = starts[classes == kind]
        m = int(kind // 4096)
        step = max(1, _CELLS // (m * m))
        for a in range(0, len(of), step):
            first = of[a : a + step]
            rows = first[:, None] + np.arange(m)
            wide = int(size[first].max())
            left, right, sizes = _codes([words[k] for k in rows.ravel()], wide)
            shape = (*rows.shape, wide)
            prefix, suffix = _shared(left.reshape(shape)), _shared(right.reshape(shape))
            longer = size[first][:, None, None]
            sizes = sizes.reshape(rows.shape)
            near = (prefix + suffix >= longer - 1) & (prefix < cap[first][:, None, None])
            near &= np.maximum(sizes[:, :, None], sizes[:, None, :]) == longer
            near &= ~np.eye(m, dtype=bool)
            near_count[rows] = near.sum(2)
            best[rows] = np.where(near, rank[rows][:, None, :], len(words)).min(2)
    hit = np.flatnonzero(near_count)
    if len(hit):
        top = order[best[hit]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[k] for k in hit], pa.string()), pa.array(near_count[hit]), pa.array(n[top]), pa.array([words[k] for k in top], pa.string())],
            ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of the words of ``word, n`` that have a word one edit away."""
    lengths = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size")
    whole = words.select("word", "n", lengths).withColumns({"i": F.lit(0), "j": F.lit(0), "cap": F.col("size") + 1})
    rows, cold = _deal(whole), []
    while True:
        open_ = F.col("size") - 1 - F.col("i") - F.col("j") > 0
        crowded = rows.filter(open_).groupBy("key").count().filter(F.col("count") > BLOCK_WORDS).select("key")
        crowded = materialise(crowded, "crowded")
        if crowded.isEmpty():
            cold.append(rows)
            break
        cold.append(rows.join(crowded, "key", "left_anti").select(rows.columns))
        rows = materialise(_deal(rows.join(crowded, "key", "left_semi")), "blocks")
    dealt = cold[0]
    for more in cold[1:]:
        dealt = dealt.union(more)
    found = whole_groups(dealt, ["key"], "word string, n_near bigint, best_n bigint, best string", _compare)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), "b.best")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n``: frequent words of all texts and the spelling each stands for.

    ``form``: the most frequent word one inserted, deleted or replaced code point away (ties: first
    in code-point order), if at least twice as frequent; else NULL, as ``form_n``. ``root``: the end
    of the chain of forms, the word itself without one. ``n_near``: words one edit away. NULL and
    empty texts add nothing, rows that repeat count again; no frequent words, no rows.
    """
    words = materialise(vocabulary(docs, id_col, text_col), "vocabulary")
    near = words.join(near_words(words), "word", "left")
    strong = F.col("best_n") >= 2 * F.col("n")
    forms = materialise(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")), "forms")
    chain = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:  # a form is twice as frequent, so the chains are short and have an end; each round doubles the steps
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = chain.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        chain = materialise(step, "roots")
        if chain.filter("moved").isEmpty():
            break
    return forms.join(chain.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_BYTES = "flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))"
_SQL = rf"""
WITH RECURSIVE {SQL_CRC_TABLE}, runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {MIN_CHARS} GROUP BY ALL
), hashed AS (
  SELECT run, c, {sql_crc(_BYTES)} AS h FROM runs, crc
), vocabulary AS (
  SELECT word, sum(c)::BIGINT AS n, length(word) AS size FROM (
    SELECT CASE WHEN h % {TYPOS} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(c) >= {MIN_COUNT}
), dropped AS (
  SELECT word, size, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, size, unnest(range(size)) AS i FROM vocabulary)
), near AS (
  SELECT a.word, b.word AS other FROM dropped a JOIN dropped b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, v.word FROM dropped a JOIN vocabulary v ON a.rest = v.word
  UNION SELECT v.word, a.word FROM dropped a JOIN vocabulary v ON a.rest = v.word
), ranked AS (
  SELECT e.word, e.other, o.n, row_number() OVER (PARTITION BY e.word ORDER BY o.n DESC, e.other) AS place, count(*) OVER (PARTITION BY e.word) AS n_near
  FROM near e JOIN vocabulary o ON e.other = o.word
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 2 * v.n THEN other END AS form, CASE WHEN r.n >= 2 * v.n THEN r.n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON v.word = r.word AND place = 1
), chain AS (
  SELECT word, word AS root FROM forms
  UNION SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.root FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN roots USING (word)"""


@query("op13_spelling_variants", _SQL)
def op13(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))
