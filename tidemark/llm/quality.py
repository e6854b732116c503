"""Quality rules: a threshold table compiled into one projection.

Every rule is a ratio of two measures of a text with a lower and an upper bound. The table
becomes one Spark projection of built-in expressions; no user function runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.registry import query, table

#: Words that prose of the four languages of the corpus cannot avoid.
STOP_WORDS = sorted({
    "the", "of", "and", "to", "in", "is", "that", "with", "for", "by", "on", "was", "are", "be", "it", "as", "at",
    "le", "la", "les", "des", "de", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "par", "est",
    "der", "die", "das", "und", "ist", "den", "von", "zu", "nicht", "sich", "auf", "ein", "eine", "für", "im",
    "el", "los", "las", "y", "del", "se", "su", "con", "para", "por", "no", "es", "al",
})

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a zero denominator makes the ratio zero."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_count", "n_words", "one", low=20, high=1_000_000),
    Rule("mean_word_length", "word_chars", "n_words", low=2.0, high=16.0),
    Rule("symbols_to_words", "n_symbols", "n_words", high=0.35),
    Rule("exclamations_to_words", "n_exclaims", "n_words", high=0.35),
    Rule("stop_words_to_words", "n_stop_words", "n_words", low=0.02),
    Rule("alphabetic_words", "n_alpha_words", "n_words", low=0.6),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
)


def _windows(size: int) -> Column:
    """Hashes of the windows of `size` words, in order."""
    return F.when(
        F.size("words") >= size,
        F.transform(F.sequence(F.lit(1), F.size("words") - (size - 1)), lambda i: F.xxhash64(F.slice("words", i, size))),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeats(size: int) -> Column:
    """The windows with their places, sorted, for texts in which two windows have one hash."""
    window = F.transform(
        F.sequence(F.lit(1), F.size("words") - (size - 1)),
        lambda i: F.struct(F.array_join(F.slice("words", i, size), " ").alias("w"), i.alias("i")),
    )
    return F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(window))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """One row per row of `docs`: its id and the counted measures of its whole text.

    NULL and empty texts have no words and zero counts; other columns of `docs` are not read,
    so their names cannot clash. Repeated rows give repeated rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    split = base.withColumns({
        "words": F.filter(F.split("text", _SPACE), lambda w: w != ""),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    hashed = split.withColumn("hashes", _windows(window))
    sorted_ = hashed.withColumn("sorted", _repeats(window))
    repeated = sorted_.withColumn("places", F.when(F.col("sorted").isNotNull(), F.array_sort(F.filter(
        F.transform("sorted", lambda x, j: F.when(
            ((j > 0) & (F.get("sorted", j - 1)["w"] == x["w"]))
            | ((j < F.size("sorted") - 1) & (F.get("sorted", j + 1)["w"] == x["w"])), x["i"])),
        lambda p: p.isNotNull()))))
    covered = F.when(F.size("places") > 0, F.aggregate(
        F.transform("places", lambda p, j: F.least(F.lit(window), F.coalesce(F.get("places", j + 1) - p, F.lit(window)))),
        F.lit(0), lambda total, n: total + n)).otherwise(0)
    bare = F.regexp_replace("text", _SPACE, "")
    lower = F.array(*map(F.lit, STOP_WORDS))
    return repeated.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_exclaims"),
        F.size(F.filter("words", lambda w: F.array_contains(lower, w))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the measures."""
    passed = F.lit(True)
    for rule in rules:
        over = F.lit(1) if rule.denominator == "one" else F.col(rule.denominator)
        ratio = F.when(over > 0, F.col(rule.numerator) / over).otherwise(0.0)
        if rule.low is not None:
            passed = passed & (ratio >= rule.low)
        if rule.high is not None:
            passed = passed & (ratio <= rule.high)
    return passed


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every row of `docs`, in one pass without a shuffle.

    ``base_failed``: under 20 words, or over 30 % of the words lie in repeated 8-word windows.
    ``kept``: not base_failed and every rule of the table holds. An empty table gives no rows.
    """
    counted = measures(docs, id_col, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their columns as they came."""
    judged = quality_rules(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), id_col="row", text_col="text")
    # a filter would be pushed below the projections and repeat their work; a generator stays above them
    return judged.select(F.explode(F.when(F.col("kept"), F.array("doc_id")).otherwise(F.slice(F.array("doc_id"), 1, 0))).alias("row")).select("row.*")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _sql() -> str:
    tests = []
    for rule in RULES:
        over = "1" if rule.denominator == "one" else rule.denominator
        ratio = f"(CASE WHEN {over} > 0 THEN {rule.numerator}::DOUBLE / {over} ELSE 0 END)"
        if rule.low is not None:
            tests.append(f"{ratio} >= {rule.low}")
        if rule.high is not None:
            tests.append(f"{ratio} <= {rule.high}")
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base
), windows AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM split)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest(range(8)) AS d) GROUP BY rid
), counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines,
    (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaims,
    len(list_filter(words, lambda w: w IN ({_STOPS})))::BIGINT AS n_stop_words,
    len(list_filter(words, lambda w: regexp_matches(w, '\p{{L}}')))::BIGINT AS n_alpha_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines
  FROM split LEFT JOIN covered USING (rid)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND {' AND '.join(tests)} AS kept FROM judged"""


@query("op2_quality_rules", _sql())
def op2(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))
