"""Preference formatting: the shared turns of two conversations once, then both continuations.

The longest common prefix of turns becomes the prompt; what follows in the chosen and in the
rejected conversation becomes a completion with the character spans that are trained on. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.registry import query, table

#: Fixed marks of the rendered form.
OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(SHUT), t["text"], F.lit(END))), "")


def _spans(turns: Column, trained: str) -> Column:
    """Spans of the trained text: what the role says, with its end mark but not the line break after it."""
    head = lambda t: F.length(t["role"]) + len(OPEN + SHUT)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    folded = F.aggregate(turns, zero, lambda acc, t: F.struct(
        (acc["at"] + head(t) + F.length(t["text"]) + len(END)).alias("at"),
        F.when(t["role"] == trained, F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + head(t)).alias("start"),
            (acc["at"] + head(t) + F.length(t["text"]) + len(END) - 1).alias("end"))))).otherwise(acc["spans"]).alias("spans")))
    return folded["spans"]


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, trained: str = "assistant") -> DataFrame:
    """One row per pair: ``pair_id, n_common, prompt, chosen, chosen_spans, rejected, rejected_spans, complete``.

    `pair` names the pair a turn belongs to, `chosen` tells its side; rows with a NULL pair or
    side belong to none and give nothing. Spans are in code points of their completion, end
    exclusive. Turns are ordered by number, ties by role and text; NULL numbers come first, NULL
    roles and texts are empty; rows that repeat count once. A pair with one side has ``complete``
    false, an empty prompt and an empty other completion. No rows, no pairs.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select(pair.alias("pair_id"), chosen.alias("good"), turn.alias("t")).filter("pair_id IS NOT NULL AND good IS NOT NULL")
    sides = rows.groupBy("pair_id").agg(
        F.array_distinct(F.sort_array(F.collect_list(F.when(F.col("good"), F.col("t"))))).alias("a"),
        F.array_distinct(F.sort_array(F.collect_list(F.when(~F.col("good"), F.col("t"))))).alias("b"))
    shorter = F.least(F.size("a"), F.size("b"))
    differs = F.filter(
        F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (F.get("a", i)["role"] != F.get("b", i)["role"]) | (F.get("a", i)["text"] != F.get("b", i)["text"]))
    common = sides.withColumn("n", F.coalesce(F.get(differs, F.lit(0)), shorter))
    parts = common.withColumns({
        "prompt": F.slice("a", F.lit(1), F.col("n")),
        "left": F.slice("a", F.col("n") + 1, F.size("a")), "right": F.slice("b", F.col("n") + 1, F.size("b"))})
    return parts.select(
        "pair_id", F.col("n").cast("long").alias("n_common"), _render(F.col("prompt")).alias("prompt"),
        _render(F.col("left")).alias("chosen"), _spans(F.col("left"), trained).alias("chosen_spans"),
        _render(F.col("right")).alias("rejected"), _spans(F.col("right"), trained).alias("rejected_spans"),
        ((F.size("a") > 0) & (F.size("b") > 0)).alias("complete"))


_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS good, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, good ORDER BY turn, role, text) AS i FROM turns
), sizes AS (
  SELECT pair_id, count(*) FILTER (good) AS na, count(*) FILTER (NOT good) AS nb FROM numbered GROUP BY pair_id
), differ AS (
  SELECT a.pair_id, min(a.i) - 1 AS n FROM numbered a JOIN numbered b ON a.pair_id = b.pair_id AND a.i = b.i AND a.good AND NOT b.good
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id
), common AS (
  SELECT s.pair_id, na, nb, coalesce(d.n, least(na, nb)) AS n FROM sizes s LEFT JOIN differ d USING (pair_id)
), rendered AS (
  SELECT t.pair_id, t.good, t.i, t.i <= c.n AS shared, t.role,
    '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) AS line, length(t.role) + 5 AS head, length(t.text) AS size
  FROM numbered t JOIN common c USING (pair_id)
), placed AS (
  SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY pair_id, good, shared ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM rendered
)
SELECT c.pair_id, c.n::BIGINT AS n_common,
  coalesce(string_agg(line, '' ORDER BY i) FILTER (shared AND good), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY i) FILTER (NOT shared AND good), '') AS chosen,
  coalesce(string_agg((pos + head) || ':' || (pos + head + size + 7), ',' ORDER BY i) FILTER (NOT shared AND good AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(line, '' ORDER BY i) FILTER (NOT shared AND NOT good), '') AS rejected,
  coalesce(string_agg((pos + head) || ':' || (pos + head + size + 7), ',' ORDER BY i) FILTER (NOT shared AND NOT good AND role = 'assistant'), '') AS rejected_spans,
  c.na > 0 AND c.nb > 0 AS complete
FROM common c JOIN placed p USING (pair_id) GROUP BY c.pair_id, c.n, c.na, c.nb"""


@query("op7_preference_pairs", _SQL)
def op7(spark, sf_dir):
    """Neighbouring conversations are a pair: the even one is taken as chosen, the odd one as rejected."""
    turns = table(spark, sf_dir, "conversations")
    pairs = preference_pairs(turns, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return pairs.withColumns({"chosen_spans": text("chosen_spans"), "rejected_spans": text("rejected_spans")})
