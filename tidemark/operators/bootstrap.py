"""Paired bootstrap of a difference in average precision, at any number of rows.

Every row draws a Poisson(1) weight per resample from a hash of (row, resample), so
both models weigh the same rows, nothing is exploded and a retried task redraws the
same numbers. Scores are cut into ranges; a range sums its weights (pass one), the
sums of the ranges above become its offset, and pass two adds its share of the
precision sum. A score held by very many rows is summed over salts instead.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import STEPS_PER_RANGE, score_grid, with_range
from tidemark.session import small_table

DEFAULT_RESAMPLES = 1_000
DEFAULT_SEED = 42
# Fixed values of the draw: a prime modulus, three multipliers, a stride per resample.
MODULUS = 2_147_483_647
MULTIPLIERS = (48_271, 69_621, 16_807)
STRIDE = 1_640_531_527
SHIFTS = (15, 13)
# Cumulative Poisson(1) probabilities scaled to the modulus.
POISSON_STEPS = [
    int(MODULUS * c) for c in np.cumsum([np.exp(-1.0) / f for f in
                                         (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])
]
BLOCK_CELLS = 1_000_000
#: Cells that are drawn together: their intermediate numbers stay in a core's cache.
DRAWN_CELLS = 32_768


def _times(x: np.ndarray, multiplier: int, spare: np.ndarray) -> None:
    """``x`` becomes ``x * multiplier % MODULUS``; a modulus of 2^31 - 1 folds the high bits onto the low ones."""
    x *= np.uint64(multiplier)
    np.right_shift(x, np.uint64(31), out=spare)
    x &= np.uint64(MODULUS)
    x += spare
    # what is below the modulus wraps around to a huge number and stays
    np.subtract(x, np.uint64(MODULUS), out=spare)
    np.minimum(x, spare, out=x)


def draw_weights(ids: np.ndarray, resamples: np.ndarray, seed: int) -> np.ndarray:
    """Weights of shape (rows, resamples)."""
    start = (((ids % MODULUS) * MULTIPLIERS[0] + seed * MULTIPLIERS[1] + 1) % MODULUS).astype(np.uint64)
    strides = ((resamples * STRIDE) % MODULUS).astype(np.uint64)
    weights = np.empty((len(start), len(strides)), dtype=np.uint8)
    step = max(1, DRAWN_CELLS // max(1, len(strides)))
    numbers = np.empty((2, step, len(strides)), dtype=np.uint64)
    for a in range(0, len(start), step):
        x, spare = numbers[:, : min(step, len(start) - a)]
        np.bitwise_xor(start[a : a + step, None], strides[None, :], out=x)
        for multiplier, shift in zip(MULTIPLIERS, (*SHIFTS, None)):
            _times(x, multiplier, spare)
            if shift is not None:
                np.right_shift(x, np.uint64(shift), out=spare)
                x ^= spare
        small, drawn = x.astype(np.int32), weights[a : a + step]
        drawn[...] = small >= np.int32(POISSON_STEPS[0])
        for bound in POISSON_STEPS[1:]:
            drawn += (small >= np.int32(bound)).view(np.uint8)
    return weights


def _blocks(n: int, width: int):
    """Row blocks of bounded size."""
    step = max(1, BLOCK_CELLS // max(1, width))
    return [(a, min(n, a + step)) for a in range(0, n, step)]


def _sums(resamples: int, seed: int):
    """Pass one: weight totals of positives and negatives per group."""
    draws = np.arange(resamples, dtype=np.int64)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pos, neg = np.zeros(resamples), np.zeros(resamples)
        ids, y = rows["id"].to_numpy(np.int64), rows["y"].to_numpy() == 1
        for a, b in _blocks(len(rows), resamples):
            w = draw_weights(ids[a:b], draws, seed)
            hits = w[y[a:b]].sum(axis=0)
            pos += hits
            neg += w.sum(axis=0) - hits
        return pd.DataFrame([{"model": key[0], "range": key[1], "hot": key[2], "pos": pos, "neg": neg}])

    return run


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    first = rows.iloc[0]
    return pd.DataFrame([{
        "model": first["model"], "range": first["range"], "hot": first["hot"],
        "pos": np.sum(np.stack(rows["pos"].to_list()), axis=0),
        "neg": np.sum(np.stack(rows["neg"].to_list()), axis=0),
    }])


def _fold_chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Totals of a block of ranges, under the number of the block."""
    out = _fold(rows)
    out["range"], out["hot"] = float(key[1]), False
    return out


def _offsets(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals above each group of the given ranges of one model; in a range the hot score lies below the rest."""
    rows = rows.sort_values(["range", "hot"], ascending=[False, True]).reset_index(drop=True)
    pos, neg = np.stack(rows["pos"].to_list()), np.stack(rows["neg"].to_list())
    above_pos, above_neg = np.cumsum(pos, axis=0) - pos, np.cumsum(neg, axis=0) - neg
    return pd.DataFrame({
        "model": rows["model"], "range": rows["range"], "hot": rows["hot"],
        "pos": list(pos), "neg": list(neg), "above_pos": list(above_pos), "above_neg": list(above_neg),
    })


def _precision(tp: np.ndarray, fp: np.ndarray) -> np.ndarray:
    total = tp + fp
    return np.divide(tp, total, out=np.zeros_like(tp, dtype=float), where=total > 0)


def _parts(resamples: int, seed: int):
    """Pass two: precision sums of one cold group on top of its offset."""
    draws = np.arange(resamples, dtype=np.int64)

    def run(key: tuple, rows: pd.DataFrame, offset: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or offset.empty:
            return pd.DataFrame({"model": [], "part": []})
        rows = rows.sort_values("score", ascending=False)
        score = rows["score"].to_numpy()
        ids, y = rows["id"].to_numpy(np.int64), rows["y"].to_numpy() == 1
        # Runs of equal scores; neighbouring runs without a positive only add to the false ones and count as one.
        starts = np.append(0, np.flatnonzero(np.diff(score)) + 1)
        holds = np.logical_or.reduceat(y, starts)
        kept = holds | np.append(True, holds[:-1])
        starts, holds = starts[kept], holds[kept]
        tp = np.array(offset["above_pos"].iloc[0], dtype=float)
        fp = np.array(offset["above_neg"].iloc[0], dtype=float)
        part, total = np.zeros(resamples), np.empty(resamples)
        blocks = iter(_blocks(len(rows), resamples))
        a = b = 0
        for at, end, positive in zip(starts.tolist(), [*starts[1:].tolist(), len(score)], holds.tolist()):
            pos = np.zeros(resamples)
            # a run may cross blocks: its precision waits until it ends
            while at < end:
                if at >= b:
                    a, b = next(blocks)
                    w = draw_weights(ids[a:b], draws, seed)
                until = min(end, b)
                mine = w[at - a : until - a]
                if not positive:
                    fp += mine.sum(axis=0) if len(mine) > 1 else mine[0]
                elif len(mine) == 1 and y[at]:
                    pos += mine[0]
                else:
                    hit = y[at:until]
                    pos += mine[hit].sum(axis=0)
                    fp += mine[~hit].sum(axis=0)
                at = until
            if positive:
                tp += pos
                # weights are whole numbers, so a total below one is zero
                np.maximum(np.add(tp, fp, out=total), 1.0, out=total)
                np.divide(tp, total, out=total)
                total *= pos
                part += total
        return pd.DataFrame([{"model": key[0], "part": part}])

    return run


def _hot_part(rows: pd.DataFrame) -> pd.DataFrame:
    pos, neg = np.stack(rows["pos"].to_list()), np.stack(rows["neg"].to_list())
    tp, fp = pos + np.stack(rows["above_pos"].to_list()), neg + np.stack(rows["above_neg"].to_list())
    return pd.DataFrame([{"model": rows["model"].iloc[0], "part": (pos * _precision(tp, fp)).sum(axis=0)}])


def _fold_parts(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"model": rows["model"].iloc[0], **{
        c: np.sum(np.stack(rows[c].to_list()), axis=0) for c in ("part", "pos", "neg")}}])


def _average_precision(rows: pd.DataFrame) -> pd.DataFrame:
    """(model, b, ap) of one model from its parts and its totals; one-class resamples give NULL."""
    part = np.sum(np.stack(rows["part"].to_list()), axis=0)
    pos, neg = (np.sum(np.stack(rows[c].to_list()), axis=0) for c in ("pos", "neg"))
    usable = (pos > 0) & (neg > 0)
    ap = np.divide(part, pos, out=np.full(len(pos), np.nan), where=usable)
    return pd.DataFrame({"model": rows["model"].iloc[0], "b": np.arange(len(pos)), "ap": ap})


def score_plan(long: DataFrame, rows_per_range: int) -> tuple[list[float], dict[float, int]]:
    """Range cuts, and the scores so frequent that they fill a range, with their number of salts."""
    _, grid = score_grid(long, F.col("score"), rows_per_range)
    seen: dict[float, int] = {}
    for value in grid:
        seen[value] = seen.get(value, 0) + 1
    # salts follow the weight: a hot score of w ranges is summed by about 2w tasks
    hot = {v: -(-2 * times // STEPS_PER_RANGE) for v, times in seen.items() if times > STEPS_PER_RANGE}
    return sorted(set(grid[STEPS_PER_RANGE - 1:: STEPS_PER_RANGE]) | set(hot)), hot


def bootstrap_average_precision(
    df: DataFrame, resamples: int = DEFAULT_RESAMPLES, seed: int = DEFAULT_SEED,
    rows_per_range: int = 50_000, models: tuple[str, str] = ("p_champion", "p_challenger"),
) -> DataFrame:
    """(model, b, ap) for both score columns of ``df`` (id, y, scores)."""
    vector = "array<double>"
    long = df.where(F.col("y").isNotNull()).select(
        F.col("id").cast("bigint").alias("id"), F.col("y").cast("int").alias("y"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("score")) for m in models])),
    ).where(F.col("score").isNotNull())
    cuts, hot = score_plan(long, rows_per_range)
    # at most one hot score per range of rows, so the table of salts is as small as the list of cuts
    salts = small_table(df.sparkSession, list(hot.items()), "score double, salts bigint")
    ranged = with_range(long, "score", cuts, "range").join(F.broadcast(salts), "score", "left").withColumns({
        "hot": F.col("salts").isNotNull(),
        "salt": F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0))})
    sums = ranged.groupBy("model", "range", "hot", "salt").applyInPandas(
        _sums(resamples, seed), f"model string, range double, hot boolean, pos {vector}, neg {vector}"
    )
    if hot:
        sums = sums.groupBy("model", "range", "hot").applyInPandas(
            _fold, f"model string, range double, hot boolean, pos {vector}, neg {vector}"
        )
    # Two levels: about sqrt(ranges) blocks of about sqrt(ranges) ranges, so no task sees every range.
    ranges = len(cuts) + 1
    chunk = F.floor(F.col("range") / float(max(1, math.isqrt(ranges))))
    sums = sums.withColumn("chunk", chunk)
    shape = f"model string, range double, hot boolean, pos {vector}, neg {vector}, above_pos {vector}, above_neg {vector}"
    totals = sums.groupBy("model", "chunk").applyInPandas(
        _fold_chunk, f"model string, range double, hot boolean, pos {vector}, neg {vector}")
    bases = totals.groupBy("model").applyInPandas(_offsets, shape).select(
        "model", F.col("range").cast("bigint").alias("chunk"), F.col("above_pos").alias("base_pos"), F.col("above_neg").alias("base_neg"))
    inner = sums.groupBy("model", "chunk").applyInPandas(_offsets, shape).withColumn("chunk", chunk)
    add = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    offsets = inner.join(bases, ["model", "chunk"]).select(
        "model", "range", "hot", "pos", "neg",
        add("above_pos", "base_pos").alias("above_pos"), add("above_neg", "base_neg").alias("above_neg"))
    keys = ["model", "range"]
    cold = offsets.where(~F.col("hot")).select(*keys, "above_pos", "above_neg")
    parts = ranged.where(~F.col("hot")).select(*keys, "score", "id", "y").groupBy(*keys).cogroup(
        cold.groupBy(*keys)
    ).applyInPandas(_parts(resamples, seed), f"model string, part {vector}")
    if hot:
        parts = parts.unionByName(
            offsets.where("hot").groupBy("model").applyInPandas(_hot_part, f"model string, part {vector}")
        )
    zeros = F.array_repeat(F.lit(0.0), resamples)
    pool = parts.select("model", "part", zeros.alias("pos"), zeros.alias("neg")).unionByName(
        offsets.select("model", zeros.alias("part"), "pos", "neg")
    )
    slot = F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(ranges))))
    some = pool.withColumn("slot", slot).groupBy("model", "slot").applyInPandas(
        _fold_parts, f"model string, part {vector}, pos {vector}, neg {vector}")
    return some.groupBy("model").applyInPandas(
        _average_precision, "model string, b bigint, ap double"
    ).withColumn("ap", F.when(~F.isnan("ap"), F.col("ap")))


def paired_bootstrap(
    df: DataFrame, resamples: int = DEFAULT_RESAMPLES, seed: int = DEFAULT_SEED, rows_per_range: int = 50_000,
) -> DataFrame:
    """One row: standard error and 95 % interval of AP(challenger) - AP(champion)."""
    draws = bootstrap_average_precision(df, resamples, seed, rows_per_range)
    deltas = draws.groupBy("b").agg(
        (F.max(F.when(F.col("model") == "p_challenger", F.col("ap")))
         - F.max(F.when(F.col("model") == "p_champion", F.col("ap")))).alias("delta")
    ).where(F.col("delta").isNotNull())
    enough = F.count("*") >= 2
    return deltas.agg(
        F.count("*").alias("resamples_used"),
        F.when(enough, F.stddev_samp("delta")).alias("standard_error"),
        F.when(enough, F.percentile("delta", 0.025)).alias("ci_low"),
        F.when(enough, F.percentile("delta", 0.975)).alias("ci_high"),
    )
