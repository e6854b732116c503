"""LM scoring by masked pseudo-likelihood: every token predicted from the tokens on both sides.

Word counts over the whole corpus give a vocabulary, its frequency classes and the share of each
token in its class. A small network reads the window around a masked token and predicts the class, then the
token among the members of the class, for which its share is only where learning begins; each partition trains a copy on its own texts and the copies are averaged, weighted by their tokens, so
every text takes part. A document's score is the sum of its conditional log probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch_bytes, group_starts, map_arrow, prefix_hashes, slice_hashes, whole_groups, words_of
from tidemark.llm.registry import query, table
from tidemark.session import materialise

#: Words with a token of their own; all others share hashed buckets, which are predicted as tokens.
WORDS, BUCKETS = 4096, 4096
CLASSES, SIDE, DIMS, HIDDEN = 64, 2, 16, 32
BATCH, RATE = 2048, 0.05
_BLOCK = 1 << 13


@dataclass
class Units:
    """Tokens of the model: sorted hashes of the frequent words, class and share of every token."""

    hashes: np.ndarray
    kind: np.ndarray
    log_share: np.ndarray

    def members(self) -> list[np.ndarray]:
        """Tokens of every class."""
        order = np.argsort(self.kind, kind="stable")
        return np.split(order, np.searchsorted(self.kind[order], np.arange(1, CLASSES)))

    @property
    def pad(self) -> int:
        return WORDS + BUCKETS

    def tokens(self, words: np.ndarray) -> np.ndarray:
        out = WORDS + (words >> np.uint64(40)).astype(np.int64) % BUCKETS
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == words, at, out)
        return out


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column and the number of words before each row."""
    data, offsets = batch_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    begin, end = words_of(data, offsets)
    return slice_hashes(prefix_hashes(data), begin, end), np.searchsorted(begin, offsets)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: occurrences of each hashed word in all texts; counted per batch, then shuffled."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, count = np.unique(_hashed(batch.column(0))[0].view(np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(count)], ["word", "n"])

    return map_arrow(docs.select("text"), "word bigint, n bigint", work).groupBy("word").agg(F.sum("n").alias("n"))


def fit_units(docs: DataFrame) -> Units:
    """The vocabulary by exact counts; rows sent to the driver are bounded by WORDS and BUCKETS."""
    counts = word_counts(docs)
    bucket = F.pmod(F.shiftrightunsigned("word", 40), F.lit(BUCKETS))
    counts = materialise(counts, "words")
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    totals = counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect()
    hashes = np.array([r.word for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    n = np.ones(WORDS + BUCKETS)
    n[: len(top)] += np.array([r.n for r in top], float)[order] if top else 0
    for r in totals:
        n[WORDS + r.bucket] += r.n
    for r in top:
        n[WORDS + ((r.word & 0xFFFFFFFFFFFFFFFF) >> 40) % BUCKETS] -= r.n
    by_count = np.argsort(-n, kind="stable")
    # classes hold equal shares of the text, so the commonest tokens are classes of their own
    reached = np.cumsum(n[by_count]) - n[by_count] / 2
    kind = np.empty(len(n), np.int64)
    kind[by_count] = np.minimum((reached / n.sum() * CLASSES).astype(np.int64), CLASSES - 1)
    share = np.log(n) - np.log(np.maximum(np.bincount(kind, n, CLASSES), 1))[kind]
    return Units(hashes[order], kind, share.astype(np.float32))


class WindowNet:
    """Embeddings of the window, one hidden layer, a softmax over the classes and one over the members of a class."""

    SHAPES = ((WORDS + BUCKETS + 1, DIMS), (2 * SIDE * DIMS, HIDDEN), (HIDDEN,), (WORDS + BUCKETS, HIDDEN), (HIDDEN, CLASSES), (CLASSES,))

    def __init__(self, flat: np.ndarray | None = None, seed: int = 5):
        sizes = [math.prod(s) for s in self.SHAPES]
        if flat is None:
            rng = np.random.default_rng(seed)
            scale = (0.1, 1 / math.sqrt(2 * SIDE * DIMS), 0, 0, 1 / math.sqrt(HIDDEN), 0)
            flat = np.concatenate([rng.normal(0, 1, n) * s for n, s in zip(sizes, scale)])
        self.flat = flat.astype(np.float32)
        cuts = np.cumsum([0, *sizes])
        self.parts = [self.flat[a:b].reshape(s) for a, b, s in zip(cuts, cuts[1:], self.SHAPES)]
        self.squares = np.full(len(self.flat), 1e-6, np.float32)
        self.grads = np.zeros(len(self.flat), np.float32)
        self.views = [self.grads[a:b].reshape(s) for a, b, s in zip(cuts, cuts[1:], self.SHAPES)]

    def forward(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        embed, inner, bias, _, outer, base = self.parts
        read = embed[window].reshape(len(window), -1)
        hidden = np.tanh(read @ inner + bias)
        z = hidden @ outer + base
        z -= z.max(axis=1, keepdims=True)
        return read, hidden, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def _within(self, hidden: np.ndarray, tokens: np.ndarray, units: Units, members: list[np.ndarray]) -> Iterator[tuple]:
        """Rows of one class, its members, the place of each row's token among them, log probabilities."""
        kind = units.kind[tokens]
        order = np.argsort(kind, kind="stable")
        starts = group_starts(kind[order])
        for rows in np.split(order, starts[1:]) if len(order) else []:
            own = members[kind[rows[0]]]
            if len(own) > 1:
                z = hidden[rows] @ self.parts[3][own].T + units.log_share[own]
                z -= z.max(axis=1, keepdims=True)
                yield rows, own, np.searchsorted(own, tokens[rows]), z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def token_logs(self, window: np.ndarray, tokens: np.ndarray, units: Units, members: list[np.ndarray]) -> np.ndarray:
        """Log probability of each token given its window: that of its class, and of the token in its class."""
        _, hidden, logs = self.forward(window)
        out = logs[np.arange(len(tokens)), units.kind[tokens]].astype(np.float64)
        for rows, _, at, inside in self._within(hidden, tokens, units, members):
            out[rows] += inside[np.arange(len(rows)), at]
        return out

    def learn(self, window: np.ndarray, kind: np.ndarray, rate: float = RATE, tokens: np.ndarray | None = None,
              units: Units | None = None, members: list[np.ndarray] | None = None) -> None:
        """One Adagrad step on the mean loss of a batch; without tokens, on that of the classes alone."""
        read, hidden, logs = self.forward(window)
        error = np.exp(logs)
        error[np.arange(len(kind)), kind] -= 1
        error /= len(kind)
        self.grads[:] = 0
        back = error @ self.parts[4].T
        if tokens is not None:
            for rows, own, at, inside in self._within(hidden, tokens, units, members):
                wrong = np.exp(inside)
                wrong[np.arange(len(rows)), at] -= 1
                wrong /= len(kind)
                self.views[3][own] = wrong.T @ hidden[rows]
                back[rows] += wrong @ self.parts[3][own]
        back *= 1 - hidden * hidden
        np.add.at(self.views[0], window.ravel(), (back @ self.parts[1].T).reshape(-1, DIMS))
        self.views[1][:] = read.T @ back
        self.views[2][:] = back.sum(axis=0)
        self.views[4][:] = hidden.T @ error
        self.views[5][:] = error.sum(axis=0)
        self.squares += self.grads * self.grads
        self.flat -= rate * self.grads / np.sqrt(self.squares)


def _windows(units: Units, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their windows without themselves, and the bounds of the rows; windows never leave a text."""
    words, bounds = _hashed(column)
    tokens = units.tokens(words)
    sizes = np.diff(bounds)
    place = np.arange(len(tokens)) + SIDE * (1 + np.repeat(np.arange(len(sizes)), sizes))
    padded = np.full(len(tokens) + SIDE * (len(sizes) + 1), units.pad, np.int64)
    padded[place] = tokens
    around = [d for d in range(-SIDE, SIDE + 1) if d]
    return tokens, np.stack([padded[place + d] for d in around], axis=1), bounds


def train(docs: DataFrame, units: Units, rounds: int = 1) -> WindowNet:
    """Average of the networks that every partition trains on all of its texts, `rounds` times over."""
    net = WindowNet()
    text = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    salts = max(1, math.isqrt(docs.rdd.getNumPartitions()))
    for _ in range(rounds):
        start = net.flat.copy()

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own, seen, part = WindowNet(start), 0, 0
            members = units.members()
            for batch in batches:
                tokens, window, _ = _windows(units, batch.column(0))
                part = batch.column(1)[0].as_py() if batch.num_rows else part
                for i in range(0, len(tokens), BATCH):
                    some = tokens[i : i + BATCH]
                    own.learn(window[i : i + BATCH], units.kind[some], RATE, some, units, members)
                seen += len(tokens)
            if seen:
                blocks = [own.flat[i : i + _BLOCK].astype(np.float64) * seen for i in range(0, len(own.flat), _BLOCK)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(len(blocks)), pa.int64()), pa.array([part % salts] * len(blocks), pa.int64()),
                    pa.array([seen] * len(blocks), pa.int64()), pa.array([b.tobytes() for b in blocks], pa.binary())],
                    ["block", "salt", "weight", "values"])

        schema = "block bigint, salt bigint, weight bigint, values binary"
        copies = text.mapInArrow(run, schema)
        some = whole_groups(copies, ["block", "salt"], schema, _added, rows=1)
        total = whole_groups(some.withColumn("salt", F.lit(0).cast("bigint")), ["block"], schema, _added, rows=1).collect()
        if not total:
            return net
        flat = np.concatenate([np.frombuffer(r["values"], np.float64) / r.weight for r in sorted(total, key=lambda r: r.block)])
        net = WindowNet(flat)
    return net


def _added(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """Sum of the weighted blocks of each group."""
    block, salt, weight = (part.column(c).to_numpy() for c in ("block", "salt", "weight"))
    starts = np.append(group_starts(block, salt), len(block))
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        values = part.column("values").slice(a, b - a).to_pylist()
        total = np.frombuffer(values[0], np.float64).copy()
        for v in values[1:]:
            total += np.frombuffer(v, np.float64)
        out.append((int(block[a]), int(salt[a]), int(weight[a:b].sum()), total.tobytes()))
    columns = list(zip(*out))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["block", "salt", "weight", "values"])


def score(docs: DataFrame, units: Units, net: WindowNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_rare, log_likelihood, mean_log_likelihood`` of every row of `docs`.

    ``n_rare`` tokens are buckets of words outside the vocabulary. NULL, empty and blank texts have no
    tokens, a sum of zero and a NULL mean; repeated rows repeat.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    flat, members = net.flat, units.members()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = WindowNet(flat)
        tokens, window, bounds = _windows(units, batch.column(1))
        logs = np.zeros(len(tokens) + 1)
        for i in range(0, len(tokens), 4 * BATCH):
            part = tokens[i : i + 4 * BATCH]
            logs[i + 1 : i + 1 + len(part)] = model.token_logs(window[i : i + 4 * BATCH], part, units, members)
        total = np.diff(np.cumsum(logs)[bounds])
        rare = np.diff(np.append(0, np.cumsum(tokens >= WORDS))[bounds])
        size = np.diff(bounds)
        mean = pa.array(total / np.maximum(size, 1), mask=size == 0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(rare), pa.array(total), mean],
                                          ["doc_id", "n_tokens", "n_rare", "log_likelihood", "mean_log_likelihood"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(chosen, f"doc_id {id_type}, n_tokens bigint, n_rare bigint, log_likelihood double, mean_log_likelihood double", work)


def pseudo_likelihood(docs: DataFrame, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on all texts of `docs` and score them; an empty table gives no rows."""
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    units = fit_units(text)
    return score(docs, units, train(text, units, rounds), id_col, text_col)


@query("op8_masked_pseudo_likelihood")
def op8(spark, sf_dir):
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
