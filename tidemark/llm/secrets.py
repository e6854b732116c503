"""Secret scans: base patterns, and a character network over every other candidate.

The base patterns always stand. Long tokens beside them are candidates; a convolutional
network over the candidate and the characters around it decides, trained in numpy on all
findings of the base patterns and all candidates without any: shards of them, dealt by hash, train
side by side and their weights are averaged a few times. Scores are calibrated on rows held out of
every shard, and the threshold is the exact quantile that keeps a recall there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, whole_groups
from tidemark.llm.registry import query, table
from tidemark.operators.order_stats import order_statistics
from tidemark.session import discard, materialise_at

#: Fixed patterns of the base kinds, in the order that breaks ties.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this equals dropping shorter runs

#: A long run of token characters may be a secret that no pattern names.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

BEFORE, INSIDE, AFTER, KERNEL, FILTERS, CODES = 24, 40, 12, 5, 16, 98
WIDTH = BEFORE + INSIDE + AFTER
#: Rows of the rarer label to a shard (ten times as many of the other), and distinct windows a scanning task holds.
FIT_ROWS, HELD_WINDOWS = 2000, 50_000
#: Averages of the shards' weights, and epochs of a shard before each.
ROUNDS, EPOCHS = 4, 3
#: Times that a finding is redrawn at most.
MOST_REDRAWN = 8
RECALL = 0.98


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base findings, by start, then kind."""
    spans = []
    lower = text.lower()
    if any(word in lower for word in _KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


_ASCII = np.arange(128)
_TO_CODE = np.where((_ASCII >= 32) & (_ASCII < 127), _ASCII - 30, 1)  # 0 pads, 1 is any other character


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the characters before, inside and after a view of at most INSIDE characters."""
    inside = text[start:end]
    view = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + inside.ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")
    points = np.frombuffer(view.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 128, _TO_CODE[np.minimum(points, 127)], 1)
    return np.where(points == 0, 0, codes).astype(np.uint8)


def views(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate in views of at most INSIDE characters; those of a long one overlap by half and reach its end."""
    last = max(start, end - INSIDE)
    return [(at, min(at + INSIDE, end)) for at in (*range(start, last, INSIDE // 2), last)]


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches that base findings cover, apart from each other."""
    out: list[tuple[int, int]] = []
    for start, _, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """``(start, end, stretches of base findings that it overlaps)`` of every candidate, over the whole text."""
    merged, found, at = _merged(spans), [], 0
    for match in CANDIDATE.finditer(text):
        while at < len(merged) and merged[at][1] <= match.start():
            at += 1
        stop = at
        while stop < len(merged) and merged[stop][0] < match.end():
            stop += 1
        found.append((match.start(), match.end(), merged[at:stop]))
    return found


@dataclass
class CharNet:
    """One convolution over character codes, the maximum of each region, a logistic layer."""

    table: np.ndarray  # KERNEL x CODES x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 3 regions x FILTERS
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    #: Of the rows held out, at the threshold.
    recall: float = math.nan
    precision: float = math.nan

    def _convolve(self, codes: np.ndarray) -> np.ndarray:
        steps = codes.shape[1] - KERNEL + 1
        out = np.tile(self.bias, (len(codes), steps, 1))
        for k in range(KERNEL):
            out += self.table[k][codes[:, k : k + steps]]
        return np.maximum(out, 0)

    def _pool(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = (0, BEFORE - 2, BEFORE + INSIDE - 2, out.shape[1])
        places = np.stack([out[:, a:b].argmax(axis=1) + a for a, b in zip(cuts, cuts[1:])], axis=1)
        return np.take_along_axis(out[:, None], places[:, :, None, :], axis=2)[:, :, 0], places

    def margins(self, codes: np.ndarray) -> np.ndarray:
        parts = [np.zeros(0)]
        for i in range(0, len(codes), 2000):
            pooled, _ = self._pool(self._convolve(codes[i : i + 2000]))
            parts.append((pooled * self.weights).sum(axis=(1, 2)) + self.offset)
        return np.concatenate(parts)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-(self.slope * self.margins(codes) + self.shift)))

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int | list[int] = 7) -> None:
        """Both labels weigh the same in all."""
        share = np.mean(labels)
        heavy = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) if 0 < share < 1 else np.ones(len(labels))
        rng = np.random.default_rng(seed)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.table, self.bias, self.weights, np.zeros(1))]
        t = 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(codes)), max(1, len(codes) // 128)):
                x, y = codes[part], labels[part]
                out = self._convolve(x)
                pooled, places = self._pool(out)
                p = 1 / (1 + np.exp(-((pooled * self.weights).sum(axis=(1, 2)) + self.offset)))
                error = (p - y) * heavy[part]
                slope = error[:, None, None] / len(part)
                back = np.where(pooled > 0, slope * self.weights, 0)
                grown = np.zeros_like(self.table)
                rows = np.arange(len(part))[:, None, None]
                channel = np.broadcast_to(np.arange(FILTERS), places.shape)
                for k in range(KERNEL):
                    np.add.at(grown[k], (x[rows, places + k], channel), back)
                t += 1
                grads = (grown, back.sum(axis=(0, 1)), (slope * pooled).sum(axis=0), np.array([error.mean()]))
                steps = []
                for grad, moments in zip(grads, state):
                    moments[0] = 0.9 * moments[0] + 0.1 * grad
                    moments[1] = 0.999 * moments[1] + 0.001 * grad**2
                    steps.append(rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8))
                self.table -= steps[0]
                self.bias -= steps[1]
                self.weights -= steps[2]
                self.offset -= float(steps[3][0])

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling on rows held out, then the largest threshold that keeps the recall."""
        margin = self.margins(codes)
        self.scale(margin, labels, np.ones(len(margin)))
        positive = np.sort(self.scores(codes)[labels == 1])
        self.threshold = float(positive[int((1 - recall) * len(positive))])
        flagged = labels[self.scores(codes) >= self.threshold]
        self.recall, self.precision = float(flagged.sum() / len(positive)), float(flagged.mean())

    def scale(self, margin: np.ndarray, share: np.ndarray, rows: np.ndarray) -> None:
        """Platt scaling; each margin stands for `rows` rows, of which `share` are findings."""
        a, b, total = 1.0, 0.0, rows.sum()
        for _ in range(200):
            error = (1 / (1 + np.exp(-(a * margin + b))) - share) * rows
            a -= 0.1 * (error * margin).sum() / total
            b -= 0.1 * error.sum() / total
        self.slope, self.shift = float(max(a, 1e-3)), float(b)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.table.ravel(), self.bias, self.weights.ravel(), [self.offset]])

    def take(self, flat: np.ndarray) -> None:
        table, bias, weights, offset = np.split(flat, np.cumsum([self.table.size, self.bias.size, self.weights.size]))
        self.table, self.bias, self.weights = table.reshape(self.table.shape).copy(), bias.copy(), weights.reshape(self.weights.shape).copy()
        self.offset = float(offset[0])


def new_net(seed: int = 7) -> CharNet:
    rng = np.random.default_rng(seed)
    return CharNet(rng.normal(0, 0.1, (KERNEL, CODES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, (3, FILTERS)), 0.0)


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``label, rank, codes``: views of candidates under base findings (1), and of candidates without any (0).

    All of them, each distinct window once for a label; the rank is a hash of the window.
    """

    def shipped(kept: tuple[set, set]) -> pa.RecordBatch:
        rows = [(label, xxhash.xxh64_intdigest(c) >> 1, c) for label in (0, 1) for c in kept[label]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["label", "rank", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[set, set] = (set(), set())
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for start, end, hits in candidates(text, base_spans(text)):
                    for a, b in views(start, end):
                        hit = any(s < b and e > a for s, e in hits)
                        if hit or not hits:  # what a candidate holds beside its finding has no label
                            kept[hit].add(window(text, a, b).tobytes())
                    if len(kept[0]) + len(kept[1]) > HELD_WINDOWS:
                        yield shipped(kept)
                        kept = (set(), set())
        if kept[0] or kept[1]:
            yield shipped(kept)

    found = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "label int, rank bigint, codes binary")
    return found.distinct()


def _augment(codes: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Redraw the characters of findings in other alphabets, and show them in the surroundings of clean candidates.

    Without this the network would know only the alphabet and the keyword of the base patterns. The rarer findings
    are beside the clean candidates, the more often they are redrawn.
    """
    good, bad = codes[labels == 1], codes[labels == 0]
    if not len(good):
        return codes, labels
    times = min(MOST_REDRAWN, max(1, len(bad) // len(good)))
    drawn = good[rng.integers(0, len(good), times * len(good))].copy()
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
                 "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "0123456789abcdef"]
    for row in drawn:
        letters = np.array([ord(c) - 30 for c in alphabets[rng.integers(len(alphabets))]], np.uint8)
        size = rng.integers(20, INSIDE + 1)
        row[BEFORE : BEFORE + INSIDE] = 0
        row[BEFORE : BEFORE + size] = letters[rng.integers(0, len(letters), size)]
    if len(bad):
        other = bad[rng.integers(0, len(bad), len(drawn))]
        half = len(drawn) // 2
        drawn[:half, :BEFORE] = other[:half, :BEFORE]
        drawn[:half, BEFORE + INSIDE :] = other[:half, BEFORE + INSIDE :]
    return np.concatenate([codes, drawn]), np.concatenate([labels, np.ones(len(drawn))])


def _split(shard: pa.Table, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(codes, labels, rows held out at the front) of one shard, findings redrawn beside themselves."""
    rows = sorted(zip(shard.column("rank").to_pylist(), shard.column("codes").to_pylist(), shard.column("label").to_pylist()))
    codes, labels = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WIDTH), np.array([r[2] for r in rows], float)
    rng = np.random.default_rng([seed, shard.column("shard")[0].as_py()])
    codes, labels = _augment(codes, labels, rng)
    order = rng.permutation(len(codes))
    codes, labels = codes[order], labels[order]
    cut = max(1, len(codes) // 5)
    return codes, labels, cut if labels[:cut].any() else 0  # too few rows to hold any out


def _shards(table_: pa.Table) -> Iterator[pa.Table]:
    numbers = table_.column("shard").to_numpy()
    starts = np.append(np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])), len(numbers))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield table_.slice(a, b - a)


#: Weights are added up as whole numbers, so that their average does not depend on the order of the shards.
_UNIT = 2.0**40


def train(docs: DataFrame, rows: int = FIT_ROWS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> CharNet | None:
    """A network fitted on all labelled candidates, in shards of about `rows` of the rarer label; None without findings of both labels."""
    known, path = materialise_at(labelled(docs, id_col, text_col), "labelled")
    try:
        sizes = sorted(r["count"] for r in known.groupBy("label").count().collect())
        if len(sizes) < 2:
            return None
        shards = max(math.ceil(sizes[0] / rows), math.ceil(sizes[1] / (10 * rows)))
        dealt = known.withColumn("shard", F.pmod("rank", F.lit(shards)))
        net = new_net(seed)
        for round_ in range(ROUNDS):
            start = net.flat()

            def fit(table_: pa.Table, start=start, round_=round_) -> Iterator[pa.RecordBatch]:
                total, n = np.zeros(len(start), np.int64), 0
                for shard in _shards(table_):
                    codes, labels, cut = _split(shard, seed)
                    mine = new_net(seed)
                    mine.take(start)
                    mine.fit(codes[cut:], labels[cut:], EPOCHS, seed=[seed, round_])
                    total += np.rint(mine.flat() * _UNIT).astype(np.int64)
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.int64()))], ["n", "total"])

            sums = whole_groups(dealt, ["shard"], "n bigint, total array<bigint>", fit, partitions=shards).collect()
            net.take(np.sum([np.array(r["total"], np.int64) for r in sums], axis=0) / _UNIT / sum(r["n"] for r in sums))
        _calibrate(net, dealt, shards, recall, seed)
        return net
    finally:
        discard(docs.sparkSession, path)


def _calibrate(net: CharNet, dealt: DataFrame, shards: int, recall: float, seed: int) -> None:
    """As :meth:`CharNet.calibrate`, on the rows held out of every shard; without findings there, on all rows."""

    def held_out(table_: pa.Table) -> Iterator[pa.RecordBatch]:
        for shard in _shards(table_):
            codes, labels, cut = _split(shard, seed)
            yield pa.RecordBatch.from_arrays([pa.array(net.margins(codes)), pa.array(labels == 1), pa.array(np.arange(len(codes)) < cut)], ["margin", "hit", "held"])

    every, path = materialise_at(whole_groups(dealt, ["shard"], "margin double, hit boolean, held boolean", held_out, partitions=shards), "margins")
    margins = every.where("held")
    if margins.where("hit").isEmpty():
        margins = every
    # margins within a thousandth are scaled as one; the threshold is exact
    near = margins.groupBy(F.round("margin", 3).alias("m")).agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("int")).alias("share")).orderBy("m").toPandas()
    net.scale(near["m"].to_numpy(), near["share"].to_numpy(float), near["n"].to_numpy(float))
    least = order_statistics(margins.where("hit"), {"margin": lambda n: [int((1 - recall) * n)]})["margin"]
    margin = next(iter(least.values()))
    net.threshold = float(1 / (1 + np.exp(-(net.slope * margin + net.shift))))
    flagged = F.col("margin") >= margin
    row = margins.agg(F.count_if(flagged & F.col("hit")).alias("tp"), F.count_if("hit").alias("p"), F.count_if(flagged).alias("flagged")).first()
    net.recall, net.precision = row["tp"] / row["p"], row["tp"] / row["flagged"]
    discard(dealt.sparkSession, path)


def _scan(texts: list[str], net: CharNet | None) -> list[list[tuple[int, int, int]]]:
    """Base findings, and the candidates beyond them of which any view reaches the threshold."""
    found, codes, owners = [], [], []
    for i, text in enumerate(texts):
        spans = base_spans(text)
        found.append(spans)
        if net is not None:
            for start, end, hits in candidates(text, spans):
                if not any(s <= start and end <= e for s, e in hits):
                    for a, b in views(start, end):
                        codes.append(window(text, a, b))
                        owners.append((i, start, end))
    if codes:
        reached = net.scores(np.stack(codes)) >= net.threshold
        for i, start, end in dict.fromkeys(o for o, hit in zip(owners, reached.tolist()) if hit):
            found[i].append((start, 3, end))
    return [sorted(spans) for spans in found]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, net: CharNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, findings``: spans in code points, end exclusive, by start, then kind.

    One row per row of `docs`; NULL and empty texts have no findings, repeated rows repeat,
    other columns are not read. Without a network only the base patterns report.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = _scan(batch.column(1).to_pylist(), net)
        spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row] for row in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["doc_id", "findings"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(chosen, f"doc_id {id_type}, findings array<struct<kind:string,start:bigint,end:bigint>>", work)


def redact(docs: DataFrame, net: CharNet | None, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with every finding replaced by a mark; findings that overlap are replaced once, NULL stays NULL."""
    place = docs.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(place).to_pylist()
        out = []
        for text, spans in zip(texts, _scan([t or "" for t in texts], net)):
            parts, at = [], 0
            for start, _, end in spans:
                if start >= at:
                    parts += [text[at:start], mark]
                at = max(at, end)
            out.append(text if text is None or not spans else "".join(parts) + text[at:])
        return batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))

    return map_arrow(docs, docs.schema, work)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    clean = redact(docs, train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


@query("op6_secret_network")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, train(docs))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("findings", lambda x: x["kind"] != "model"), line), ",")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), count("model"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", line), ",").alias("spans"))
