"""SentencePiece encoding and decoding: distinct segmentations by Gumbel top-k over the lattice.

The mass below a lattice node is known exactly, so the perturbed score of a partial path is a
bound that its best completion attains: following the argmax keeps the score, and every edge not
taken gets a Gumbel truncated at it. An A* agenda over those edges therefore pops one finished
segmentation per expansion, in the order of the perturbed scores, and never the same one twice.
No piece reaches across the start of a word, so a text is a chain of word lattices; each
distinct word is built once and sampled for all its occurrences together.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import group_starts, inverses, map_arrow, mix64, powers, ranges
from tidemark.llm.registry import query, table

SAMPLES = 2
SPACE = "▁"
#: No standard Gumbel drawn from 53 bits is larger: -log(2**-54) is about 37.4.
GUMBEL_MAX = 37.5
_UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces of a SentencePiece model with log probabilities.

    A merge model stores the rank of each piece, not a probability; Zipf's law over the rank gives one.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_ = {}
        self.pieces: dict[str, int] = {}
        texts: list[bytes] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_[int(piece[1:-1], 16)] = i
                texts.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                texts.append(b"")
            else:
                self.pieces[piece] = i
                texts.append(piece.replace(SPACE, " ").encode())
        self.texts = texts
        first = min(self.pieces.values())
        total = math.log(sum(1 / (1 + i - first) for i in self.pieces.values()))
        self.score = {p: -math.log(1 + i - first) - total for p, i in self.pieces.items()}
        self.unknown = min(self.score.values()) - _UNKNOWN_PENALTY
        self.longest = max(map(len, self.pieces))
        self.scores = np.zeros(size + 1)
        for p, i in self.pieces.items():
            self.scores[i] = self.score[p]
        self.scores[list(self.bytes_.values())] = self.unknown
        self._index()
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("pieces reach across words")

    def _index(self) -> None:
        """Open addressing over the hashes of the pieces."""
        names = list(self.pieces)
        sizes = np.array([len(p) for p in names], np.int64)
        points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        begin = np.cumsum(sizes) - sizes
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * powers(len(points)), out=sums[1:])
        hashes = mix64((sums[begin + sizes] - sums[begin]) * inverses(len(points) + 1)[begin])
        self._mask = np.uint64((1 << 19) - 1)
        self._hash = np.zeros(1 << 19, np.uint64)
        self._piece = np.full(1 << 19, -1, np.int32)
        self._probes = 1
        for h, p in zip(hashes.tolist(), names):
            at, probes = h & int(self._mask), 1
            while self._hash[at]:
                at, probes = (at + 1) & int(self._mask), probes + 1
            self._hash[at], self._piece[at] = h, self.pieces[p]
            self._probes = max(self._probes, probes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        at = (hashes & self._mask).astype(np.int64)
        out = np.full(len(hashes), -1, np.int32)
        open_ = np.arange(len(hashes))
        for _ in range(self._probes):
            seen = self._hash[at]
            hit = seen == hashes[open_]
            out[open_[hit]] = self._piece[at[hit]]
            more = ~hit & (seen != 0)
            if not more.any():
                break
            open_, at = open_[more], (at[more] + 1) & int(self._mask)
        return out

    def fallback(self, char: str) -> list[int]:
        return [self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


_WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def words(text: str) -> list[str]:
    """The parts of a text that pieces never cross, in the model's own spelling of spaces."""
    return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Lattices:
    """Flat arrays of the lattices of distinct words: edges by node, with conditional probabilities.

    All substrings up to the longest piece are looked up at once by rolling hashes, and the masses
    of all words are summed together, one distance from the word's end after the other.
    """

    def __init__(self, vocab: Vocabulary, distinct: list[str]):
        sizes = np.array([len(w) for w in distinct], np.int64)
        begin = np.cumsum(sizes) - sizes
        points = np.frombuffer("".join(distinct).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        self.root = begin
        end = np.repeat(begin + sizes, sizes)
        width = min(vocab.longest, int(sizes.max()) if n else 0)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * powers(n), out=sums[1:])
        back = inverses(n + 1)[:n]
        piece = np.full((n, max(width, 1)), -1, np.int32)
        for size in range(1, width + 1):
            at = np.flatnonzero(np.arange(n) + size <= end)
            piece[at, size - 1] = vocab.find(mix64((sums[at + size] - sums[at]) * back[at]))
        self.multi: list[list[int]] = []
        for i in np.flatnonzero(piece[:, 0] < 0).tolist() if n else []:
            ids = vocab.fallback(chr(points[i]))
            if len(ids) == 1:
                piece[i, 0] = ids[0]
            else:
                self.multi.append(ids)
                piece[i, 0] = -1 - len(self.multi)
        there = piece != -1
        self.node, step = np.nonzero(there)
        self.piece = piece[there]
        value = vocab.scores[np.maximum(self.piece, 0)]
        odd = np.flatnonzero(self.piece < 0)
        value[odd] = [vocab.unknown * len(self.multi[-p - 2]) for p in self.piece[odd].tolist()]
        target = self.node + step + 1
        # the end of a word has mass one
        self.target = np.where(target == end[self.node], -1, target) if n else target
        into = np.where(self.target < 0, n, target)
        self.first = np.searchsorted(self.node, np.arange(n + 1))
        left = end - np.arange(n)
        mass = np.zeros(n + 1)
        by_left = np.argsort(left[self.node], kind="stable")
        cuts = np.searchsorted(left[self.node][by_left], np.arange(1, (int(left.max()) if n else 0) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            edges = by_left[a:b]
            nodes = self.node[edges]
            starts = group_starts(nodes)
            total = value[edges] + mass[into[edges]]
            top = np.maximum.reduceat(total, starts)
            spread = np.exp(total - np.repeat(top, np.diff(np.append(starts, len(nodes)))))
            mass[nodes[starts]] = top + np.log(np.add.reduceat(spread, starts))
        self.logp = value + mass[into] - mass[self.node]
        upto = np.cumsum(np.exp(self.logp))
        base = np.concatenate(([0.0], upto))[self.first[:-1]]
        self.upto = upto - base[self.node]
        self.upto[self.first[1:] - 1] = 2.0  # whatever the rounding, the last edge takes what is left

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample each chain from its node to the end of its word: edges in order, and how many per chain."""
        count = np.zeros(len(nodes), np.int64)
        steps = []
        live = np.flatnonzero(nodes >= 0)
        at = nodes[live]
        step = np.uint64(0)
        while len(live):
            draw = (mix64(keys[live] + step) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[at].copy()
            behind = np.flatnonzero(draw >= self.upto[edge])
            while len(behind):
                edge[behind] += 1
                behind = behind[draw[behind] >= self.upto[edge[behind]]]
            steps.append((live, edge))
            count[live] += 1
            at = self.target[edge]
            on = at >= 0
            live, at = live[on], at[on]
            step += np.uint64(1)
        out = np.zeros(int(count.sum()), np.int64)
        begin = np.cumsum(count) - count
        for k, (live, edge) in enumerate(steps):
            out[begin[live] + k] = edge
        return out, count


class Path:
    """One segmentation of one text: its edges by word, its log probability and perturbed score."""

    __slots__ = ("edges", "counts", "score", "fixed", "logp")

    def __init__(self, edges, counts, score, fixed, logp):
        self.edges, self.counts, self.score, self.fixed, self.logp = edges, counts, score, fixed, logp


def _side_edges(lat: Lattices, parts: list[np.ndarray], before: np.ndarray, scores: np.ndarray, keys: np.ndarray, done: np.ndarray) -> tuple:
    """Edges beside stretches of paths, with the text they belong to, their place and their perturbed score."""
    sizes = np.array([len(p) for p in parts])
    part = np.concatenate(parts)
    text = np.repeat(np.arange(len(parts)), sizes)
    logs = lat.logp[part]
    run = np.cumsum(logs) - logs
    first = np.cumsum(sizes) - sizes
    prior = before[text] + run - np.concatenate((run, [0.0]))[first][text]
    low = lat.first[lat.node[part]]
    counts = lat.first[lat.node[part] + 1] - low
    side = ranges(low, counts)
    owner = np.repeat(np.arange(len(part)), counts)
    other = side != part[owner]
    side, owner = side[other], owner[other]
    who = text[owner]
    number = np.arange(len(side)) - np.searchsorted(who, np.arange(len(parts)))[who]
    draw = (mix64(keys[who] + (done[who] * 32 + number).astype(np.uint64)) >> np.uint64(11)).astype(np.float64)
    noise = np.log(-np.log1p(-(draw + 0.5) * 2.0**-53))
    # a Gumbel of this mass, truncated at the score of the path
    value = -np.logaddexp(-scores[who], noise - prior[owner] - lat.logp[side])
    return side, who, done[who] + owner - first[who], value


STRETCH = 64


def _push_sides(lat: Lattices, paths: list[Path], wants: list[int], keys: list[int], agendas: list[list], serial: int) -> None:
    """Put the untaken edges along fresh paths on the agendas, as far as they can be among the best wanted.

    `path.fixed` edges were fixed before the path was drawn; their alternatives are on the agenda already.
    """
    done = [p.fixed for p in paths]
    live = [i for i, p in enumerate(paths) if done[i] < len(p.edges)]
    before = {i: float(lat.logp[paths[i].edges[: done[i]]].sum()) for i in live}
    while live:
        parts = [paths[i].edges[done[i] : done[i] + STRETCH] for i in live]
        side, who, place, value = _side_edges(
            lat, parts, np.array([before[i] for i in live]), np.array([paths[i].score for i in live]),
            np.array([keys[i] for i in live], np.uint64), np.array([done[i] for i in live]))
        order = np.lexsort((-value, who))
        rank = np.arange(len(order)) - np.searchsorted(who[order], np.arange(len(live)))[who[order]]
        order = order[rank < np.array([wants[i] for i in live])[who[order]]]
        for w, v, at, edge in zip(who[order].tolist(), value[order].tolist(), place[order].tolist(), side[order].tolist()):
            i = live[w]
            heapq.heappush(agendas[i], (-v, serial, at, edge, paths[i]))
        still = []
        for i, part in zip(live, parts):
            before[i] += float(lat.logp[part].sum())
            done[i] += len(part)
            best = heapq.nsmallest(wants[i], agendas[i])
            if done[i] < len(paths[i].edges) and (len(best) < wants[i] or before[i] + GUMBEL_MAX >= -best[-1][0]):
                still.append(i)
        live = still


def top_segmentations(vocab: Vocabulary, texts: list[str], seeds: list[int], k: int) -> tuple[Lattices, list[list[tuple]]]:
    """Per text, at most `k` of ``(edges, log probability, perturbed score, log inclusion probability)``."""
    index: dict[str, int] = {}
    split = [[index.setdefault(w, len(index)) for w in words(t)] for t in texts]
    lat = Lattices(vocab, list(index))
    roots = [lat.root[np.array(w, np.int64)] for w in split]
    agendas: list[list] = [[] for _ in texts]
    found: list[list[Path]] = [[] for _ in texts]
    keys = [mix64(np.uint64(s) + np.arange(k + 1, dtype=np.uint64)) for s in seeds]
    tasks = []
    for i in range(len(texts)):
        u = (int(keys[i][0]) >> 11) * 2.0**-53
        tasks.append((i, -math.log(-math.log(u + 2.0**-54)), None))
    for r in range(k):
        nodes, chain_keys, plans = [], [], []
        for i, score, entry in tasks:
            if entry is None:
                start, prefix = 0, np.zeros(0, np.int64)
                chain, counts = roots[i], np.zeros(0, np.int64)
            else:
                _, _, at, edge, parent = entry
                ends = np.cumsum(parent.counts)
                word = int(np.searchsorted(ends, at, "right"))
                start, prefix = word, np.append(parent.edges[:at], edge)
                counts = parent.counts[:word]
                chain = roots[i][word:].copy()
                chain[0] = lat.target[edge]
            nodes.append(chain)
            chain_keys.append(mix64(keys[i][r] ^ (np.arange(start, start + len(chain), dtype=np.uint64) << np.uint64(20))))
            plans.append((i, score, prefix, counts, len(chain)))
        if not plans:
            break
        edges, count = lat.walk(np.concatenate(nodes), np.concatenate(chain_keys))
        begin = np.append(0, np.cumsum(count))
        at, tasks, paths = 0, [], []
        for i, score, prefix, counts, size in plans:
            own = count[at : at + size].copy()
            if len(prefix) and size:
                own[0] += len(prefix) - int(counts.sum())
            whole = np.concatenate((prefix, edges[begin[at] : begin[at + size]]))
            path = Path(whole, np.concatenate((counts, own)), score, len(prefix), float(lat.logp[whole].sum()))
            found[i].append(path)
            paths.append(path)
            at += size
        owners = [p[0] for p in plans]
        _push_sides(lat, paths, [k + 1 - len(found[i]) for i in owners], [int(keys[i][r]) ^ 0x2545F4914F6CDD1D for i in owners],
                    [agendas[i] for i in owners], r)
        for i in owners:
            if agendas[i] and r + 1 < k:
                entry = heapq.heappop(agendas[i])
                tasks.append((i, -entry[0], entry))
    out = []
    for i in range(len(texts)):
        # the best score that was not emitted is the threshold of the sample
        kappa = -agendas[i][0][0] if agendas[i] else -math.inf
        out.append([(p.edges, p.logp, p.score, _log_inclusion(p.logp - kappa)) for p in found[i]])
    return lat, out


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))"""
    if x > 4:
        return 0.0 if x > 6 else math.log1p(-math.exp(-math.exp(x)))
    return math.log(-math.expm1(-math.exp(x))) if x > -30 else x


def piece_ids(lat: Lattices, edges: np.ndarray) -> np.ndarray:
    """Piece ids of a path; characters outside the vocabulary become their bytes."""
    ids = lat.piece[edges]
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        extra = [lat.multi[-i - 2] for i in ids[odd].tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[odd] = [len(e) for e in extra]
        ids = np.repeat(ids, sizes)
        ids[ids < 0] = [p for e in extra for p in e]
    return ids


_OUT = pa.list_(pa.int32())


def sample_encode(docs: DataFrame, model_path: str, k: int = SAMPLES, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sample, ids, log_prob, score, log_inclusion``: up to `k` distinct segmentations per row.

    Drawn without replacement, best perturbed score first; ``log_inclusion`` is the log probability to lie
    above the first score left out (0 if none is). Draws depend on the seed, the id and the text alone, so
    repeated rows get the same samples. NULL and empty texts have one segmentation, of no pieces.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(model_path)
        texts = batch.column(2).to_pylist()
        keys = batch.column(1).to_pylist()
        rows, ranks, ids, logp, score, inclusion = [], [], [], [], [], []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) < 3_200_000):
                size += len(texts[end])
                end += 1
            part = texts[start:end]
            seeds = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), (x ^ seed) & 0xFFFFFFFFFFFFFFFF) for t, x in zip(part, keys[start:end])]
            lat, drawn = top_segmentations(vocab, part, seeds, k)
            for i, samples in enumerate(drawn):
                for r, (edges, lp, g, inc) in enumerate(samples):
                    rows.append(start + i)
                    ranks.append(r + 1)
                    ids.append(piece_ids(lat, edges))
                    logp.append(lp)
                    score.append(g)
                    inclusion.append(inc)
            start = end
        offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
        flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(rows)), pa.array(ranks, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat),
            pa.array(logp, pa.float64()), pa.array(score, pa.float64()), pa.array(inclusion, pa.float64())],
            ["doc_id", "sample", "ids", "log_prob", "score", "log_inclusion"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(chosen, f"doc_id {id_type}, sample int, ids array<int>, log_prob double, score double, log_inclusion double", work)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with ``ids`` replaced by ``text``: pieces and bytes joined, without the space before the text.

    NULL ids give NULL; bytes that are no UTF-8 become replacement characters.
    """
    place = encoded.columns.index(ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != ids_col) + ", text string"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = vocabulary(model_path).texts
        out = []
        for ids in batch.column(place):
            if not ids.is_valid:
                out.append(None)
                continue
            whole = b"".join([texts[i] for i in ids.values.to_numpy().tolist()]).decode("utf-8", "replace")
            out.append(whole[1:] if whole.startswith(" ") else whole)
        names = [n for n in batch.schema.names if n != ids_col]
        return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(out, pa.string())], [*names, "text"])

    return map_arrow(encoded, schema, work)


@query("op1_gumbel_segmentations")
def op1(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sampled = sample_encode(table(spark, sf_dir, "documents"), path)
    digest = sampled.withColumns({"n_pieces": F.size("ids").cast("long"), "ids_hash": F.xxhash64("ids")})
    back = decode(digest, path)
    return back.select("doc_id", "sample", "n_pieces", "ids_hash", "log_prob", "score", "log_inclusion",
                       F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("text_hash"))
