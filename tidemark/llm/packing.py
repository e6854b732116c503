"""Lexical retrieval packing: each window is filled with the seed's nearest unused documents.

Documents are tokenised once and dealt to shards by a MinHash of their tokens, so copies
and near relatives share a shard of bounded size. In a shard, a BM25 inverted index over token
ids (document frequencies are of the whole corpus) returns unused neighbours of the document
that opens a window; they fill it greedily, and the one that does not fit is cut and opens the next.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, group_starts, mix64, ranges
from tidemark.llm.registry import query, table
from tidemark.session import materialise

WINDOW = 1024
SHARD_TOKENS = 4_000_000
K1, B = 1.2, 0.75
#: A shard of very short texts is bounded by its documents.
SHARD_DOCS = 65_536
#: Up to here the scores of all pairs of a shard's documents are held (16 MB); beyond, those of one seed.
_PRODUCT_DOCS = 2048
#: Texts whose distinct words are encoded together.
ENCODE_BYTES = 8 << 20
#: Words of a batch that are laid out at once.
_WORDS_AT_ONCE = 1_000_000
#: Two neighbouring characters of white space, or one that the tokenizer may not see as white space.
_UNSAFE = r"[\pZ\t\n\v\f\r\x1c-\x1f\x{85}]{2}|[\x1c-\x1f\x{85}]"
_EDGE = r"^$|^[\pZ\t\n\v\f\r]|[\pZ\t\n\v\f\r]$"


class WordEncoder:
    """Byte-level BPE by words: each distinct word of a batch is encoded once, with the space before it.

    Between two characters that are not white space, a single space always begins a
    pre-token, so a text without neighbouring white space splits there. Other texts
    are encoded whole, those with a special token by the tokenizer file itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self._encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._json_path, self._whole = json_path, None
        with open(json_path, encoding="utf-8") as file:
            self._special = [t["content"] for t in json.load(file)["added_tokens"]]
        #: whether a token begins with a space
        self._opens = np.zeros(max(ranks.values()) + 1, bool)
        self._opens[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True

    def _file(self, text: str) -> list[int]:
        """Ids by the tokenizer file itself, which takes much memory and is read only when it is needed."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._json_path)
        return self._whole.encode(text, add_special_tokens=False).ids

    def _plain(self, text: str) -> bytes:
        return np.array(self._encoding.encode_ordinary(text), "<u2").tobytes()

    def _encode_each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._encoding.encode_ordinary(w) for w in words]
        return np.array([i for ids in found for i in ids], "<u2"), np.array([len(ids) for ids in found], np.int64)

    def _after_space(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words after a space, end to end, and how many each has. All are one text, which no token crosses at a space."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = self._encoding.encode_to_numpy(" " + joined, disallowed_special=())
        starts = np.flatnonzero(self._opens[ids])
        if len(starts) == len(words):
            return ids.astype("<u2"), np.diff(np.append(starts, len(ids)))
        return self._encode_each([" " + w for w in words.to_pylist()])

    def _by_words(self, texts: pa.Array) -> list[bytes]:
        parts = pc.split_pattern(texts, " ")
        values, offsets = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = values.dictionary_encode()
        edge = pc.match_substring_regex(coded.dictionary, _EDGE)
        inner, outer = coded.dictionary.filter(pc.invert(edge)), coded.dictionary.filter(edge)
        # words with white space at an edge are encoded alone; the first of a text has no space before it
        alone = [" " + w for w in outer.to_pylist()] + values.take(pa.array(offsets[:-1])).to_pylist()
        made = [self._after_space(inner), self._encode_each(alone)] if len(inner) else [self._encode_each(alone)]
        pool, size = (np.concatenate(c) for c in zip(*made))
        begin = np.cumsum(size) - size
        edge = edge.to_numpy(zero_copy_only=False)
        place = np.where(edge, len(inner) + np.cumsum(edge) - 1, np.cumsum(~edge) - 1)
        code = place[coded.indices.to_numpy()]
        code[offsets[:-1]] = len(edge) + np.arange(len(texts))
        out, at = [], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _WORDS_AT_ONCE, "right")) - 1)
            here = code[offsets[at] : offsets[end]]
            tokens = pool[ranges(begin[here], size[here])].tobytes()
            ends = np.append(0, np.cumsum(size[here]))[offsets[at : end + 1] - offsets[at]] * 2
            out += [tokens[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            at = end
        return out

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """Token ids of every text as little-endian 16-bit integers."""
        special = np.zeros(len(texts), bool)
        for mark in self._special:
            special |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for at in np.flatnonzero(special).tolist():
            out[at] = np.array(self._file(texts[at].as_py()), "<u2").tobytes()
        for at in np.flatnonzero(unsafe & ~special).tolist():
            out[at] = self._plain(texts[at].as_py())
        rest = np.flatnonzero(~unsafe & ~special)
        if len(rest):
            for at, tokens in zip(rest.tolist(), self._by_words(texts.take(pa.array(rest)))):
                out[at] = tokens
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch(pa.array([text], pa.string()))[0]


_encoders: dict[tuple, WordEncoder] = {}


def _encoder(*paths: str) -> WordEncoder:
    if paths not in _encoders:
        _encoders[paths] = WordEncoder(*paths)
    return _encoders[paths]


def _min_hash(ids: np.ndarray) -> int:
    """Smallest hash of three neighbouring tokens: equal for copies, often for near copies."""
    wide = ids.astype(np.uint64)
    if len(wide) > 2:
        wide = wide[:-2] | wide[1:-1] << np.uint64(16) | wide[2:] << np.uint64(32)
    return int((mix64(wide + np.uint64(1)) >> np.uint64(1)).min())


def tokenised(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, near, tokens``: ids and the closing id 0 as 16-bit integers, and the key that draws relatives together."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def encoded(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        tokens = [t + b"\0\0" for t in _encoder(json_path, ranks_path, pattern).encode_batch(texts)]
        near = [_min_hash(np.frombuffer(t, "<u2")) for t in tokens]
        return pa.RecordBatch.from_arrays([ids, pa.array(near, pa.int64()), pa.array(tokens, pa.binary())], ["doc_id", "near", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if size and size + batch.nbytes > ENCODE_BYTES:
                yield encoded(*pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns)
                held, size = [], 0
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
        if held:
            yield encoded(*pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns)
        del held
        give_back()

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {id_type}, near bigint, tokens binary")


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(ids)
    starts = group_starts(ordered)
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def document_frequencies(tokens: DataFrame, vocabulary: int = 1 << 16) -> np.ndarray:
    """Documents that hold each token id, over the whole corpus; as long as the vocabulary, not as the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        last = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                ids = np.frombuffer(blob, "<u2")
                place = np.arange(len(ids))
                last[ids] = place
                # each id counts where it stands last
                total[ids[last[ids] == place]] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["id", "n"])

    counts = tokens.select("tokens").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary, np.int64)
    out[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


class Index:
    """BM25 postings of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray):
        terms, owners, counts = [], [], []
        for i, ids in enumerate(docs):
            term, count = _distinct(ids)
            terms.append(term)
            counts.append(count.astype(np.float32))
            owners.append(np.full(len(term), i, np.int32))
        self.terms = terms
        term, owner, weight = np.concatenate(terms), np.concatenate(owners), np.concatenate(counts)
        del owners, counts
        size = np.array([len(d) for d in docs], float)
        norm = (K1 * (1 - B + B * size / size.mean())).astype(np.float32)
        # single precision and in place: a shard has millions of postings
        below = norm[owner]
        below += weight
        weight *= np.float32(K1 + 1)
        weight /= below
        del below
        weight *= idf[term]
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        del order, weight
        self.start = np.append(0, np.cumsum(np.bincount(term, minlength=1 << 16)))
        self.size = len(docs)
        # terms that an eighth of the documents hold are rows of their own: at most eight cells a posting
        length = np.diff(self.start)
        common = np.flatnonzero(8 * length > self.size)
        self.row = np.full(1 << 16, -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.size), np.float32)
        at = ranges(self.start[common], length[common])
        self.rows[np.repeat(np.arange(len(common)), length[common]), self.owner[at]] = self.weight[at]
        # few and long documents nearly all open a window: their common terms are summed by one product
        self.summed = None
        if self.size <= _PRODUCT_DOCS:
            held = np.zeros((self.size, len(common)), np.float32)
            at = self.row[term]
            shared = at >= 0
            held[owner[shared], at[shared]] = 1
            del at, shared
            self.summed = held @ self.rows

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for all distinct terms of the seed."""
        terms = self.terms[seed]
        row = self.row[terms]
        rare = terms[row < 0].astype(np.int64)
        at = ranges(self.start[rare], self.start[rare + 1] - self.start[rare])
        out = np.zeros(self.size)
        out += np.bincount(self.owner[at], self.weight[at], self.size)
        if self.summed is not None:
            return out + self.summed[seed]
        for i in row[row >= 0].tolist():
            out += self.rows[i]
        return out


def _best_first(places: np.ndarray, scores: np.ndarray, few: int = 32) -> Iterator[int]:
    """Places by falling score; all but the best few are sorted only when they are asked for."""
    if len(places) > 2 * few:
        split = np.argpartition(-scores, few)
        best, rest = split[:few], np.sort(split[few:])
        yield from places[best[np.lexsort((best, -scores[best]))]].tolist()
        places, scores = places[rest], scores[rest]
    yield from places[np.argsort(-scores, kind="stable")].tolist()


def order_of(docs: list[np.ndarray], idf: np.ndarray, window: int) -> list[int]:
    """The order in which a shard's documents are laid end to end."""
    index = Index(docs, idf)
    free = np.ones(len(docs), bool)
    # the seed's neighbours, best first; those that were laid down since are passed over
    order, filled, next_free, near = [], 0, 0, None
    for _ in docs:
        chosen = -1
        for i in near or ():
            if free[i]:
                chosen = i
                break
        if chosen < 0:
            while not free[next_free]:
                next_free += 1
            chosen = next_free
        free[chosen] = False
        order.append(chosen)
        over = filled + len(docs[chosen])
        if near is None or over >= window:
            # the document opens a window: alone, or with what did not fit the last one
            filled = over % window
            near = None
            if filled:
                scores = index.scores(chosen)
                held = np.flatnonzero((scores > 0) & free)
                near = _best_first(held, scores[held])
        else:
            filled = over
    return order


def _sequences(total: int, window: int) -> np.ndarray:
    """Where sequences begin: whole windows, then powers of two that need no padding."""
    starts = list(range(0, total - total % window, window))
    at = total - total % window
    while at < total:
        starts.append(at)
        at += 1 << int(math.log2(total - at))
    return np.array(starts, np.int64)


def _pack(shard: int, ids: pa.Array, docs: list[np.ndarray], idf: np.ndarray, window: int) -> pa.RecordBatch:
    order = np.array(order_of(docs, idf, window))
    sizes = np.array([len(docs[i]) for i in order])
    begins = np.cumsum(sizes) - sizes
    starts = _sequences(int(sizes.sum()), window)
    cuts = np.union1d(begins, starts)
    ends = np.append(cuts[1:], sizes.sum())
    owner = np.searchsorted(begins, cuts, "right") - 1
    sequence = np.searchsorted(starts, cuts, "right") - 1
    start = cuts - begins[owner]
    pieces = [docs[order[o]][s : s + n].astype("<u4").tobytes() for o, s, n in zip(owner.tolist(), start.tolist(), (ends - cuts).tolist())]
    return pa.RecordBatch.from_arrays([
        ids.take(pa.array(order[owner])), pa.array(start), pa.array(ends - cuts), pa.array(pieces, pa.binary()),
        pa.array(sizes[owner]), pa.array((shard << 33) + sequence), pa.array(cuts - starts[sequence]),
    ], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, laid into sequences of at most `window` tokens without padding.

    ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset``.
    A NULL or empty text is its closing id alone; repeated rows are packed as often as they come; a NULL id
    stays NULL; an empty table has no pieces. Shards hold about `shard_tokens` or `shard_docs`, whichever is less,
    one document at least; rows that repeat are dealt by their number, so that no shard must hold all of them.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    tokens = tokenised(docs, json_path, ranks_path, pattern, id_col, text_col)
    tokens = materialise(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    total = tokens.agg(F.sum(F.octet_length("tokens") / 2).alias("n"), F.count("*").alias("rows")).first()
    found = document_frequencies(tokens) if total.rows else np.zeros(1 << 16)
    idf = np.log(1 + (total.rows - found + 0.5) / (found + 0.5)).astype(np.float32)
    idf[0] = 0
    shards = max(1, math.ceil((total.n or 0) / shard_tokens), math.ceil(total.rows / shard_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            part = pa.Table.from_batches(held)
            texts = [np.frombuffer(t, "<u2") for t in part.column("tokens").to_pylist()]
            del held
            yield _pack(TaskContext.get().partitionId(), part.column("doc_id").combine_chunks(), texts, idf, window)
            del part, texts
            give_back()

    dealt = tokens.repartitionByRange(shards, "near", "doc_id", "row").sortWithinPartitions("near", "doc_id", "tokens")
    return dealt.mapInArrow(run, f"doc_id {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def _digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _packed(docs: DataFrame) -> DataFrame:
    names = public_tokenizers.path
    return pack(docs, names("byte_bpe_50k.json"), names("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left."""
    return _digest(_packed(docs))


@query("op10_retrieval_packing")
def op10(spark, sf_dir):
    return _digest(_packed(table(spark, sf_dir, "documents")))
