import time

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing as K

PATHS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATHS[0])


def test_words_encode_as_the_tokenizer_does(tokenizer, texts):
    awkward = ["  two  spaces", "a \n b", "\n\n\nx", " lead", "trail ", "tab\tbetween", "don't we'll", "x<|endoftext|> y", "a b  c", "1234 ½ ²", "\x1c a", "é́  z", "a\x85 b", "..... !?", "\r\n x"]
    encoder = K.WordEncoder(*PATHS)
    for text in awkward + [t or "" for _, t in texts]:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text[:80])


@pytest.mark.parametrize("shard", [K.SHARD_TOKENS, 3000])
def test_every_id_lies_in_one_piece(docs, texts, tokenizer, shard):
    rows = K.pack(docs, *PATHS, shard_tokens=shard).collect()
    whole = sorted(([i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]] for i, t in texts), key=str)
    pieces, used = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r.length
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(len(w) for _, w in whole)
    assert sum(r.length for r in rows) == total
    for i, ids in whole:
        own = pieces[i, len(ids)]
        assert all(ids[s : s + len(p)] == p for s, p in own) or i in (None, 3)
        assert {x for s, p in own for x in range(s, s + len(p))} == set(range(len(ids)))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0


def test_neighbours_fill_the_window_of_their_seed():
    rng = np.random.default_rng(3)
    topics = [rng.integers(1000 * t + 1, 1000 * t + 60, (6, 300)) for t in range(1, 6)]
    docs = [d.astype(np.uint16) for i in range(6) for d in (t[i] for t in topics)]
    idf = np.ones(1 << 16, np.float32)
    order = K.order_of(docs, idf, 1024)
    assert sorted(order) == list(range(30))
    same = sum(a % 5 == b % 5 for a, b in zip(order, order[1:]))
    assert same >= 22


def test_scores_count_every_term_of_the_seed():
    rng = np.random.default_rng(5)
    shared = rng.choice(np.arange(2000, 3000), 150, replace=False)
    docs = [np.append(shared, np.arange(100, 130)), np.append(shared, np.arange(200, 230))]  # oddest terms differ
    docs += [np.append(rng.integers(1, 900, int(rng.integers(20, 300))), [7, 0]) for _ in range(40)]
    docs = [d.astype(np.uint16) for d in docs]
    found = np.zeros(1 << 16)
    for d in docs:
        found[np.unique(d)] += 1
    idf = np.log(1 + (len(docs) - found + 0.5) / (found + 0.5)).astype(np.float32)
    idf[0] = 0
    index, mean = K.Index(docs, idf), np.mean([len(d) for d in docs])
    for seed in range(len(docs)):
        want = [sum(idf[t] * n * (K.K1 + 1) / (n + K.K1 * (1 - K.B + K.B * len(d) / mean)) for t, n in zip(*np.unique(d, return_counts=True)) if t in docs[seed]) for d in docs]
        assert np.allclose(index.scores(seed), want, rtol=1e-4)
    assert index.scores(0)[1] > index.scores(0)[2:].max()


def test_batches_encode_as_single_texts_do(texts):
    encoder = K.WordEncoder(*PATHS)
    awkward = ["", " ", "a", " a", "a ", "\na b", "a b\n", "a\u3000b", "a \u3000b", "a\u200bb c", "x" * 3000 + " y", "", "a b\x1cc"]
    rows = awkward + [t or "" for _, t in texts] + awkward
    got = encoder.encode_batch(K.pa.array(rows, K.pa.string()))
    assert got == [encoder._plain(t) if "<|endoftext|>" not in t else encoder.encode(t) for t in rows]


def test_many_short_texts_are_ordered_in_linear_time():
    rng = np.random.default_rng(11)
    idf = np.ones(1 << 16, np.float32)
    for docs in (list(rng.integers(1, 60_000, (60_000, 2)).astype(np.uint16)), [np.zeros(1, np.uint16)] * 60_000):
        began = time.process_time()
        assert sorted(K.order_of(docs, idf, 1024)) == list(range(60_000))
        assert time.process_time() - began < 20


def test_repeated_rows_fill_more_than_one_shard(spark):
    df = spark.createDataFrame([(None, None)] * 50 + [(7, "same words")] * 50, "doc_id bigint, text string")
    rows = K.pack(df, *PATHS, shard_docs=10).collect()
    assert sum(r.length for r in rows) == 50 + sum(r.length for r in rows if r.doc_id == 7)
    assert len({r.sequence_id >> 33 for r in rows}) > 5


def test_empty_table(empty):
    assert K.pack(empty, *PATHS).count() == 0
