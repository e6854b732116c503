import random
import re
import zlib
from collections import Counter

import pytest
from tidemark.llm import variants as V

SCHEMA = "doc_id bigint, text string, word string, n bigint, run string, id string"


def brute_words(docs):
    counts = Counter()
    for i, t in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def single_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    near = {w: [v for v in words if v != w and single_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted([(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()], key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    base = ["".join(rng.choices("abcé", k=rng.randint(5, 9))) for _ in range(60)] + ["STRASSE", "Straße", "naïve", "aaaaa", "aaaaaa", "aaaaaaa", "ababab", "x" * 400, "x" * 399]
    pool = []
    for w in base:
        pool += [w] * rng.choice([3, 6, 13, 40])
        for _ in range(6):
            k = rng.randrange(len(w))
            pool += [rng.choice([w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "é" + w[k + 1 :]])] * rng.randint(1, 7)
    rng.shuffle(pool)
    docs = [(i, " ".join(pool[i::40])) for i in range(40)]
    return docs + [(50, None), (51, ""), (52, "1234 -- \n漢字漢字漢字"), (None, "naïve NAÏVE naïve "), docs[3], docs[3], (53, "Wordy×÷words " * 9), (54, "longer " * 12_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, "r", "i") for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("limit", [512, 4])
def test_variants_equal_brute_force(spark, corpus, monkeypatch, limit):
    # a small limit deals crowded blocks again until one code point is open
    monkeypatch.setattr(V, "BLOCK_WORDS", limit)
    want = brute(brute_words(corpus))
    assert got(V.spelling_variants(frame(spark, corpus))) == want
    assert any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)


def test_long_texts_are_cut_between_runs(spark, corpus, monkeypatch):
    monkeypatch.setattr(V, "PIECE_CHARS", 11)
    assert {r.word: r.n for r in V.vocabulary(frame(spark, corpus)).collect()} == brute_words(corpus)


def test_crowded_block_of_one_half(spark):
    rng = random.Random(2)
    words = sorted({"commonhalf" + "".join(rng.choices("abcdefgh", k=10)) for _ in range(900)})
    words += [w[:-1] + "z" for w in words[:50]] + [w[:12] + w[13:] for w in words[50:90]]
    words = sorted(set(words))
    df = spark.createDataFrame([(w, i + 3) for i, w in enumerate(words)], "word string, n bigint")
    counts = {w: i + 3 for i, w in enumerate(words)}
    near = {}
    for i, a in enumerate(words):
        for b in words[:i]:
            if single_edit(a, b):
                near.setdefault(a, []).append(b)
                near.setdefault(b, []).append(a)
    want = {w: (len(v), max(counts[x] for x in v)) for w, v in near.items()}
    assert {r.word: (r.n_near, r.best_n) for r in V.near_words(df).collect()} == want and len(want) > 80


def test_no_frequent_words(spark):
    assert got(V.spelling_variants(frame(spark, []))) == []
    assert got(V.spelling_variants(frame(spark, [(1, "single words only here")]))) == []


def test_lone_words_stay(spark):
    assert got(V.spelling_variants(frame(spark, [(1, "alone alone alone alone alone")]))) == [("alone", None, "alone", 5, 0, None)]
