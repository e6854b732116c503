import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import trie as T

TURNS = "conv_id bigint, turn bigint, role string, text string, depth int, n bigint, d1 bigint, tier int"


def own_turns(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in convs.items()}


def rebuild(convs):
    out = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + ts[h:]
    return out


def brute(convs):
    nodes = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p and q for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(path)))
        children = sum(1 for p in below if len(p) == len(path) + 1)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for c in [*range(0, 40), *range(100, 130), *range(201, 215), 5, 777]:
        out += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "c 🙂", "", None, "x" * 50])) for t in range(rng.randint(1, 9))]
    for c in range(300, 330):  # one first turn, one whole conversation
        out += [(c, 0, "system", "be brief"), (c, 1, "user", "hi"), (c, 2, "user", "same" if c % 2 else f"own {c}")]
    out += [(None, 0, "user", "nobody's"), (400, None, None, None), (401, 3, "user", "late"), (401, None, "user", "early"), (402, 1, "user", "twice"), (402, 1, "user", "twice")]
    out += [(1000, t, "user", f"turn {t}") for t in range(300)] + [(100, 99, "user", "y" * 40_000)]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, 9, 9) for r in rows], TURNS)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_rebuilt_trie_equals_brute_force(spark, rows, monkeypatch):
    # small tiers: fragments hand their sums over several times
    monkeypatch.setattr(T, "TIER", 5)
    own = T.numbered(frame(spark, rows))
    assert got(T.prefix_trie(T.rebuilt(own))) == brute(rebuild(own_turns(rows)))


def test_whole_conversations(spark, rows):
    assert got(T.prefix_trie(T.whole(T.numbered(frame(spark, rows))))) == brute(own_turns(rows))


def test_turnless_conversations_are_members_of_the_root(spark):
    absent = next(c for c in range(501, 600) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(absent, 0, "user", "taken away"), (0, 0, "user", "kept")]
    assert got(T.prefix_trie(T.rebuilt(T.numbered(frame(spark, rows))))) == brute(rebuild(own_turns(rows)))
    only = got(T.prefix_trie(T.rebuilt(T.numbered(frame(spark, rows[:1])))))
    assert only == [(absent, 0, None, 1, 0, 1, 0, hashlib.sha256(str(absent).encode()).hexdigest())]


def test_no_rows(spark):
    assert got(T.prefix_trie(T.rebuilt(T.numbered(frame(spark, []))))) == []
    assert got(T.prefix_trie(T.whole(T.numbered(frame(spark, [(None, 0, "user", "x")]))))) == []


def test_slots_are_minimal_and_checked():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 1 << 63, 20_000).astype(np.uint64), rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    hi[:500] = 7  # digests that agree in half
    slots = T.SlotTable(hi, lo)
    assert np.array_equal(np.sort(slots.slots), np.arange(20_000))
    assert np.array_equal(slots.find(hi, lo), slots.slots)
    assert (slots.find(hi, lo + np.uint64(1)) == -1).all()
    assert len(T.SlotTable(hi[:0], lo[:0]).find(hi[:3], lo[:3])) == 3
    with pytest.raises(ValueError):
        T.SlotTable(hi[[1, 1]], lo[[1, 1]])


def test_list_of_ends_is_hashed_over_pieces(spark):
    rows = [(c, 0, "user", "all the same") for c in range(2_500)]
    out = got(T.prefix_trie(T.whole(T.numbered(frame(spark, rows)))))
    ids = ",".join(map(str, range(2_500)))
    assert out[1][-1] == hashlib.sha256(ids.encode()).hexdigest() and out[1][:7] == (0, 1, 0, 2_500, 0, 1, 2_499 * 12)
