import numpy as np
import pytest

from tidemark.llm import suffixes as S


def expected(texts, length):
    blobs = [(t or "").encode() for _, t in texts]
    count = {}
    for b in blobs:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for (i, _), b in zip(texts, blobs):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = True
        out.append((i, len(b), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


@pytest.mark.parametrize("classes", [2000, 1, 0])
def test_kept_bytes_match_all_windows(docs, texts, monkeypatch, classes):
    monkeypatch.setattr(S.repeated_spans, "__defaults__", (S.LENGTH, S.ANCHOR, classes))
    got = sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in S.remove_repeats(docs).collect()), key=str)
    assert got == expected(texts, 400)


def test_empty_table(empty):
    assert S.remove_repeats(empty).count() == 0


def test_intervals_report_all_occurrences_of_maximal_repeats():
    rng = np.random.default_rng(1)
    core = bytes(rng.integers(97, 123, 30, dtype=np.uint8))
    texts = [bytes(rng.integers(65, 91, 20, dtype=np.uint8)) + core + bytes([48 + i]) * 3 for i in range(5)]
    texts.append(b"qq" + core + b"00" + b"tail")
    array = S.EnhancedSuffixArray(texts, np.array([len(t) - 7 for t in texts]))
    found = {size: sorted(p.tolist()) for size, p in array.repeats(8)}
    assert len(found[30]) == 6 and len(found[32]) == 2
    data = b"".join(texts)
    assert all(len({data[p : p + size] for p in places}) == 1 for size, places in found.items())


def test_suffix_order_and_prefixes():
    texts = [b"banana" * 40, b"bandana" * 30]
    counts = np.array([200, 180])
    array = S.EnhancedSuffixArray(texts, counts)
    data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
    tails = [data[p : ends[t]] for p, t in zip(array.suffix.tolist(), array.text.tolist())]
    for a, b, n in zip(tails, tails[1:], array.common.tolist()):
        size = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == size
