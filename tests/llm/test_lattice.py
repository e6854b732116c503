import itertools
import math
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece

from tidemark.llm import lattice as L

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return L.vocabulary(MODEL)


def segmentations(vocab, word, at=0):
    if at == len(word):
        yield (), 0.0
        return
    single = False
    for end in range(at + 1, min(len(word), at + vocab.longest) + 1):
        piece = word[at:end]
        if piece in vocab.score:
            single |= end == at + 1
            for rest, score in segmentations(vocab, word, end):
                yield (vocab.pieces[piece], *rest), score + vocab.score[piece]
    if not single:
        ids = vocab.fallback(word[at])
        for rest, score in segmentations(vocab, word, at + 1):
            yield (*ids, *rest), score + vocab.unknown * len(ids)


def table(vocab, text):
    out = {}
    for parts in itertools.product(*[list(segmentations(vocab, w)) for w in L.words(text)]):
        out[tuple(i for ids, _ in parts for i in ids)] = sum(s for _, s in parts)
    top = max(out.values())
    total = top + math.log(sum(math.exp(s - top) for s in out.values()))
    return {k: s - total for k, s in out.items()}


def test_probabilities_and_whole_enumeration(vocab):
    for text in ("in it", "the a\nb", "x🙂"):
        want = table(vocab, text)
        lat, drawn = L.top_segmentations(vocab, [text], [5], 500)
        got = {tuple(L.piece_ids(lat, e).tolist()): (lp, inc) for e, lp, _, inc in drawn[0]}
        assert set(got) == set(want)
        assert all(abs(got[k][0] - want[k]) < 1e-9 and got[k][1] == 0 for k in want)


def test_sampling_is_without_replacement_and_weighted(vocab):
    text = "in it"
    want = {k: math.exp(v) for k, v in table(vocab, text).items()}
    n, first, second, weight = 6000, Counter(), Counter(), Counter()
    lat, drawn = L.top_segmentations(vocab, [text] * n, [(i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for i in range(n)], 2)
    for samples in drawn:
        ids = [tuple(L.piece_ids(lat, e).tolist()) for e, *_ in samples]
        assert len(set(ids)) == 2 and samples[0][2] >= samples[1][2]
        first[ids[0]] += 1
        second[ids[1]] += 1
        for key, (_, lp, _, inc) in zip(ids, samples):
            weight[key] += math.exp(lp - inc) / n
    for key, p in want.items():
        assert abs(first[key] / n - p) < 0.025
        after = sum(q * p / (1 - q) for k, q in want.items() if k != key)
        assert abs(second[key] / n - after) < 0.025
        if p > 0.02:  # the inclusion scores make the sample unbiased
            assert abs(weight[key] - p) < 0.03


def test_words_spell_the_text_as_the_model_does():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ("a  b", " a\nb ", "\n", "é 漢", "tab\tx"):
        assert "".join(L.words(text)) == model.normalize(text).replace(" ", L.SPACE) or model.normalize(text)[0] == L.SPACE and "".join(L.words(text)) == model.normalize(text)


def test_round_trip_seeds_and_awkward_rows(docs, texts, empty):
    coded = L.sample_encode(docs, MODEL, k=3)
    rows = coded.collect()
    back = Counter((r.doc_id, r.text) for r in L.decode(coded, MODEL).filter("sample = 1").collect())
    assert back == Counter((i, t or "") for i, t in texts)
    again = {(r.doc_id, r.sample, len(r.ids)): r.ids for r in L.sample_encode(docs.repartition(5), MODEL, k=3).collect()}
    assert all(again[r.doc_id, r.sample, len(r.ids)] == r.ids for r in rows)
    assert [r["ids"] for r in rows if r.doc_id == 101] == [[]]
    by = {}
    for r in rows:
        if r.doc_id in (1, 105):
            by.setdefault(r.doc_id, []).append(tuple(r["ids"]))
    assert all(len(set(v)) == 3 for v in by.values())
    assert L.sample_encode(empty, MODEL).count() == 0
