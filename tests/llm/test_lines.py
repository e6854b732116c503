import re

import numpy as np
import pytest

from tidemark.llm import lines as L


def expected(texts):
    """Removed line numbers per (id, text), in order of id and text hash; ties by hash are left to the caller."""
    seen, out = [], {}
    for i, t in texts:
        if (i, t) in out:
            continue
        gone = []
        for n, line in enumerate((t or "").split("\n")):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if not words:
                continue
            if any(len(words & s) >= 0.8 * len(words | s) - 1e-9 for s in seen):
                gone.append(n)
            seen.append(words)
        out[i, t] = gone
    return out


@pytest.mark.parametrize("most, at_once", [(L.FIRST, L.PAIRS_AT_ONCE), (1, 3)])
def test_removed_lines_match_all_pairs(docs, texts, most, at_once):
    once = sorted({(i, t or "") for i, t in texts if i is not None and i != 3}, key=lambda r: r[0])
    want = expected(once)
    chosen = docs.filter("doc_id IS NOT NULL AND doc_id <> 3")
    got = {}
    for r in L.repeated_lines(chosen, most=most, at_once=at_once).collect():
        got.setdefault(r.doc_id, []).append(r.removed)
    assert {i: [g] for (i, _), g in want.items()} == {i: v[:1] for i, v in got.items()}
    assert len(got[2]) == 3 and got[2][0] == got[2][1]


@pytest.mark.parametrize("most, at_once", [(0, L.PAIRS_AT_ONCE), (1, 10)])
def test_similar_variants_of_one_line(spark, most, at_once):
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base[:i] + [f"own{i}"] + base[i + 1 :])) for i in range(40)] + [(50, "alpha beta gamma delta"), (51, "alpha beta gamma delta epsilon"), (52, "alpha beta gamma")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: len(r.removed) for r in L.repeated_lines(df, most=most, at_once=at_once).collect()}
    assert got == {i: int(0 < i < 40 or i == 51) for i, _ in rows}


@pytest.mark.parametrize("most, at_once", [(L.FIRST, L.PAIRS_AT_ONCE), (1, 3)])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_drifting_lines_match_the_line_before(spark, kind, most, at_once):
    # each line shares 18 of 22 words with the one before it and too few with all others
    drift = lambda c, n: ["\n".join(" ".join(f"c{c}w{i}" for i in range(2 * step, 2 * step + 20)) for step in range(n))]
    whole = [(i, "\n".join(sum((drift(100 * i + c, 3) for c in range(40)), []))) for i in range(3)]
    spread = [(10 + step, "\n".join(drift(1000 + c, 5)[0].split("\n")[step] for c in range(40))) for step in range(5)]
    rows = [(f"{i:03d}" if kind == "string" else i, t) for i, t in whole + spread]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)
    got = {r.doc_id: r.removed for r in L.repeated_lines(df, most=most, at_once=at_once).collect()}
    assert got == {i: gone for (i, _), gone in expected(rows).items()}


def test_stage_keeps_rows_and_columns(spark, docs, empty):
    out = L.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {(r.doc_id, r.text) for r in out.filter("doc_id IN (100, 102, 103)").collect()}
    assert rows == {(100, None), (102, " \n\t\r\n "), (103, "one")}
    assert out.filter("doc_id = 110").first().text.count("SAME LINE HERE") == 1
    assert L.stage(spark, empty, "").count() == 0 and L.repeated_lines(empty).count() == 0


def test_short_words_lose_no_pair_and_rule_most_others_out(spark):
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) << np.uint64(1))
    pool[:60] = (pool[:60] & np.uint64((1 << 48) - 1)) | np.uint64(7 << 48)  # many words agree in their first two bytes
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in rng.integers(1, 40, 30)]
    sets += [np.sort(np.append(s[1:], rng.choice(np.setdiff1d(pool, s)))) for s in sets] + [np.sort(pool[:20]), np.sort(pool[20:40])]
    df = spark.createDataFrame([(i, 0, 0, 0, s.tobytes()) for i, s in enumerate(sets)], "cid bigint, doc_id int, _h int, line int, words binary").repartition(3)
    every = [(i, j) for j in range(len(sets)) for i in range(j)]
    match = {(i, j) for i, j in every if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9}
    got = {(r.a, r.b) for r in L._plausible(spark.createDataFrame(every, "a bigint, b bigint"), df, 0.8).collect()}
    assert match and match <= got and len(got) < len(every) / 10
    # twenty words that agree in two bytes are told apart by the whole sets only
    assert (60, 61) in got and (60, 61) not in match


@pytest.mark.parametrize("most, at_once", [(L.FIRST, L.PAIRS_AT_ONCE), (0, 50)])
def test_long_lines_of_one_vocabulary_make_few_pairs_and_lose_none(spark, monkeypatch, most, at_once):
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.choice(1500, n, replace=False)
    lines = [fresh(n) for n in np.repeat([60, 68, 140, 155, 320, 340], 25)]
    # the lengths of these pairs lie on both sides of the bounds at which sketches grow
    lines += [np.append(a, np.setdiff1d(fresh(200), a)[: max(1, len(a) // 10)]) for a in lines[::5]]
    rows = [(i, " ".join(f"w{w}" for w in line)) for i, line in enumerate(lines)]
    made = {}
    keep = L.materialise_at

    def noted(df, purpose):
        made[purpose] = keep(df, purpose)
        return made[purpose]

    monkeypatch.setattr(L, "materialise_at", noted)
    monkeypatch.setattr(L, "discard", lambda spark, path: None)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.removed for r in L.repeated_lines(df, most=most, at_once=at_once).collect()}
    assert got == {i: gone for (i, _), gone in expected(rows).items()}
    assert sum(map(len, got.values())) == 30
    if most:
        assert made["candidates"][0].filter("kind = 0").select("a", "b").distinct().count() <= 60
