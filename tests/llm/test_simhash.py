import random
import re

import xxhash

from tidemark.llm import graph, simhash as S


def mark(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_match_all_pairs(docs, texts):
    marks = [mark(t) for _, t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((texts[i][0] for i in range(len(texts)) if group[i] == g and texts[i][0] is not None), default=None) for g in group}
    want = sorted([(texts[i][0], f"{marks[i]:016x}", least[group[i]]) for i in range(len(texts))], key=str)
    got = sorted([tuple(r) for r in S.near_duplicates(docs).collect()], key=str)
    assert got == want


def test_shards_find_every_link_and_split(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(200)]
    for v in values[:60]:
        for _ in range(3):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                v ^= 1 << bit
            values.append(v)
    values += [(rng.getrandbits(16) << 48) | 0xABC for _ in range(120)]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    want = {}
    label = {v: v for v in signed}

    def top(v):
        while label[v] != v:
            v = label[v]
        return v

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                x, y = top(signed[i]), top(signed[j])
                label[max(x, y)] = min(x, y)
    want = {v: top(v) for v in signed if any(top(o) == top(v) for o in signed if o != v)}
    for limit in (4096, 4):
        got = {r.node: r.root for r in graph.components(S.links(df, shard_rows=limit)).collect()}
        assert got == want


def test_tree_follows_edges_within_the_radius():
    rng = random.Random(9)
    tree, values = S.BKTree(), [rng.getrandbits(12) for _ in range(300)]
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (1, 0)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {" ".join(w)} - {""}


def jaccard_components(rows):
    """Smallest id of each row's component, all pairs compared."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (doc, _) in zip(group, rows):
        known = [x for x in (doc, least.get(g)) if x is not None]
        least[g] = min(known, default=None)
    return sorted(((doc, least[g]) for g, (doc, _) in zip(group, rows)), key=str)


def drift(rng, words, n):
    """Copies of a text with ever more words replaced."""
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.getrandbits(40)}"
    return " ".join(out)


def test_similar_documents_match_all_pairs(docs, texts, empty):
    got = sorted((tuple(r) for r in S.similar_documents(docs).collect()), key=str)
    assert got == jaccard_components(texts)
    assert S.similar_documents(empty).count() == 0


def test_recall_at_the_threshold_and_hot_shards(spark):
    rng = random.Random(11)
    rows, boiler = [], [f"b{i}" for i in range(60)]
    for _ in range(150):
        words = [f"w{rng.getrandbits(40)}" for _ in range(rng.randint(60, 240))]
        rows += [" ".join(words), drift(rng, words, max(1, len(words) // rng.randint(46, 80)))]
    source = [f"w{rng.getrandbits(40)}" for _ in range(200)]
    rows += [drift(rng, source, rng.randint(1, 4)) for _ in range(150)]
    rows += [" ".join(boiler + [f"w{rng.getrandbits(40)}" for _ in range(120)]) for _ in range(120)]
    rows = list(enumerate(rows))
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    pairs = [(i, j) for i, j in links if i < 300]
    assert len(pairs) > 60 and len(links) > 1000
    want = dict(jaccard_components(rows))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for limit in (512, 8):
        got = {r.doc_id: r.component_id for r in S.similar_documents(df, shard_rows=limit).collect()}
        assert all(want[d] == want[c] for d, c in got.items())
        for some in (pairs, links):
            assert sum(got[i] == got[j] for i, j in some) >= 0.9 * len(some)


def test_no_link_is_missed_whatever_the_trees_find(spark):
    rng = random.Random(23)
    rows = []
    for _ in range(120):
        words = [f"w{rng.getrandbits(40)}" for _ in range(rng.randint(4, 150))]
        rows += [" ".join(words), drift(rng, words, max(1, len(words) // rng.randint(40, 70))), " ".join(words + words[-1:])]
    rows += [" ".join([f"b{i}" for i in range(80)] + [f"w{rng.getrandbits(40)}" for _ in range(rng.randint(1, 12))]) for _ in range(60)]
    rows += ["one two", "One  two", "a a a a a", "a a a a a a a", "", None]
    rows = list(enumerate(rows))
    want = jaccard_components(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    # a radius of zero leaves nearly all links to the exact search, shards of 8 cut the large groups
    for radius, limit in ((0, 512), (16, 8)):
        got = S.similar_documents(df, radius=radius, shard_rows=limit)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_long_lists_are_walked_in_blocks(spark):
    rng = random.Random(3)
    bases = [[v << 26 for v in rng.sample(range(40), 12)] for _ in range(8)]
    sets = [sorted(rng.sample(rng.choice(bases), rng.randint(9, 12))) for _ in range(200)]
    df = spark.createDataFrame([(i, S.np.array(s, S.np.uint32).tobytes()) for i, s in enumerate(sets)], "cid bigint, bag binary")
    placed = spark.createDataFrame([(i, i // 2) for i in range(200)], "cid bigint, top bigint")
    want = {(i, j) for j in range(200) for i in range(j) if i // 2 != j // 2 and 5 * len({*sets[i]} & {*sets[j]}) >= 4 * len({*sets[i]} | {*sets[j]})}
    for at_once, per_part in ((1_000_000, 400_000), (7, 50)):
        got = S.missed_links(df, placed, at_once=at_once, per_part=per_part).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 20


def test_stage_keeps_one_of_each(spark, docs, empty):
    out = S.stage(spark, docs, "")
    groups = {r.component_id for r in S.similar_documents(docs).collect()}
    # two texts share the id 3 and are each the first of their own component
    assert out.columns == docs.columns and out.count() == len(groups) + 1
    assert S.stage(spark, empty, "").count() == 0
