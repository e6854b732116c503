import numpy as np
import pytest

from tidemark.llm import vectors as V


def rows():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(150, 64))
    near = [b + rng.normal(size=64) * s for b in base[:30] for s in (0.05, 0.2, 0.33)]
    hub = [base[0] * 3 + rng.normal(size=64) * 0.15 for _ in range(80)]
    vectors = [v.astype(np.float32).tolist() for v in [*base, *near, *hub]]
    vectors += [vectors[4], vectors[4], (2 * np.array(vectors[5])).tolist()]
    out = list(enumerate(vectors))
    out += [(500, None), (501, []), (502, [0.0] * 64), (503, [float("nan")] * 64), (504, [None] + [1.0] * 63), (505, [float("inf")] + [1.0] * 63), (506, [1.0, 2.0]), (None, vectors[7])]
    return out


@pytest.mark.parametrize("tile", [16_384, 16])
def test_links_match_all_pairs(spark, tile):
    data = rows()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id bigint, embedding array<float>, cid string, n int").repartition(3)
    good = [k for k, (_, v) in enumerate(data) if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([np.array(data[k][1], np.float32) for k in good], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    label = list(range(len(good)))
    for i, j in zip(*np.nonzero(near)):
        if label[i] != label[j]:
            old, new = label[i], label[j]
            label = [new if x == old else x for x in label]
    least = {g: min((data[good[i]][0] for i in range(len(good)) if label[i] == g and data[good[i]][0] is not None), default=None) for g in label}
    want = {data[k][0]: (0, data[k][0], True) for k in range(len(data)) if k not in good}
    for i, k in enumerate(good):
        want[data[k][0]] = (int(near[i].sum()) - 1, least[label[i]], data[k][0] == least[label[i]])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_duplicates(df, tile=tile).collect()}
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert V.near_duplicates(df).count() == 0


def test_every_length_is_joined_and_lengths_do_not_meet(spark):
    rng = np.random.default_rng(3)
    data = []
    for dims in (1, 2, 3, 8, 13):
        for _ in range(6):
            v = rng.normal(size=dims)
            data += [v, v * 2 + rng.normal(size=dims) * 0.05, v * 0.5]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    got = {r.vec_id: r.n_links for r in V.near_duplicates(spark.createDataFrame(data, "vec_id bigint, embedding array<double>")).collect()}

    def linked(u, v):
        return len(u) == len(v) and np.dot(u, v) / np.sqrt(np.dot(u, u)) / np.sqrt(np.dot(v, v)) >= 0.95

    assert got == {i: sum(linked(u, v) for j, v in data if j != i) for i, u in data}


def test_sure_links_travel_as_a_forest():
    rng = np.random.default_rng(5)
    left, right = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    n = rng.integers(1, 5, 80)
    n[40:] = n[:40]
    forest = V._Forest(np.tile(np.arange(40) * 3, 2), n)
    for i in range(0, 300, 50):
        forest.add(left[i : i + 50], right[i : i + 50] + 40)
    edges = np.concatenate(forest.edges, axis=1)
    assert edges.shape[1] == 40 - len(set(forest.top.tolist()))
    want = np.bincount(left, n[right], 40) + np.bincount(right, n[left], 40)
    assert forest.weight.tolist() == want.tolist()
