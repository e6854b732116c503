import numpy as np
import pyarrow as pa

from tidemark.llm import scoring as S


def test_counts_cover_all_words(docs, texts):
    import re

    want = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in texts)
    got = S.word_counts(docs).toPandas()
    assert got["n"].sum() == want


def test_shares_and_class_probabilities_sum_to_one(docs):
    units = S.fit_units(docs)
    total = np.bincount(units.kind, np.exp(units.log_share), S.CLASSES)
    assert np.allclose(total[total > 0], 1, atol=1e-3)
    logs = S.WindowNet().forward(np.zeros((3, 2 * S.SIDE), int))[2]
    assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-5)


def test_gradient_matches_differences():
    net = S.WindowNet()
    rng = np.random.default_rng(0)
    window, kind = rng.integers(0, 50, (40, 2 * S.SIDE)), rng.integers(0, 8, 40)
    loss = lambda n: -n.forward(window)[2][np.arange(40), kind].astype(np.float64).mean()
    before = net.flat.copy()
    net.learn(window, kind, rate=0.0)
    grads = net.grads.copy()
    for i in [0, 17, 49 * S.DIMS + 3, len(before) - 1, len(before) - 200]:
        up, down = before.copy(), before.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert abs((loss(S.WindowNet(up)) - loss(S.WindowNet(down))) / 2e-2 - grads[i]) < 1e-3


def test_training_beats_unigrams_on_texts_held_out(spark):
    rng = np.random.default_rng(4)

    def text():  # each word is followed by its partner, so both sides tell
        return " ".join(f"{w} p{w}" for w in rng.integers(0, 30, 60))

    rows = [(i, text()) for i in range(400)]
    fit = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    held = spark.createDataFrame([(i, text()) for i in range(40)] + [(90, None), (91, " \n")], "doc_id bigint, text string")
    units = S.fit_units(fit)
    blank = S.WindowNet(np.zeros(len(S.WindowNet().flat)))
    mean = lambda net: S.score(held, units, net).filter("n_tokens > 0").toPandas().mean_log_likelihood.mean()
    assert mean(S.train(fit, units, rounds=2)) > mean(blank) + 0.2
    rows = {r.doc_id: r for r in S.score(held, units, blank).collect()}
    assert (rows[90].n_tokens, rows[90].log_likelihood, rows[90].mean_log_likelihood) == (0, 0.0, None)


def test_a_wrong_word_of_the_same_class_scores_less(spark):
    rng = np.random.default_rng(6)
    text = lambda: " ".join(f"{w} p{w}" for w in rng.integers(0, 100, 80))
    fit = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id bigint, text string").repartition(2)
    units = S.fit_units(fit)
    token = {w: int(S._windows(units, pa.array([w]))[0][0]) for i in range(100) for w in (f"{i}", f"p{i}")}
    net = S.train(fit, units, rounds=6)
    tokens, window, _ = S._windows(units, pa.array([text() for _ in range(60)]))
    # the same windows, another partner of the same class in the place of each partner
    partners = [token[f"p{i}"] for i in range(100)]
    others = {t: [o for o in partners if units.kind[o] == units.kind[t] and o != t] for t in partners}
    places = np.array([i for i, t in enumerate(tokens.tolist()) if others.get(t)])
    wrong = np.array([rng.choice(others[t]) for t in tokens[places].tolist()])
    mean = lambda t: net.token_logs(window[places], t, units, units.members()).mean()
    assert len(places) > 1000 and mean(tokens[places]) > mean(wrong) + 0.3
    # with the unigram share in place of the network's choice within the class, both would score alike
    assert abs(units.log_share[tokens[places]].mean() - units.log_share[wrong].mean()) < 0.1


def test_gradient_within_the_class_matches_differences():
    rng = np.random.default_rng(1)
    size = S.WORDS + S.BUCKETS
    units = S.Units(np.zeros(0, np.uint64), np.arange(size) % S.CLASSES, np.log(np.full(size, S.CLASSES / size, np.float32)))
    members = units.members()
    net = S.WindowNet()
    net.parts[3][:] = rng.normal(0, 0.1, net.parts[3].shape)
    window, tokens = rng.integers(0, 50, (40, 2 * S.SIDE)), rng.integers(0, 200, 40)
    logs = net.token_logs(np.repeat(window[:1], size, 0), np.arange(size), units, members)
    assert np.isclose(np.exp(logs).sum(), 1, atol=1e-4)
    before = net.flat.copy()
    net.learn(window, units.kind[tokens], 0.0, tokens, units, members)
    loss = lambda flat: -S.WindowNet(flat).token_logs(window, tokens, units, members).mean()
    first = (size + 1) * S.DIMS + 2 * S.SIDE * S.DIMS * S.HIDDEN + S.HIDDEN
    for i in [17, 49 * S.DIMS + 3, (size + 1) * S.DIMS + 5, first + int(tokens[0]) * S.HIDDEN + 2, first + int(tokens[9]) * S.HIDDEN, len(before) - 1]:
        up, down = before.copy(), before.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - net.grads[i]) < 1e-3


def test_score_is_the_sum_over_tokens_alone_or_in_a_batch(docs, texts):
    units, net = S.fit_units(docs), S.WindowNet()
    whole = S.score(docs.filter("doc_id IN (1, 5, 9)"), units, net).toPandas().set_index("doc_id")
    for i in (1, 5, 9):
        one = S.score(docs.filter(f"doc_id = {i}"), units, net).first()
        assert abs(one.log_likelihood - whole.log_likelihood[i]) < 1e-3 and one.n_tokens == whole.n_tokens[i]


def test_empty_table_and_repeated_rows(docs, empty):
    assert S.pseudo_likelihood(empty).count() == 0
    out = S.pseudo_likelihood(docs).filter("doc_id = 2").collect()
    assert len(out) == 3 and abs(out[0].log_likelihood - out[1].log_likelihood) < 1e-3
