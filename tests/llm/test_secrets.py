import re
from collections import Counter

import numpy as np

from tidemark.llm import secrets as S


def base(text):
    text = text or ""
    word = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([word("password"), word("passwd"), word("secret"), word("token"), f"{word('api')}_?{word('key')}"])
    rules = [(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
             (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m))


def test_base_spans_stand_with_and_without_a_network(docs, texts):
    extra = [(900 + i, t) for i, t in enumerate(["toKen:'abcdefg'", "ſecret=abcdef", "token=abc secret = 'x1y2z3'", "a" * 40, "AKIA" + "Z" * 15, "pass word=abcdef"])]
    df = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(extra, "doc_id bigint, text string"))
    want = Counter((i, tuple(base(t))) for i, t in texts + extra)
    for net in (None, S.new_net()):
        rows = S.scan_secrets(df, net).collect()
        found = lambda r: tuple((f["start"], S.KINDS.index(f["kind"]), f["end"]) for f in r.findings if f["kind"] != "model")
        assert Counter((r.doc_id, found(r)) for r in rows) == want


def test_network_learns_secrets_that_no_pattern_names(spark):
    rng = np.random.default_rng(2)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    prose = lambda: " ".join(draw("abcdefghilmnoprstu", int(rng.integers(3, 22))) for _ in range(30))
    rows = [(i, f'{prose()} token = "{draw("0123456789abcdef", 40)}" {prose()}') for i in range(150)] + [(200 + i, prose()) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    net = S.train(docs, rows=400)
    unseen = [prose() + " " + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 36) + " " + prose() for _ in range(60)]
    clean = [prose() for _ in range(60)]
    caught = [any(k == 3 for _, k, _ in spans) for spans in S._scan(unseen, net)]
    wrong = [any(k == 3 for _, k, _ in spans) for spans in S._scan(clean, net)]
    assert np.mean(caught) >= 0.85 and np.mean(wrong) <= 0.1
    again = S.train(docs.repartition(5), rows=400)
    assert np.array_equal(net.table, again.table) and net.threshold == again.threshold


def test_threshold_keeps_the_recall_where_labels_are_hard_to_tell():
    rng = np.random.default_rng(9)
    codes, labels = rng.integers(2, 97, (600, S.WIDTH)).astype(np.uint8), (np.arange(600) % 3 == 0).astype(float)
    net = S.new_net()
    net.calibrate(codes, labels, 0.98)
    flagged = net.scores(codes) >= net.threshold
    assert flagged[labels == 1].mean() >= 0.98 and net.recall == flagged[labels == 1].mean()
    assert net.precision == labels[flagged].mean()


def test_every_part_of_a_long_candidate_is_read():
    key = "QZ7"
    net = S.new_net()
    net.table[:], net.weights[:], net.offset = -1, 0, -4.0
    for k, c in enumerate(key):  # fires where the three characters follow each other inside a candidate
        net.table[k] = -1
        net.table[k, ord(c) - 30, 0] = 3
    net.table[len(key) :] = 0
    net.weights[1, 0] = 1
    for at in range(0, 198):
        text = "see " + "g" * at + key + "g" * (197 - at) + " end"
        assert S._scan([text], net) == [[(4, 3, 204)]], at
    assert S._scan(["see " + "g" * 200 + " end"], net) == [[]]
    run = "0123456789abcdef01234567"
    assert S._scan([f"x {run}_{key}_G x"], net) == [[(2, 2, 26), (2, 3, 32)]]
    assert S._scan([f"x {run} x"], net) == [[(2, 2, 26)]]
    for s, e in [(0, 16), (3, 43), (0, 44), (5, 205), (0, 1000)]:
        cut = S.views(s, e)
        assert {i for a, b in cut for i in range(a, b)} == set(range(s, e)) and max(b - a for a, b in cut) <= S.INSIDE


def test_stage_redacts_and_keeps_the_rest(spark, docs, empty):
    out = S.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("doc_id = 112").first().text == "[secret] end".replace("[secret]", '[secret]"', 1)
    assert out.filter("doc_id = 100").first().text is None
    assert S.train(empty) is None and S.stage(spark, empty, "").count() == 0


def test_every_labelled_candidate_is_fitted_on(spark, monkeypatch):
    rng = np.random.default_rng(4)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    rows = [(i, f'token = "{draw("0123456789abcdef", 40)}" and {draw("abcdefghilmnoprstu", 20)} end') for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(S, "HELD_WINDOWS", 10)
    counts = {r["label"]: r["count"] for r in S.labelled(docs).groupBy("label").count().collect()}
    assert counts == {0: 90, 1: 90}
    net, again = S.train(docs, rows=30), S.train(docs.repartition(4), rows=30)
    assert np.array_equal(net.flat(), again.flat()) and net.threshold == again.threshold and net.recall >= 0.98
