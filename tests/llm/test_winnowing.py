import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import winnowing as W
from tidemark.llm.common import ascii_lower

ITEMS = "item_id bigint, text string, words string, span string, size int, mark bigint"


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, window=10):
    out = []
    spans = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for j in range(len(w) - n + 1 if n else 0):
            spans.setdefault(tuple(w[j : j + n]), set()).add("" if i is None else str(i))
    for i, t in docs:
        w, hit, seen = words(t), set(), set()
        for n in {len(s) for s in spans}:
            for j in range(len(w) - n + 1):
                if (s := spans.get(tuple(w[j : j + n]))) is not None:
                    hit.update(range(j, j + n))
                    seen |= s
        out.append((i, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    out = W.decontaminate(docs, spark.createDataFrame([(i, t, "w", "s", 1, 1) for i, t in items], ITEMS), **kw)
    return sorted([tuple(r) for r in out.collect()], key=str)


@pytest.fixture(scope="module")
def items(texts):
    rng = random.Random(9)
    taken = [(i, t) for i, t in texts if t and len(words(t)) > 40][:8]
    out = []
    for k, (_, t) in enumerate(taken):
        w = t.split(" ")
        a = rng.randrange(len(w) - 20)
        out.append((k, " ".join(w[a : a + rng.randint(9, 30)]).upper()))
    out += [(50, "one"), (51, "one TWO"), (52, "Ünï cödé 漢字"), (53, None), (54, ""), (55, "..."), (56, "same line here same line here same line"), (None, "same line here " * 5)]
    return out + [(0, "a second text under the same id, with ten words or more in it"), out[1], (57, out[0][1])]


def test_every_span_is_found_and_nothing_else(spark, docs, texts, items):
    assert run(spark, docs, items) == brute(texts, items)
    assert any(r[5] for r in brute(texts, items)) and not all(r[5] for r in brute(texts, items))


def test_pieces_and_shuffled_joins_change_nothing(spark, docs, texts, items, monkeypatch):
    want = brute(texts, items)
    monkeypatch.setattr(W, "PIECE_CHARS", 40)
    assert run(spark, docs, items) == want
    monkeypatch.setattr(W, "BROADCAST_BYTES", 0)
    assert run(spark, docs, items) == want


def test_other_window(spark, docs, texts, items):
    assert run(spark, docs, items, window=7) == brute(texts, items, 7)


def test_empty_tables(spark, empty, docs, texts):
    none = spark.createDataFrame([], ITEMS)
    assert W.decontaminate(empty, none).count() == 0
    got = W.decontaminate(docs, none).collect()
    assert len(got) == len(texts) and not any(r.contaminated or r.n_hit or r.n_items for r in got)


def test_plan_has_no_python(spark, docs, items):
    out = W.decontaminate(docs, spark.createDataFrame([(1, "one two", "w", "s", 1, 1)], ITEMS))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lower_case_touches_ascii_only(spark):
    rows = [(chr(c),) for c in [*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 3)]]
    upper = F.col("c").between("A", "Z")
    got = spark.createDataFrame(rows, "c string")
    assert got.filter(ascii_lower(F.col("c")) != F.when(upper, F.lower("c")).otherwise(F.col("c"))).count() == 0
