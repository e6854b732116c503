import re
from collections import Counter

from tidemark.llm import quality as Q


def expected(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if count[w] > 1 for d in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_measures_match_plain_python(docs, texts):
    rows = Q.quality_rules(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((i, *expected(t)) for i, t in texts)
    assert not any(r.kept and r.base_failed for r in rows)
    kept = {r.doc_id for r in rows if r.kept}
    assert {0, 1, 2, 105} <= kept and not kept & {109, 110, 111, 100, 101}


def test_stage_returns_the_columns_and_the_empty_table(spark, docs, empty):
    out = Q.stage(spark, docs, "")
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert Q.stage(spark, empty, "").count() == 0 and Q.quality_rules(empty).count() == 0


def test_each_rule_rejects_on_its_side(spark):
    row = spark.createDataFrame([(1, 30, 5)], "one int, n_words int, n_symbols int")
    rule = lambda **k: Q.verdict((Q.Rule("r", "n_symbols", "n_words", **k),))
    assert row.select(rule(low=0.1), rule(low=0.2), rule(high=0.2), rule(high=0.1)).first() == (True, False, True, False)
