from pyspark.sql import functions as F

from tidemark.llm import preferences as P


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, prompt string")
    out = P.preference_pairs(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)
    return {r.pair_id: r for r in out.collect()}


def test_prompt_is_the_common_prefix_and_spans_cut_what_is_trained(spark):
    shared = [(0, "system", "be brief"), (1, "user", "hi 🙂")]
    rows = [(c, *t, "x") for c in (0, 1) for t in shared]
    rows += [(0, 2, "assistant", "yes", "x"), (0, 3, "user", "ok", "x"), (0, 4, "assistant", None, "x"), (1, 2, "assistant", "no", "x"), (1, 2, "assistant", "no", "x")]
    rows += [(2, 0, "user", "same", "x"), (3, 0, "user", "same", "x"), (3, 1, "assistant", "more", "x")]
    rows += [(4, 0, "user", "alone", "x"), (None, 0, "user", "none", "x"), (6, None, None, None, "x"), (7, 0, "user", "u", "x")]
    got = pairs(spark, rows)
    assert set(got) == {0, 1, 2, 3}
    r = got[0]
    assert r.n_common == 2 and r.prompt == "<|system|>\nbe brief<|end|>\n<|user|>\nhi 🙂<|end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == ["yes<|end|>", "<|end|>"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_spans] == ["no<|end|>"]
    assert got[1].n_common == 1 and got[1].chosen == "" and got[1].chosen_spans == [] and got[1].complete
    assert not got[2].complete and got[2].prompt == "" and got[2].rejected == ""
    assert got[3].n_common == 0 and got[3].chosen == "<||>\n<|end|>\n"


def test_empty_table(spark):
    assert pairs(spark, []) == {}


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(0, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    plan = P.preference_pairs(df, F.col("conv_id"), F.col("conv_id") == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
