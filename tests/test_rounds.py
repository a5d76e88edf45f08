from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import generation as ge
from tallyframe.operators import rounds as op
from tallyframe.operators import tables as ta


def scripted(texts):
    """A backend that says what is written for a tag, or no number."""

    def reply(chat, key, tag):
        said = F.lit(texts.get(tag, "nothing to say"))
        return F.struct(said.alias("text"), F.size(chat).cast("long").alias("tokens_prompt"), F.lit(7).cast("long").alias("tokens_completion"), F.lit(False).alias("truncated"))

    return reply


@pytest.fixture
def examples(spark):
    return spark.createDataFrame([(1, "two and two?")], "id long, question string")


def test_refinement_stops_when_the_check_passes(examples):
    r = op.self_refine(examples, scripted({"draft": "The answer is 4.", "verify0": "Verdict: correct"}), rounds=3).first()
    assert (r.answer, r.rounds_used, r.n_calls, r.verdicts, r.stopped_early, r.answer_changed) == ("4", 0, 2, [True], True, False)
    assert (r.tokens_prompt, r.tokens_completion) == (1 + 3, 14)


def test_an_empty_revision_does_not_destroy_a_draft(examples):
    r = op.self_refine(examples, scripted({"draft": "The answer is 5.", "verify0": "Verdict: incorrect", "verify1": "hmm"}), rounds=2).first()
    assert (r.answer, r.rounds_used, r.n_calls, r.verdicts, r.stopped_early, r.answer_changed) == ("5", 2, 5, [False, None], False, True)


def test_rounds_without_checks_and_none_at_all(examples):
    said = scripted({"draft": "The answer is 5.", "refine0": "The answer is 6."})
    r = op.self_refine(examples, said, rounds=1, verify=False).first()
    assert (r.answer, r.n_calls, r.verdicts, r.stopped_early) == ("6", 2, [], False)
    assert op.self_refine(examples, said, rounds=0).first().n_calls == 1
    go = op.self_refine(examples, scripted({"draft": "4", "verify0": "Verdict: correct", "refine0": "The answer is 3."}), rounds=1, stop=False).first()
    assert (go.answer, go.rounds_used, go.stopped_early) == ("3", 1, True)


def test_no_stage_of_a_strategy_shuffles(examples):
    plan = op.self_refine(examples, op.mock_backend(F.lit(4)), rounds=2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize(("text", "score"), [("7", 7.0), ("8.5/10", 8.5), ("I say 11", 10.0), ("no idea", 0.0), ("", 0.0), (None, 0.0)])
def test_ratings(spark, text, score):
    assert spark.range(1).select(op.rating(F.lit(text).cast("string"))).first()[0] == score


def test_configured_sampling_skips_missing_answers(spark):
    rows = [(1, 0, None, 5, True), (1, 1, None, 5, None), (1, 2, "b", 5, False), (1, 3, "a", 5, False), (2, 0, None, 3, None)]
    df = spark.createDataFrame(rows, "id long, idx long, answer string, tok long, truncated boolean")
    got = {r.id: r for r in ge.resolve(ge.STRATEGIES, "cdv_corpus")(df).collect()}
    assert (got[1].answer, got[1].n_samples, got[1].n_failures, got[1].n_truncated, got[1].tok) == ("b", 4, 2, 1, 20)
    assert got[2].answer is None and got[2].n_failures == 1


def test_latex_cells(spark):
    cells = [
        ta.tex(F.lit("a_b\\{5%}~")), ta.tex_number(F.lit(None)), ta.tex_number(F.lit(float("nan"))), ta.tex_number(F.lit(float("inf"))), ta.tex_number(F.lit(0.12345)),
        ta.tex_whole(F.lit(1234567)), ta.tex_percent(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.6)), ta.tex_stars(F.lit(0.004)), ta.tex_stars(F.lit(None).cast("double")),
    ]
    want = [r"a\_b\textbackslash{}\{5\%\}\textasciitilde{}", "--", "--", r"$\infty$", "0.123", r"1\,234\,567", "50.0", "$^{**}$", ""]
    assert list(spark.range(1).select(*cells).first()) == want


def test_a_table_is_whole_or_refused(spark, monkeypatch):
    lines = spark.createDataFrame([(2, r"b & 2 \\"), (1, r"a & 1 \\")], "at int, line string")
    text = ta.rendered(lines, "line", ["at"], ["name", "n"], "Runs", ["seeds: 0"])
    assert text.startswith("% seeds: 0\n\\begin{table}") and text.index("a & 1") < text.index("b & 2") and "\\begin{tabular}{ll}" in text
    monkeypatch.setattr(ta, "MOST_LINES", 1)
    with pytest.raises(ValueError):
        ta.rendered(lines, "line", ["at"], ["name", "n"], "Runs")
