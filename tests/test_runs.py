from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import jsonl, runs


def test_json_files_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/m.json"
    assert runs.read_json(spark, path, {"d": 1}) == {"d": 1}
    for value in ({"a": [1, None]}, {"b": "é"}):
        runs.write_json(spark, path, value)
        assert runs.read_json(spark, path) == value
    (tmp_path / "bad.json").write_text("{")
    assert runs.read_json(spark, f"file://{tmp_path}/bad.json", 7) == 7


def test_configurations_inherit_and_take_overrides(spark, tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "y": [1, 2]}, "b": 2}))
    (tmp_path / "own.json").write_text(json.dumps({"defaults": "base.json", "a": {"y": [3]}}))
    got = runs.load_config(spark, f"file://{tmp_path}/own.json", ["a.x=false", "c.d.e=1.5", "b=some text"])
    assert got == {"a": {"x": False, "y": [3]}, "b": "some text", "c": {"d": {"e": 1.5}}}
    assert runs.deep_get(got, "c.d.e") == 1.5 and runs.deep_get(got, "c.z.e", 0) == 0 and runs.scalar("None") is None


def test_manifest_keeps_sessions_and_drift(spark, tmp_path):
    state = runs.RunState(spark, f"file://{tmp_path}")
    assert state.begin_session({"a": {"x": 1}, "b": 2}) == []
    state.end_session(3, "budget")
    again = runs.RunState(spark, f"file://{tmp_path}")
    assert again.begin_session({"a": {"x": 5}, "c": 1}) == ["a.x", "b", "c"]
    assert [s.get("reason") for s in runs.RunState(spark, f"file://{tmp_path}").value["sessions"]] == ["budget", None]


def test_runs_are_found_graded_and_sorted(spark, tmp_path):
    def put(run, rows):
        (tmp_path / run).mkdir(parents=True)
        (tmp_path / run / "raw.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))

    base = {"gold_answer": "4", "answer_type": "math", "elicitation": "c0", "strategy": "sc"}
    put("a/one", [base | {"uid": "u1", "reasoning_traces": ["so 3"]}, base | {"uid": "u1", "reasoning_traces": ["so 4", "5"]}, base | {"uid": "u2", "reasoning_traces": ["4"], "strategy": "greedy_pass"}])
    put("b", [base | {"uid": "u1", "reasoning_traces": ["x"], "elicitation": None}, base | {"reasoning_traces": ["4"], "extra": json.dumps({"trace_policy": "drop", "sample_answers": ["4", None]})}, base | {"uid": "u9", "reasoning_traces": []}])
    folder = f"file://{tmp_path}"
    assert sorted(r.run.rsplit("/", 1)[1] for r in runs.find_runs(spark, folder).collect()) == ["b", "one"]
    rows = runs.load_runs(spark, folder)
    main, aux = runs.corpus(rows)
    got = sorted((r.uid if len(r.uid) < 3 else "-", r.sample_answers, r.n_correct_samples) for r in main.collect())
    assert got == [("-", ["4", None], 1), ("u1", ["4", "5"], 1)] and [r.uid for r in aux.collect()] == ["u2"]


def test_loaders_of_choices(spark, tmp_path):
    def put(name, rows):
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        return f"file://{tmp_path}/{name}"

    load = lambda name, rows=(): jsonl.load_examples(spark, name, put(name, rows)).collect()
    (one, two, three) = load("bbh", [{"input": "Q\nOptions:\n(A) x\n(B) y", "target": "(B)"}, {"input": "P", "target": "True"}, {"input": "R", "target": "wolf"}])
    assert (one.gold_answer, one.answer_type, one.choices) == ("B", "mc", ["x", "y"]) and (two.answer_type, three.answer_type) == ("bool", "text")
    (m,) = load("musr", [{"narrative": "n", "question": "q", "choices": "['a', \"it's\"]", "answer_index": 1}])
    assert (m.gold_answer, m.choices) == ("B", ["a", "it's"])
    (g,) = load("gpqa_diamond", [{"Question": "q", "Correct Answer": " r ", "Incorrect Answer 1": "w1", "Incorrect Answer 2": "w2", "Incorrect Answer 3": "w3"}])
    assert g.choices["ABCD".index(g.gold_answer)] == "r" and sorted(g.choices) == ["r", "w1", "w2", "w3"]
    toy = load("toy")
    assert len(toy) == 24 and all(r.gold_answer == str(eval(r.question[8:-1])) for r in toy)
    jsonl.save_examples(jsonl.load_examples(spark, "toy", ""), f"{tmp_path}/saved")
    assert jsonl.load_saved_examples(spark, f"{tmp_path}/saved").count() == 24


def test_known_fields_and_guard(spark):
    df = spark.createDataFrame([('{"tier": "A", "level": 3, "other": 1, "domain": null}',), (None,)], "m string")
    assert [r[0] for r in df.select(runs.analysis_meta(F.col("m"))).collect()] == [{"tier": "A", "level": "3"}, {}]
    now = [0.0]
    guard = runs.TimeGuard(100, 10, clock=lambda: now[0])
    assert not guard.should_stop()
    guard.record(20)
    now[0] = 61
    assert guard.should_stop() and guard.remaining == pytest.approx(39)
