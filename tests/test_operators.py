from __future__ import annotations

import gzip
import itertools
import json
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import identity as ident
from tallyframe.functions import stats as st
from tallyframe.operators import budgets as bu
from tallyframe.operators import cells as cl
from tallyframe.operators import records as rec
from tallyframe.operators import resampling as rs
from tallyframe.operators import transfer as tr
from tallyframe.operators import variance as va
from tallyframe.sources import jsonl
from tallyframe.streaming import grading as sg

SAMPLE = "item string, model string, config string, seed int, idx bigint, cls string, ok boolean, tok bigint"


def samples(spark, cells):
    rows = []
    for (item, config), classes in cells.items():
        rows += [(item, "m", config, 0, i, c, c == "gold", 100) for i, c in enumerate(classes)]
    return spark.createDataFrame(rows, SAMPLE)


def test_mode_transition_taxonomy(spark):
    s = samples(spark, {
        ("i0", "c0"): ["w1"] * 3 + ["gold"] * 2, ("i0", "c1"): ["gold"] * 3 + ["w1"] * 2, ("i1", "c0"): ["gold"] * 5, ("i1", "c1"): ["gold"] * 5,
        ("i2", "c0"): ["gold"] * 3 + ["w2"] * 2, ("i2", "c1"): ["w2"] * 4 + ["gold"], ("i3", "c0"): ["w1"] * 3 + ["w2"] * 2, ("i3", "c1"): ["w2"] * 3 + ["w1"] * 2,
    })
    t = cl.transitions(cl.modes(s), ["model", "seed"])
    assert {r.item: r.kind for r in t.collect()} == {"i0": "corrective", "i1": "stable", "i2": "destructive", "i3": "benign"}
    row = cl.transition_rows(t, ["model", "seed"]).first()
    assert (row.reorder_rate, row.corrective, row.destructive, row.benign, row.net) == (0.75, 1, 1, 1, 0)
    margins = {r.item: (r.margin_a, r.margin_b) for r in t.collect()}
    assert margins["i1"] == (1.0, 1.0) and np.allclose(margins["i2"], (0.2, 0.6))


def test_failed_extractions_compete_or_do_not(spark):
    s = samples(spark, {("i", "c0"): ["<unparsed>", "<unparsed>", "gold"]})
    assert cl.modes(s).first().mode_ok is False
    assert cl.modes(s, include_unparsed=False).first().mode_ok is True


def test_ties_go_to_the_first(spark):
    s = samples(spark, {("i", "c0"): ["w1", "gold", "gold", "w1"]})
    row = cl.modes(s).first()
    assert row["mode"] == "w1" and row.tie and row.margin == 0


def test_pass_at_k_against_subsets(spark):
    cases = [(n, c, k) for n in (1, 4, 6) for c in range(n + 1) for k in range(1, n + 1)]
    df = spark.createDataFrame(cases, "n int, c int, k int").select("*", st.pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("p"))
    for r in df.collect():
        hits = [any(i < r.c for i in s) for s in itertools.combinations(range(r.n), r.k)]
        assert abs(r.p - sum(hits) / len(hits)) < 1e-12


def test_distributions(spark):
    xs = [0.001, 0.02, 0.3, 0.5, 0.7, 0.99, 0.9999]
    df = spark.createDataFrame([(x,) for x in xs], "p double").select("p", st.normal_quantile(F.col("p")).alias("z"), st.normal_cdf(st.normal_quantile(F.col("p"))).alias("q"))
    for r in df.collect():
        assert abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-7 and abs(r.q - r.p) < 1e-6


def test_mcnemar_of_many_discordant_pairs(spark):
    cases = [(0, 0), (3, 10), (5, 5), (900, 1100)]
    df = spark.createDataFrame(cases, "a int, b int").select("a", "b", st.binomial_two_sided(F.least("a", "b"), F.col("a") + F.col("b")).alias("p"))
    for r in df.collect():
        n, k = r.a + r.b, min(r.a, r.b)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        assert r.p == pytest.approx(want, rel=1e-9)


def test_uid_is_the_hash_of_sorted_json(spark):
    import hashlib

    for strategy in ("plain", 'quo"te\\', "ünï"):
        body = {"model": "m", "strategy": strategy, "dataset": "d", "index": 3, "seed": 1, "config_hash": "h", "schema": 1}
        want = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]
        uid = ident.stable_uid(F.lit("m"), F.lit(strategy), F.lit("d"), F.lit(3), F.lit(1), F.lit("h"))
        assert spark.range(1).select(uid).first()[0] == want


def test_additive_design_has_no_interaction(spark):
    rng = np.random.default_rng(0)
    a, b, c = rng.normal(size=6), rng.normal(size=3), rng.normal(size=4)
    rows = [(f"i{i}", f"m{j}", f"c{k}", float(a[i] + b[j] + c[k])) for i in range(6) for j in range(3) for k in range(4)]
    ms = va.mean_squares(spark.createDataFrame(rows, "item string, model string, config string, z double")).first()
    for k in ("item_model", "item_config", "model_config", "residual"):
        assert abs(ms[f"ss_{k}"]) < 1e-9
    z = np.array([r[3] for r in rows])
    assert ms.ss_item + ms.ss_model + ms.ss_config == pytest.approx(((z - z.mean()) ** 2).sum())


def test_crossed_design_recovers_shares(spark):
    rng = np.random.default_rng(1)
    n, m, c = 300, 3, 4
    item, ic = rng.normal(0, 1.0, n), rng.normal(0, 0.7, (n, c))
    z = item[:, None, None] + ic[:, None, :] + rng.normal(0, 0.3, (n, m, c))
    rows = [(i, j, k, float(z[i, j, k])) for i in range(n) for j in range(m) for k in range(c)]
    ms = va.mean_squares(spark.createDataFrame(rows, "item int, model int, config int, z double"))
    got = {r.component: r.variance for r in va.components(ms, F.lit(0.0)).collect()}
    assert got["item"] == pytest.approx(1.0, abs=0.2) and got["item_config"] == pytest.approx(0.49, abs=0.06) and got["residual"] == pytest.approx(0.09, abs=0.02)


def test_spearman_with_ties_and_constants(spark):
    rows = [("g", i, x, y) for i, (x, y) in enumerate([(1.0, 2.0), (2.0, 2.0), (2.0, 5.0), (4.0, 9.0)])] + [("h", i, 1.0, float(i)) for i in range(4)]
    got = {r.g: r.rho for r in tr.spearman(spark.createDataFrame(rows, "g string, item int, x double, y double"), ["g"]).collect()}
    rank = lambda v: np.array([np.mean([sorted(v).index(x) + 1, len(v) - sorted(v)[::-1].index(x)]) for x in v])
    assert got["g"] == pytest.approx(np.corrcoef(rank([1, 2, 2, 4]), rank([2, 2, 5, 9]))[0, 1]) and got["h"] is None


def test_replicate_weights_are_poisson_and_independent(spark):
    x = st.replicate_draw(st.replicate_key(F.concat(F.lit("u"), "id")), F.col("replicate"))
    df = spark.range(40).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(3999))))
    w = df.select("id", "replicate", st.poisson_weight(x).alias("w")).toPandas().pivot(index="replicate", columns="id", values="w").to_numpy()
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert [round(float((w == k).mean()), 2) for k in range(4)] == [round(math.exp(-1) / math.factorial(k), 2) for k in range(4)]
    r = np.corrcoef(w, rowvar=False)[~np.eye(40, dtype=bool)]
    along = [np.corrcoef(w[:-1, i], w[1:, i])[0, 1] for i in range(40)]
    assert np.abs(r).max() < 0.08 and np.abs(along).max() < 0.08 and abs(r.mean()) < 0.005


def test_weighted_refit_is_the_refit_of_copied_items(spark):
    rng = np.random.default_rng(3)
    z = spark.createDataFrame([(f"i{i}", m, c, float(rng.normal() + i)) for i in range(12) for m in "ab" for c in "xyz"], "item string, model string, config string, z double")
    floors = spark.createDataFrame([(f"i{i}", 0.01 * i, 1) for i in range(12)], "item string, fv double, fn long")
    got = {(r.replicate, r.component): r.variance for r in va.resampled_components(z, floors, 6).collect()}
    drawn = rs.with_replicates(z, "item", 6).withColumn("w", st.poisson_weight(F.col("_x"))).where("w > 0")
    copies = drawn.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("w")))).withColumn("item", F.concat_ws("#", "item", "nth"))
    taken = copies.where("model = 'a' and config = 'x'").withColumn("item", F.split("item", "#")[0]).join(floors, "item")
    floor = taken.groupBy("replicate").agg(F.avg("fv").alias("_f"))
    ms = va.mean_squares(copies.select("replicate", "item", "model", "config", "z"), ["replicate"]).join(floor, "replicate")
    want = {(r.replicate, r.component): r.variance for r in va.components(ms, F.col("_f"), ["replicate"]).collect()}
    assert got.keys() == want.keys() and len(got) == 42 and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)


def test_permutation_sides_and_empty_tables(spark):
    df = spark.createDataFrame([("g", f"i{i}", 1.0 + i / 10) for i in range(12)] + [("g", "none", None)], "g string, item string, v double")
    p = {side: rs.sign_permutation(df, ["g"], "item", "v", 2000, side).first().p_value for side in ("two-sided", "greater", "less")}
    assert p["greater"] < 0.005 and p["two-sided"] < 0.01 and p["less"] > 0.99
    assert rs.bootstrap_ci(df.limit(0), ["g"], "item", "v", 10).count() == 0
    one = rs.bootstrap_ci(df.where("item = 'i0'"), ["g"], "item", "v", 100).first()
    assert one.ci_low == one.ci_high == one.point


def test_bootstrap_interval_covers_like_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(1, 1, 60)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "g int, item int, v double")
    got, bca = rs.bootstrap_ci(df, ["g"], "item", "v", 400).first(), rs.bca_ci(df, ["g"], "item", "v", 400).first()
    want = np.percentile([rng.choice(v, 60).mean() for _ in range(4000)], [2.5, 97.5])
    assert np.allclose([got.ci_low, got.ci_high], want, atol=0.06) and np.allclose([bca.ci_low, bca.ci_high], want, atol=0.08)


def test_skip_fit_and_round_robin(spark):
    chains = [("0", i, t, "gold", True) for i, t in enumerate((60, 50, 40, 1))]
    df = spark.createDataFrame([(1, chains)], f"k int, chains array<{bu.CHAIN}>").select(bu.take_within(F.col("chains"), F.lit(100)).alias("d"))
    assert [c.tok for c in df.first().d.taken] == [60, 40] and df.first().d.spent == 100
    two = spark.createDataFrame([(1, {"c0": chains, "c1": chains[1:]}, 160)], f"k int, chains map<string,array<{bu.CHAIN}>>, budget bigint")
    row = bu.round_robin(two).first()
    assert row.spent == 160 and [c.tok for c in row.taken] == [60, 50, 50]
    assert bu.vote(spark.createDataFrame([(1, [])], f"k int, taken array<{bu.CHAIN}>"), ["k"]).first().correct is False


def test_positions_are_dense_and_ordered(spark):
    df = rec.with_position(spark.range(0, 1000).withColumn("o", -F.col("id")).repartition(7), "o")
    assert [r.position for r in df.orderBy("o").collect()] == list(range(1000))


def test_log_damage(spark, tmp_path):
    folder = tmp_path / "run"
    folder.mkdir()
    lines = [json.dumps({"uid": f"u{i}", "index": i}) for i in range(5)]
    (folder / "results.jsonl").write_text("\n".join([*lines, "", '{"uid": "u5", "ind']))
    with gzip.open(folder / "more.jsonl.gz", "wt") as f:
        f.write(json.dumps({"uid": "z", "error": "x"}) + "\n")
    got = jsonl.read_jsonl(spark, str(tmp_path))
    assert sorted(r.uid for r in got.collect()) == ["u0", "u1", "u2", "u3", "u4", "z"]
    jsonl.append_jsonl(got.select("uid"), str(tmp_path / "out"))
    jsonl.append_jsonl(got.select("uid"), str(tmp_path / "out"), gzip=True)
    assert jsonl.read_jsonl(spark, str(tmp_path / "out"), "uid string").count() == 12


def test_last_wins_and_errors_run_again(spark):
    log = spark.createDataFrame([("a", 1, 1, None), ("b", 2, 2, None), ("a", 3, 99, None), (None, 4, 5, None), (None, 5, 6, None), ("bad", 6, 0, "e")], "uid string, n int, value int, error string")
    got = rec.last_wins(log, "uid", "n").orderBy("first_seen").collect()
    assert [(r.uid, r.value) for r in got] == [("a", 99), ("b", 2), (None, 5), (None, 6), ("bad", 0)]
    planned = spark.createDataFrame([("a",), ("bad",), ("new",)], "uid string")
    left = rec.pending(planned, log.withColumn("failed", F.col("error").isNotNull()), "uid", "failed")
    assert sorted(r.uid for r in left.collect()) == ["bad", "new"]


def test_csv_values(spark, tmp_path):
    a = spark.createDataFrame([(1.23456789, float("inf"), [1, 2], True)], "x double, y double, z array<int>, b boolean")
    b = spark.createDataFrame([(float("nan"), "late")], "x double, w string")
    jsonl.write_csv([a, b], str(tmp_path / "csv"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert sorted((r.x or "", r.y or "", r.z or "", r.b or "", r.w or "") for r in rows) == [("", "", "", "", "late"), ("1.23457", "inf", "1;2", "true", "")]


def test_datasets_and_drift(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text(json.dumps({"question": "q", "answer": "so 5+5\n#### 1,010"}) + "\n")
    row = jsonl.load_examples(spark, "gsm8k", str(path)).first()
    assert (row.gold_answer, row.answer_type) == ("1010", "math")
    with pytest.raises(KeyError):
        jsonl.load_examples(spark, "none", str(path))
    assert jsonl.drift({"a": {"b": 1}, "c": [1]}, {"a": {"b": 2}, "c": [1], "d": 0}) == ["a.b", "d"]


def test_streamed_grading(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"uid": "a", "line_no": 1, "text": r"\boxed{2}", "gold_answer": "2"}, {"uid": "a", "line_no": 2, "text": "it is 3", "gold_answer": "2"}, {"uid": "b", "line_no": 3, "text": "the answer is 0.5", "gold_answer": "1/2"}]
    (source / "1.json").write_text("\n".join(map(json.dumps, rows)) + "\n{torn")
    for _ in range(2):
        sg.grade_stream(sg.read_records(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (source / "2.json").write_text(json.dumps({"uid": "a", "line_no": 9, "text": "2", "gold_answer": "2"}) + "\n")
    sg.grade_stream(sg.read_records(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.uid: r.is_correct for r in sg.read_graded(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": True, "b": True}


def test_null_draws_are_those_of_the_hash_and_move_cells_alone(spark):
    keys = spark.range(50).select("id", st.replicate_key(F.col("id")).alias("key")).crossJoin(spark.range(7).select(F.col("id").alias("rep")))
    rows = keys.select("id", "rep", "key.a", "key.b", st.replicate_draw(F.col("key"), F.col("rep")).alias("x")).collect()
    a, b = ({r.id: r[c] for r in rows} for c in ("a", "b"))
    x = tr._draws(np.array([a[i] for i in range(50)]), np.array([b[i] for i in range(50)]), np.arange(7))
    assert all(x[r.rep, r.id] == r.x for r in rows)
    n, p = np.array([0, 1, 5, 5] * 12 + [3000, 9]), np.linspace(0, 1, 50)
    counts = tr.binomial_counts(n, p, np.array([a[i] for i in range(50)]), np.array([b[i] for i in range(50)]), np.arange(7))
    for i in range(50):
        steps = tr.binomial_steps(int(n[i]), p[i : i + 1])[:, 0]
        assert [sum(s <= y for s in steps) for y in x[:, i]] == list(counts[:, i])
    cells = spark.createDataFrame([("m", c, str(i), 4, (i % 5) / 4) for c in ("c0", "c1") for i in range(12)], "model string, config string, item string, n long, p_hat double")
    df = tr.reestimation_null(cells, ["model"], "config", 20)
    row, plan = df.first(), df._jdf.queryExecution().executedPlan().toString()
    assert row.n_draws == 20 and row.observed == 1.0 and 0 < row.null_mean < 1
    assert "Window" not in plan and not any("Exchange" in line and "replicate" in line for line in plan.splitlines())
