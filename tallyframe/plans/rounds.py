"""Queries on strategies of several calls and on report tables as LaTeX."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import stats as st
from tallyframe.operators import generation as ge
from tallyframe.operators import rounds as op
from tallyframe.operators import tables as ta
from tallyframe.plans.base_sql import S
from tallyframe.plans.registry import query
from tallyframe.plans.reports import MOCK, _hash, _mock
from tallyframe.sources import adapters as ad


def _examples(spark, d):
    return ad.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), (F.col("item_id") % 7).alias("gold"))


def _draft_sql(tag: str) -> str:
    """Answer and tokens of a mock draft."""
    kind = f"({_hash('0', 'item_id', repr(tag), repr('text'))} % 4)"
    return f"CASE WHEN {kind} = 3 THEN NULL ELSE CAST(item_id % 7 + {kind} % 2 AS VARCHAR) END AS a_{tag}, CAST(10 + {_hash('0', 'item_id', repr(tag), repr('tok'))} % 50 AS BIGINT) AS t_{tag}"


def _verdict_sql(tag: str) -> str:
    said = f"{_hash('0', 'item_id', repr(tag), repr('text'))} % 3"
    return f"CASE {said} WHEN 0 THEN true WHEN 1 THEN false END AS v_{tag}, CAST(10 + {_hash('0', 'item_id', repr(tag), repr('tok'))} % 50 AS BIGINT) AS t_{tag}"


@query("cot_answers", f"""SELECT item_id AS id, 'zeroshot' AS strategy, a_cot AS answer, {_hash('0', 'item_id', "'cot'", "'cut'")} % 20 = 0 AS truncated, CAST(10 AS BIGINT) AS tokens_prompt, t_cot AS tokens_completion FROM (SELECT item_id, {_draft_sql('cot')} FROM benchmark)
UNION ALL SELECT item_id, 'fewshot', a_cot_fewshot, {_hash('0', 'item_id', "'cot_fewshot'", "'cut'")} % 20 = 0, 50, t_cot_fewshot FROM (SELECT item_id, {_draft_sql('cot_fewshot')} FROM benchmark)""")
def cot_answers(spark, d):
    examples, backend = _examples(spark, d), op.mock_backend(F.col("id") % 7)
    one = ge.resolve(ge.STRATEGIES, "cot_zeroshot")(examples, backend).withColumn("strategy", F.lit("zeroshot"))
    two = ge.resolve(ge.STRATEGIES, "cot_fewshot")(examples, backend, [("1+1?", "2"), ("2+2?", "4")]).withColumn("strategy", F.lit("fewshot"))
    return one.unionByName(two).select("id", "strategy", "answer", "truncated", "tokens_prompt", "tokens_completion")


@query("self_verify", f"SELECT item_id AS id, a_draft AS answer, v_verify AS verdict, CAST(2 AS BIGINT) AS n_calls, CAST(40 AS BIGINT) AS tokens_prompt, t_draft + t_verify AS tokens_completion FROM (SELECT item_id, {_draft_sql('draft')}, {_verdict_sql('verify')} FROM benchmark)")
def self_verify(spark, d):
    return ge.resolve(ge.STRATEGIES, "self_verify")(_examples(spark, d), op.mock_backend(F.col("id") % 7))


@query("self_refine", f"""WITH x AS (SELECT item_id, {_draft_sql('draft')}, {_verdict_sql('verify0')}, {_draft_sql('refine0')}, {_verdict_sql('verify1')}, {_draft_sql('refine1')} FROM benchmark),
y AS (SELECT *, CASE WHEN v_verify0 IS TRUE THEN 0 WHEN v_verify1 IS TRUE THEN 1 ELSE 2 END AS used FROM x)
SELECT item_id AS id, CASE used WHEN 0 THEN a_draft WHEN 1 THEN coalesce(a_refine0, a_draft) ELSE coalesce(a_refine1, a_refine0, a_draft) END AS answer, used AS rounds_used,
  CASE used WHEN 0 THEN false WHEN 1 THEN a_draft IS DISTINCT FROM a_refine0 ELSE a_draft IS DISTINCT FROM a_refine1 END AS answer_changed, used < 2 AS stopped_early,
  CAST(CASE used WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 5 END AS BIGINT) AS n_calls, CAST(CASE used WHEN 0 THEN 40 WHEN 1 THEN 100 ELSE 130 END AS BIGINT) AS tokens_prompt,
  t_draft + t_verify0 + CASE WHEN used >= 1 THEN t_refine0 + t_verify1 ELSE 0 END + CASE WHEN used = 2 THEN t_refine1 ELSE 0 END AS tokens_completion FROM y""")
def self_refine(spark, d):
    return ge.resolve(ge.STRATEGIES, "self_refine")(_examples(spark, d), op.mock_backend(F.col("id") % 7), rounds=2).drop("drafts", "verdicts")


@query("configured_sampling", f"""WITH {MOCK}, h AS (SELECT id, idx, nullif(answer, 'x1') AS answer, tok, tok > 110 AS cut FROM g), v AS (SELECT id, answer, count(*) AS n, min(idx) AS f FROM h WHERE answer IS NOT NULL GROUP BY ALL),
b AS (SELECT id, answer FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, f) = 1)
SELECT id, any_value(b.answer) AS answer, count(*) AS n_samples, count(*) FILTER (h.answer IS NULL) AS n_failures, count(*) FILTER (cut) AS n_truncated, CAST(sum(tok) AS BIGINT) AS tok FROM h LEFT JOIN b USING (id) GROUP BY id""")
def configured_sampling(spark, d):
    rows = _mock(spark, d).withColumns({"answer": F.nullif("answer", F.lit("x1")), "truncated": F.col("tok") > 110})
    return ge.resolve(ge.STRATEGIES, "configured_sampling")(rows)


@query("best_of_n_judge", f"""WITH {MOCK}, j AS (SELECT *, CASE WHEN idx % 4 = 3 THEN 0.0 ELSE least(10.0, CAST(tok AS DOUBLE) / 8) END AS score FROM g)
SELECT id, answer, (SELECT CAST(sum(tok) AS BIGINT) FROM g h WHERE h.id = j.id) AS tok FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, idx) = 1""")
def best_of_n_judge(spark, d):
    rated = F.concat(F.lit("I give "), (F.col("tok") / 8).cast("string"), F.lit("/10"))
    rows = _mock(spark, d).withColumn("judged", F.when(F.col("idx") % 4 == 3, F.lit("no idea")).otherwise(rated))
    return ge.resolve(ge.STRATEGIES, "best_of_n")(rows, "llm_judge")


_ACC = "a AS (SELECT model, config, count(*) AS n, count(*) FILTER (cls = 'gold') AS k, CAST(sum(tok) AS BIGINT) AS tok FROM s GROUP BY ALL)"


def _accuracy(spark, d):
    return ad.samples(spark, d).groupBy("model", "config").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("k"), F.sum("tok").alias("tok"))


_WILSON = "(k / n::DOUBLE + 3.841458820694124e0 / (2 * n) {} 1.959963984540054e0 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 3.841458820694124e0 / (4.0 * n * n))) / (1 + 3.841458820694124e0 / n)"


@query("latex_results", f"""WITH {S}, {_ACC}, b AS (SELECT *, k / n::DOUBLE AS p, {_WILSON.format('-')} AS lo, {_WILSON.format('+')} AS hi, k / n::DOUBLE = max(k / n::DOUBLE) OVER (PARTITION BY model) AS best FROM a),
c AS (SELECT *, printf('%.1f', round(100 * p, 1)) || ' \\small{{[' || printf('%.1f', round(100 * lo, 1)) || ', ' || printf('%.1f', round(100 * hi, 1)) || ']}}' AS cell FROM b)
SELECT model, config, 'run\\_' || model || '\\&' || config || ' & ' || CASE WHEN best THEN '\\textbf{{' || cell || '}}' ELSE cell END || ' & ' || replace(format('{{:,}}', tok), ',', '\\,') || ' \\\\' AS line FROM c""")
def latex_results(spark, d):
    from pyspark.sql import Window

    a = _accuracy(spark, d)
    p = st.ratio(F.col("k"), F.col("n"))
    low, high = st.wilson(F.col("k"), F.col("n"))
    cell = ta.bold(ta.tex_percent(p, low, high), p == F.max(p).over(Window.partitionBy("model")))
    name = ta.tex(F.concat(F.lit("run_"), "model", F.lit("&"), "config"))
    return a.select("model", "config", ta.tex_line(name, cell, ta.tex_whole(F.col("tok"))).alias("line"))


@query("budget_table", f"""WITH {S}, {_ACC} SELECT model, config, round(tok / 180000.0, 6) AS hours, round(sum(tok) OVER (ORDER BY model, config) / 180000.0, 6) AS hours_so_far,
 model || ' & ' || config || ' & ' || printf('%.2f', round(sum(tok) OVER (ORDER BY model, config) / 180000.0, 2)) || ' \\\\' AS line FROM a""")
def budget_table(spark, d):
    rows = _accuracy(spark, d).withColumn("total", ta.running("tok", ["model", "config"]))  # one row a configuration: few
    hours, total = F.col("tok") / F.lit(180000.0), F.col("total") / F.lit(180000.0)
    line = ta.tex_line(ta.tex(F.col("model")), ta.tex(F.col("config")), ta.tex_number(total, 2))
    return rows.select("model", "config", st.r6(hours).alias("hours"), st.r6(total).alias("hours_so_far"), line.alias("line"))
