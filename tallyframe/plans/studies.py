"""Queries over whole studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import stats as st
from tallyframe.operators import budgets as bu
from tallyframe.operators import cells as cl
from tallyframe.operators import records as rec
from tallyframe.operators import studies as op
from tallyframe.plans.base_sql import C, S
from tallyframe.plans.budgets import BY, _draw_sql, _draws
from tallyframe.plans.cells import BY as CELL_BY
from tallyframe.plans.cells import CEIL
from tallyframe.plans.inference import DF, FLOOR, MS, Z, _TERMS
from tallyframe.plans.records import TAIL
from tallyframe.plans.registry import query
from tallyframe.sources import adapters as ad

r6 = st.r6


@query("build_comparisons", f"""WITH l AS (SELECT o_custkey % 3 AS dataset, o_custkey AS example, o_orderpriority AS strategy, CAST(arg_max(o_orderstatus = 'F', o_orderkey) AS INT) AS v FROM orders GROUP BY ALL),
k AS (SELECT DISTINCT dataset, strategy FROM l WHERE strategy <> '5-LOW'), e AS (SELECT DISTINCT dataset, example FROM l),
j AS (SELECT k.dataset, k.strategy, a.v AS a, b.v AS b FROM k JOIN e USING (dataset) LEFT JOIN l a ON a.dataset = k.dataset AND a.example = e.example AND a.strategy = '5-LOW' LEFT JOIN l b ON b.dataset = k.dataset AND b.example = e.example AND b.strategy = k.strategy),
x AS (SELECT dataset, strategy, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_pairs, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS n_only_a, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS n_only_b,
  avg(b) FILTER (a IS NOT NULL) - avg(a) FILTER (b IS NOT NULL) AS delta, count(*) FILTER (a = 0 AND b = 1) AS b01, count(*) FILTER (a = 1 AND b = 0) AS b10 FROM j GROUP BY ALL)
SELECT dataset, strategy, n_pairs, n_only_a, n_only_b, round(delta, 6) AS delta, b01, b10, round({TAIL} + 1e-9, 6) AS p_value FROM x""")
def build_comparisons(spark, d):
    got = op.compare_all(ad.records(spark, d).withColumn("dataset", F.col("example") % 3), ["dataset"], ["example"], "uid", "strategy", "5-LOW")
    return got.select("dataset", "strategy", "n_pairs", "n_only_a", "n_only_b", r6("delta").alias("delta"), "b01", "b10", r6(F.col("p_value") + 1e-9).alias("p_value"))


_BY_SEED = MS.format(by="seed, ", b0="seed", src="z", group="GROUP BY seed")
_CM = ", ".join(f"{t} / ({DF[t]}) - f AS {t}" for t in _TERMS)


@query("decompose_all", f"""WITH {Z}, {_BY_SEED}, {FLOOR}, cm AS (SELECT seed, ni, nm, nc, {_CM} FROM ms, fl WHERE ni >= 3),
co AS (SELECT seed, unnest([{', '.join(f"'{t}'" for t in _TERMS)}]) AS component, unnest([(item - item_model - item_config + residual) / (nm * nc), (model - item_model - model_config + residual) / (ni * nc),
  (config - item_config - model_config + residual) / (ni * nm), (item_model - residual) / nc, (item_config - residual) / nm, (model_config - residual) / ni, residual]) AS v FROM cm)
SELECT seed, component, round(v, 6) AS variance, v < 0 AS negative, round(greatest(v, 0) / sum(greatest(v, 0)) OVER (PARTITION BY seed), 6) AS share FROM co""")
def decompose_all(spark, d):
    return op.decompose_all(cl.cells(ad.samples(spark, d)), ["seed"], "c0").withColumns({x: r6(x) for x in ("variance", "share")})


@query("greedy_lookup", f"""WITH {CEIL}, gr AS (SELECT model, config, count(*) FILTER (cls = 'gold') / CAST(count(*) AS DOUBLE) AS greedy FROM s WHERE idx = 0 AND config <> 'c2' GROUP BY ALL)
SELECT model, config, seed, round(pi_mode, 6) AS pi_mode, round(greedy, 6) AS greedy, round(pi_mode - greedy, 6) AS gain FROM ceil LEFT JOIN gr USING (model, config)""")
def greedy_lookup(spark, d):
    s = ad.samples(spark, d)
    greedy = s.where("idx = 0 and config <> 'c2'").groupBy("model", "config").agg(F.avg(F.col("ok").cast("int")).alias("greedy"))
    got = cl.ceilings(cl.with_modes(s), CELL_BY).join(greedy, ["model", "config"], "left")
    return got.select("model", "config", "seed", r6("pi_mode").alias("pi_mode"), r6("greedy").alias("greedy"), r6(F.col("pi_mode") - F.col("greedy")).alias("gain"))


@query("predictions", f"""WITH {CEIL}, sp AS (SELECT model, seed, max(pi_mode) - min(pi_mode) AS x FROM ceil GROUP BY ALL)
SELECT 'spread' AS prediction, model, round(x * 100, 6) AS value, CAST(NULL AS BIGINT) AS n, round(x * 100, 9) > 3 AS supported FROM sp
UNION ALL SELECT 'ties', model, round(avg(tie_rate), 6), count(*), avg(tie_rate) < 0.25 FROM ceil GROUP BY model""")
def predictions(spark, d):
    rows = cl.ceilings(cl.with_modes(ad.samples(spark, d)), CELL_BY)
    per = rows.groupBy("model", "seed").agg(((F.max("pi_mode") - F.min("pi_mode")) * 100).alias("x"), F.sum("tie_rate").alias("t"), F.count(F.lit(1)).alias("c"))
    per = per.groupBy("model").agg(F.collect_list("x").alias("xs"), (F.sum("t") / F.sum("c")).alias("t"), F.sum("c").alias("c"))
    said = lambda name, x, n, yes: F.struct(F.lit(name).alias("prediction"), r6(x).alias("value"), n.cast("long").alias("n"), yes.alias("supported"))
    spread = F.transform("xs", lambda x: said("spread", x, F.lit(None), F.round(x, 9) > 3))
    ties = said("ties", F.col("t"), F.col("c"), F.col("t") < 0.25)
    return per.select("model", F.explode(F.concat(spread, F.array(ties))).alias("p")).select("p.prediction", "model", "p.value", "p.n", "p.supported")


@query("backend_stats", """SELECT l_suppkey AS backend, count(*) AS n_calls, CAST(sum(l_partkey % 100) AS BIGINT) AS tokens_prompt, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens_completion,
  CAST(sum(l_partkey % 100 + CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens_total, CASE WHEN sum(l_linenumber) > 0 THEN round(sum(CAST(l_quantity AS BIGINT)) / CAST(sum(l_linenumber) AS DOUBLE), 2) END AS completion_tokens_per_s FROM lineitem GROUP BY ALL""")
def backend_stats(spark, d):
    calls = ad.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("backend"), (F.col("l_partkey") % 100).alias("p"), F.col("l_quantity").cast("long").alias("c"), F.col("l_linenumber").alias("s"))
    return op.backend_stats(calls, ["backend"], "p", "c", "s").drop("seconds")


@query("run_planner", """SELECT n_nationkey AS plan, round((n_nationkey * 100 * 1.5 * 3 * 2 + 900) / 3600, 6) AS hours, round(n_nationkey * 1e9 * 2 / power(1024, 3), 2) AS half_gb, round(n_nationkey * 1e9 * 0.55 / power(1024, 3), 2) AS four_bit_gb FROM nation""")
def run_planner(spark, d):
    n = F.col("n_nationkey")
    return ad.table(spark, d, "nation").select(n.alias("plan"), r6(op.run_hours(n * 100, F.lit(1.5), 3, 2)).alias("hours"), op.weights_gb(n).alias("half_gb"), op.weights_gb(n, four_bit=True).alias("four_bit_gb"))


@query("item_tiers", """WITH r AS (SELECT item_id, row_number() OVER (ORDER BY md5(concat_ws('-', 0, item_id)), item_id) AS rn FROM benchmark)
SELECT item_id, CASE WHEN rn <= 10 THEN 'A' ELSE 'B' END AS tier FROM r WHERE rn <= 20""")
def item_tiers(spark, d):
    items = ad.table(spark, d, "benchmark").select("item_id")
    one, two = (op.tier(items, "item_id", 10, t).withColumn("tier", F.lit(t)) for t in "AB")
    return one.unionByName(two)


@query("chunked_texts", """SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS chunk, md5(CASE WHEN length(text) <= 60 THEN text ELSE left(text, 57) || '...' END) AS digest FROM documents""")
def chunked_texts(spark, d):
    t = rec.with_position(ad.table(spark, d, "documents").select("doc_id", op.truncated(F.col("text"), 60).alias("t")), "doc_id")
    return t.select("doc_id", op.chunk(F.col("position"), 50).alias("chunk"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("option_shuffle", """WITH c AS (SELECT item_id, list_transform(list_sort(list_transform(range(0, 4), lambda i: {'o': md5(concat_ws('-', item_id, i)), 'c': 'c' || i})), lambda x: x.c) AS cs FROM benchmark)
SELECT item_id, array_to_string(cs, '|') AS choices, chr(CAST(64 + list_position(cs, 'c' || (item_id % 4)) AS INT)) AS letter FROM c""")
def option_shuffle(spark, d):
    four = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("c"), i.cast("string")))
    got = ad.table(spark, d, "benchmark").select("item_id", op.shuffled_choices(F.col("item_id"), four, F.concat(F.lit("c"), (F.col("item_id") % 4).cast("string"))).alias("s"))
    return got.select("item_id", F.array_join("s.choices", "|").alias("choices"), "s.letter")


@query("parsed_choices", """SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'it''s|b ' || item_id WHEN 1 THEN 'x|y ' || item_id ELSE 'only ' || item_id END AS choices, CASE WHEN item_id % 2 = 0 THEN 'one|two ' || item_id END AS options FROM benchmark""")
def parsed_choices(spark, d):
    i = F.col("item_id").cast("string")
    text = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("[\"it's\", 'b "), i, F.lit("']"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit(" x | y "), i)).otherwise(F.concat(F.lit("only "), i))
    question = F.concat(F.lit("Which?\nOptions:\n(A) one"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("\n (B) two "), i)).otherwise(""))
    return ad.table(spark, d, "benchmark").select("item_id", F.array_join(op.listed_choices(text), "|").alias("choices"), F.array_join(op.inline_options(question), "|").alias("options"))


@query("pending_head", """WITH p AS (SELECT o_orderkey AS uid FROM orders ANTI JOIN (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R') USING (o_orderkey)) SELECT uid FROM p ORDER BY uid LIMIT 25""")
def pending_head(spark, d):
    log = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uid"), (F.col("l_returnflag") != "R").alias("failed"))
    return rec.pending(ad.records(spark, d).select("uid"), log, "uid", "failed").orderBy("uid").limit(25)


@query("cell_order", f"WITH {C}, m AS (SELECT model, config, seed, sum(k) / CAST(sum(n) AS DOUBLE) AS accuracy FROM c GROUP BY ALL) SELECT model, config, seed, round(accuracy, 6) AS accuracy, row_number() OVER (ORDER BY model, accuracy DESC, config, seed) AS place FROM m")
def cell_order(spark, d):
    from pyspark.sql import Window

    m = cl.cells(ad.samples(spark, d)).groupBy("model", "config", "seed").agg(st.ratio(F.sum("k"), F.sum("n")).alias("accuracy"))
    place = F.row_number().over(Window.orderBy("model", F.desc("accuracy"), "config", "seed")).cast("long")  # one row a run: few
    return m.select("model", "config", "seed", r6("accuracy").alias("accuracy"), place.alias("place"))


@query("hard_half_jaccard", f"""WITH {C}, p AS (SELECT *, k / CAST(n AS DOUBLE) AS p FROM c WHERE config = 'c0'),
r AS (SELECT model, seed, row_number() OVER (PARTITION BY model, seed ORDER BY p, item) AS a, row_number() OVER (PARTITION BY model, seed ORDER BY abs(2 * p - 1), item) AS b, greatest(1, CAST(round_even(0.5 * count(*) OVER (PARTITION BY model, seed), 0) AS INT)) AS z FROM p)
SELECT model, seed, round(count(*) FILTER (a <= z AND b <= z) / CAST(count(*) FILTER (a <= z OR b <= z) AS DOUBLE), 6) AS jaccard FROM r GROUP BY ALL""")
def hard_half_jaccard(spark, d):
    return op.hard_halves(cl.cells(ad.samples(spark, d)).where("config = 'c0'"), ["model", "seed"]).withColumn("jaccard", r6("jaccard"))


@query("control_methods", f"""WITH RECURSIVE {S}, {_draw_sql('200')}, u AS (SELECT model, seed, item, replicate, max(CAST(correct AS INT)) AS o, CAST(arg_min(correct, md5(concat_ws('-', model, seed, item, replicate, config))) AS INT) AS r FROM dr GROUP BY ALL),
b AS (SELECT model, seed, max(x) AS best FROM (SELECT model, seed, config, avg(CAST(correct AS INT)) AS x FROM dr GROUP BY ALL) GROUP BY ALL)
SELECT model, seed, round(avg(o), 6) AS oracle_config, round(avg(r), 6) AS random_config, round(any_value(best), 6) AS best_single FROM u JOIN b USING (model, seed) GROUP BY ALL""")
def control_methods(spark, d):
    draws = _draws(bu.pools(ad.samples(spark, d), BY, 3), F.lit(200))
    return op.controls(draws, ["model", "seed"], ["item", "replicate"]).withColumns({x: r6(x) for x in ("oracle_config", "random_config", "best_single")})
