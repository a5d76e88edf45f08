"""Queries on samples and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import stats as st
from tallyframe.operators import cells as op
from tallyframe.plans.base_sql import C, M, S
from tallyframe.plans.registry import query
from tallyframe.sources import adapters as ad

r6 = st.r6
BY = ["model", "config", "seed"]
PASS_K = "CASE WHEN k = 0 THEN 0.0 WHEN n - k < {0} THEN 1.0 ELSE 1 - exp(lgamma(n - k + 1) - lgamma(n - k - {0} + 1) - lgamma(n + 1) + lgamma(n - {0} + 1)) END"


@query("cells", f"""WITH {C} SELECT item, model, config, seed, n, k, tokens, fails, round(k / CAST(n AS DOUBLE), 6) AS p_hat, round(ln((k + 0.5) / (n - k + 0.5)), 6) AS z,
  round(1 / (k + 0.5) + 1 / (n - k + 0.5), 6) AS sampling_var, k = 0 OR k = n AS saturated, round(fails / CAST(n AS DOUBLE), 6) AS failure_rate FROM c""")
def cells(spark, d):
    c = op.cell_stats(op.cells(ad.samples(spark, d)))
    return c.withColumns({x: r6(x) for x in ("p_hat", "z", "sampling_var", "failure_rate")})


@query("modal_class", f"WITH {M} SELECT item, model, config, seed, mode, mode_ok, tie, round(margin, 6) AS margin, n FROM m")
def modal_class(spark, d):
    return op.modes(ad.samples(spark, d)).withColumn("margin", r6("margin"))


@query("select_filtered_cells", f"WITH {C} SELECT item, seed, n, k FROM c WHERE model IN ('A', 'N') AND config = 'c1'")
def select_filtered_cells(spark, d):
    return op.select_cells(op.cells(ad.samples(spark, d)), model=["A", "N"], config="c1").select("item", "seed", "n", "k")


@query("corpus_levels", f"""WITH {S} SELECT DISTINCT 'model' AS factor, model AS level FROM s UNION SELECT DISTINCT 'config', config FROM s
UNION SELECT DISTINCT 'seed', CAST(seed AS VARCHAR) FROM s UNION SELECT DISTINCT 'item', item FROM s""")
def corpus_levels(spark, d):
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in ("model", "config", "seed", "item")]))
    return ad.samples(spark, d).select(pairs.alias("x")).select("x.factor", "x.level").distinct()


@query("drop_unparsed", f"WITH {S} SELECT item, model, config, seed, count(*) AS n, count(*) FILTER (cls = 'gold') AS k FROM s WHERE cls <> '<unparsed>' GROUP BY ALL")
def drop_unparsed(spark, d):
    return op.cells(op.drop_unparsed(ad.samples(spark, d))).select(*ad.CELL, "n", "k")


@query("zero_failure_items", f"WITH {S} SELECT item, model, seed FROM s GROUP BY ALL HAVING count(*) FILTER (cls = '<unparsed>') = 0")
def zero_failure_items(spark, d):
    return op.items_without_failures(ad.samples(spark, d), ["item", "model", "seed"])


@query("corpus_summary", f"""WITH {M} SELECT count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_samples, count(DISTINCT item) AS n_items, count(DISTINCT model) AS n_models,
  count(DISTINCT config) AS n_configs, count(DISTINCT seed) AS n_seeds, round(avg(CASE WHEN k = 0 OR k = n THEN 1.0 ELSE 0.0 END), 6) AS saturated_rate,
  round(sum(fails) / CAST(sum(n) AS DOUBLE), 6) AS failure_rate, round(max(fails / CAST(n AS DOUBLE)), 6) AS most_failures, count(*) FILTER (fails / CAST(n AS DOUBLE) > 0.05) AS n_cells_failing,
  round(avg(CASE WHEN tie THEN 1.0 ELSE 0.0 END), 6) AS tie_rate FROM m""")
def corpus_summary(spark, d):
    m, rate = op.with_modes(ad.samples(spark, d)), st.ratio(F.col("fails"), F.col("n"))
    return m.agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_samples"), *[F.countDistinct(c).alias(f"n_{c}s") for c in ("item", "model", "config", "seed")],
        r6(F.avg(st.saturated(F.col("k"), F.col("n")).cast("int"))).alias("saturated_rate"), r6(st.ratio(F.sum("fails"), F.sum("n"))).alias("failure_rate"),
        r6(F.max(rate)).alias("most_failures"), F.count_if(rate > 0.05).alias("n_cells_failing"), r6(F.avg(F.col("tie").cast("int"))).alias("tie_rate"),
    )


P = "p AS (SELECT l_partkey AS item, l_returnflag AS model, l_linestatus AS config, count(*) AS n, count(*) FILTER (l_quantity > {0}) AS k FROM lineitem GROUP BY ALL)"
CROSSED = "x AS (SELECT item FROM p GROUP BY item HAVING count(*) = (SELECT count(DISTINCT model) * count(DISTINCT config) FROM p))"


@query("crossed_items", f"WITH {P.format(25)}, {CROSSED} SELECT item FROM x")
def crossed_items(spark, d):
    return op.crossed_items(ad.part_counts(spark, d))


@query("design_report", f"""WITH {P.format(25)}, {CROSSED} SELECT count(DISTINCT item) AS n_items, count(DISTINCT model) AS n_models, count(DISTINCT config) AS n_configs,
  (SELECT count(*) FROM x) AS n_crossed, count(DISTINCT item) - (SELECT count(*) FROM x) AS n_dropped, count(DISTINCT item) = (SELECT count(*) FROM x) AS balanced,
  min(n) AS least_samples, max(n) AS most_samples, count(DISTINCT n) > 1 AS ragged FROM p""")
def design_report(spark, d):
    return op.design_report(ad.part_counts(spark, d))


@query("censoring", f"""WITH {P.format(45)}, i AS (SELECT item, bool_and(k = 0) AS zero, bool_and(k = n) AS one, bool_and(k = 0 OR k = n) AS sat FROM p GROUP BY item)
SELECT count(*) AS n_items, count(*) FILTER (sat) AS n_saturated, count(*) FILTER (zero) AS n_all_zero, count(*) FILTER (one) AS n_all_one, count(*) FILTER (NOT sat) AS n_kept FROM i""")
def censoring(spark, d):
    k, n = F.col("k"), F.col("n")
    i = ad.part_counts(spark, d, 45).groupBy("item").agg(F.bool_and(k == 0).alias("zero"), F.bool_and(k == n).alias("one"), F.bool_and(st.saturated(k, n)).alias("sat"))
    return i.agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if("sat").alias("n_saturated"), F.count_if("zero").alias("n_all_zero"), F.count_if("one").alias("n_all_one"), F.count_if(~F.col("sat")).alias("n_kept")
    )


@query("failure_rates", f"""WITH {S} SELECT config, count(*) AS n, round(count(*) FILTER (cls = '<unparsed>') / CAST(count(*) AS DOUBLE), 6) AS failure_rate,
  round(count(*) FILTER (tok > 60) / CAST(count(*) AS DOUBLE), 6) AS truncation_rate FROM s GROUP BY config""")
def failure_rates(spark, d):
    s = ad.samples(spark, d).withColumn("finish_reason", F.when(F.col("tok") > 60, "Length").otherwise("stop"))
    cut = F.lower("finish_reason").isin("length", "max_tokens")
    return s.groupBy("config").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("cls") == ad.UNPARSED).cast("int"))).alias("failure_rate"), r6(F.avg(cut.cast("int"))).alias("truncation_rate"))


CEIL = f"""{M}, z AS (SELECT *, min(n) OVER (PARTITION BY model, config, seed) AS n_min FROM m),
ceil AS (SELECT model, config, seed, count(*) AS n_items, min(n_min) AS n_min, avg(k / CAST(n AS DOUBLE)) AS avg_at_1, avg(CASE WHEN mode_ok THEN 1.0 ELSE 0.0 END) AS pi_mode,
  avg({PASS_K.format('n_min')}) AS pass_at_n, avg(CASE WHEN tie THEN 1.0 ELSE 0.0 END) AS tie_rate, sum(fails) / CAST(sum(n) AS DOUBLE) AS failure_rate,
  avg(CASE WHEN mode = '<unparsed>' THEN 1.0 ELSE 0.0 END) AS unparsed_mode_rate, avg(CASE WHEN k = 0 OR k = n THEN 1.0 ELSE 0.0 END) AS saturated_rate, avg(margin) AS mean_margin,
  sum(tokens) / CAST(sum(n) AS DOUBLE) AS tokens_per_sample FROM z GROUP BY ALL)"""
_RATES = ("avg_at_1", "pi_mode", "pass_at_n", "tie_rate", "failure_rate", "unparsed_mode_rate", "saturated_rate", "mean_margin", "tokens_per_sample")


@query("ceiling_rows", f"WITH {CEIL} SELECT model, config, seed, n_items, n_min, {', '.join(f'round({x}, 6) AS {x}' for x in _RATES)}, round(pass_at_n - pi_mode, 6) AS gap FROM ceil")
def ceiling_rows(spark, d):
    return op.ceilings(op.with_modes(ad.samples(spark, d)), BY).withColumns({x: r6(x) for x in (*_RATES, "gap")})


@query("ceiling_spread", f"""WITH {CEIL} SELECT model, seed, round((max(pi_mode) - min(pi_mode)) * 100, 6) AS spread_points, arg_max(config, pi_mode * 1e6 - ascii(substr(config, 2))) AS best_config,
  arg_min(config, pi_mode * 1e6 + ascii(substr(config, 2))) AS worst_config, round((max(pi_mode) - min(pi_mode)) * 100, 9) > 3 AS supported FROM ceil GROUP BY ALL""")
def ceiling_spread(spark, d):
    rows = op.ceilings(op.with_modes(ad.samples(spark, d)), BY)
    return op.ceiling_spread(rows, ["model", "seed"]).withColumn("spread_points", r6("spread_points"))


@query("union_ceiling", f"""WITH {M}, f AS (SELECT model, seed, item, bool_or(mode_ok) AS any_ok FROM m GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT config) FROM m)),
b AS (SELECT model, seed, config, avg(CASE WHEN mode_ok THEN 1.0 ELSE 0.0 END) AS rate FROM m JOIN f USING (model, seed, item) GROUP BY ALL)
SELECT model, seed, count(*) AS n_items, round(avg(CASE WHEN any_ok THEN 1.0 ELSE 0.0 END), 6) AS union_rate, round((SELECT max(rate) FROM b WHERE b.model = f.model AND b.seed = f.seed), 6) AS best_single,
  round(avg(CASE WHEN any_ok THEN 1.0 ELSE 0.0 END) - (SELECT max(rate) FROM b WHERE b.model = f.model AND b.seed = f.seed), 6) AS headroom FROM f GROUP BY model, seed""")
def union_ceiling(spark, d):
    got = op.union_ceiling(op.with_modes(ad.samples(spark, d)), ["model", "seed"])
    return got.withColumns({x: r6(x) for x in ("union_rate", "best_single", "headroom")})


@query("mixture_pi_mode", f"""WITH {S}, k AS (SELECT model, seed, item, config, cls, count(*) AS cnt, min(idx) AS f FROM s GROUP BY ALL),
h AS (SELECT *, cnt / CAST(sum(cnt) OVER (PARTITION BY model, seed, item, config) AS DOUBLE) AS share FROM k),
p AS (SELECT model, seed, item, cls, round(sum(share), 9) AS mass, min(config) AS fc, min(CASE WHEN config = (SELECT 'c0') THEN f END) AS f0 FROM h GROUP BY ALL),
q AS (SELECT p.*, (SELECT min(f) FROM h WHERE h.model = p.model AND h.seed = p.seed AND h.item = p.item AND h.cls = p.cls AND h.config = p.fc) AS ff FROM p),
mix AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY model, seed, item ORDER BY mass DESC, fc, ff) = 1),
own AS (SELECT * FROM k WHERE config = 'c0' QUALIFY row_number() OVER (PARTITION BY model, seed, item ORDER BY cnt DESC, f) = 1)
SELECT model, seed, count(*) AS n_items, round(avg(CASE WHEN own.cls = 'gold' THEN 1.0 ELSE 0.0 END), 6) AS pi_reference, round(avg(CASE WHEN mix.cls = 'gold' THEN 1.0 ELSE 0.0 END), 6) AS pi_mixture
FROM own JOIN mix USING (model, seed, item) GROUP BY ALL""")
def mixture_pi_mode(spark, d):
    per = op.mixture_modes(ad.samples(spark, d), "c0", ["model", "seed"])
    return per.groupBy("model", "seed").agg(
        F.count(F.lit(1)).alias("n_items"), r6(F.avg(F.col("reference_ok").cast("int"))).alias("pi_reference"), r6(F.avg(F.col("mixture_ok").cast("int"))).alias("pi_mixture")
    )


TR = f"""{M}, tr AS (SELECT a.model, a.seed, a.item, a.config AS config_a, b.config AS config_b, a.mode <> b.mode AS reordered, a.mode_ok AS ok_a, b.mode_ok AS ok_b, a.margin AS margin_a, b.margin AS margin_b,
  CASE WHEN a.mode = b.mode THEN 'stable' WHEN NOT a.mode_ok AND b.mode_ok THEN 'corrective' WHEN a.mode_ok AND NOT b.mode_ok THEN 'destructive' ELSE 'benign' END AS kind
  FROM m a JOIN m b ON a.model = b.model AND a.seed = b.seed AND a.item = b.item AND a.config < b.config)"""


@query("transition_items", f"WITH {TR} SELECT model, seed, item, config_a, config_b, reordered, kind, ok_a, ok_b, round(margin_a, 6) AS margin_a, round(margin_b, 6) AS margin_b FROM tr")
def transition_items(spark, d):
    got = op.transitions(op.modes(ad.samples(spark, d)), ["model", "seed"])
    return got.withColumns({x: r6(x) for x in ("margin_a", "margin_b")})


_I = "CASE WHEN {0} THEN 1.0 ELSE 0.0 END"


@query("transition_rows", f"""WITH {TR} SELECT model, seed, config_a, config_b, count(*) AS n_items, round(avg({_I.format('reordered')}), 6) AS reorder_rate, count(*) FILTER (kind = 'corrective') AS corrective,
  count(*) FILTER (kind = 'destructive') AS destructive, count(*) FILTER (kind = 'benign') AS benign, round(avg({_I.format('ok_a')}), 6) AS pi_a, round(avg({_I.format('ok_b')}), 6) AS pi_b,
  round(avg(margin_a) FILTER (reordered), 6) AS margin_reordered, round(avg(margin_a) FILTER (NOT reordered), 6) AS margin_stable,
  round(avg({_I.format('reordered')}) FILTER (margin_a < 0.25), 6) AS reorder_small_margin, round(avg({_I.format('reordered')}) FILTER (margin_a >= 0.25), 6) AS reorder_large_margin,
  count(*) FILTER (kind = 'corrective') - count(*) FILTER (kind = 'destructive') AS net FROM tr GROUP BY ALL HAVING count(*) >= 4""")
def transition_rows(spark, d):
    got = op.transition_rows(op.transitions(op.modes(ad.samples(spark, d)), ["model", "seed"]), ["model", "seed"])
    return got.withColumns({x: r6(x) for x in ("reorder_rate", "pi_a", "pi_b", "margin_reordered", "margin_stable", "reorder_small_margin", "reorder_large_margin")})


@query("reorder_by_margin_bin", f"""WITH {TR} SELECT config_a, config_b, CASE WHEN margin_a < 0.125 THEN 0 WHEN margin_a < 0.25 THEN 1 WHEN margin_a < 0.5 THEN 2 WHEN margin_a < 0.75 THEN 3 ELSE 4 END AS bin,
  count(*) AS n, round(avg({_I.format('reordered')}), 6) AS reorder_rate FROM tr GROUP BY ALL""")
def reorder_by_margin_bin(spark, d):
    t = op.transitions(op.modes(ad.samples(spark, d)), ["model", "seed"]).withColumn("bin", op.bin_of(F.col("margin_a"), op.MARGIN_EDGES))
    return t.groupBy("config_a", "config_b", "bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("reordered").cast("int"))).alias("reorder_rate"))


@query("mann_whitney_u", f"""WITH {TR}, w AS (SELECT *, rank() OVER (PARTITION BY config_a, config_b ORDER BY margin_a) + (count(*) OVER (PARTITION BY config_a, config_b, margin_a) - 1) / 2.0 AS rnk FROM tr)
SELECT config_a, config_b, count(*) FILTER (reordered) AS n_a, count(*) FILTER (NOT reordered) AS n_b,
  round(sum(rnk) FILTER (reordered) - count(*) FILTER (reordered) * (count(*) FILTER (reordered) + 1) / 2.0, 6) AS u,
  round((sum(rnk) FILTER (reordered) - count(*) FILTER (reordered) * (count(*) FILTER (reordered) + 1) / 2.0) / (count(*) FILTER (reordered) * count(*) FILTER (NOT reordered)), 6) AS auc FROM w GROUP BY ALL""")
def mann_whitney_u(spark, d):
    t = op.transitions(op.modes(ad.samples(spark, d)), ["model", "seed"])
    got = op.mann_whitney(t, ["config_a", "config_b"], "margin_a", F.col("reordered"))
    return got.select("config_a", "config_b", "n_a", "n_b", r6("u").alias("u"), r6("auc").alias("auc"))


KS = (1, 2, 4, 8, 16, 32)


@query("pass_at_k_curve", f"""WITH {C}, ks AS (SELECT unnest([1, 2, 4, 8, 16, 32]) AS kk) SELECT model, config, kk AS k, count(*) AS n_records, round(avg({PASS_K.format('kk')}), 6) AS value
FROM c, ks WHERE n >= kk GROUP BY ALL""")
def pass_at_k_curve(spark, d):
    c = op.cells(ad.samples(spark, d)).withColumn("kk", F.explode(F.array(*[F.lit(k) for k in KS]))).where("n >= kk")
    got = c.groupBy("model", "config", F.col("kk").alias("at"))
    return got.agg(F.count(F.lit(1)).alias("n_records"), r6(F.avg(st.pass_at_k(F.col("n"), F.col("k"), F.col("kk")))).alias("value")).withColumnRenamed("at", "k")


def _vote_sql(k: str, order: str, extra: str = "", source: str = "s") -> str:
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {extra} item, model, config, seed ORDER BY {order}) - 1 AS pos, count(*) OVER (PARTITION BY {extra} item, model, config, seed) AS n FROM {source}),
tk AS (SELECT * FROM o WHERE pos < {k} AND n >= {k}),
v AS (SELECT {extra} item, model, config, seed, cls, count(*) AS cnt, min(pos) AS f FROM tk WHERE cls <> '<unparsed>' GROUP BY ALL),
wn AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY {extra} item, model, config, seed ORDER BY cnt DESC, f) = 1),
res AS (SELECT k.*, cls = 'gold' AS correct FROM (SELECT DISTINCT {extra} item, model, config, seed FROM tk) k LEFT JOIN wn USING ({extra} item, model, config, seed))"""


@query("majority_vote_at_k", f"WITH {S}, {_vote_sql('5', 'idx')} SELECT item, model, config, seed, correct FROM res")
def majority_vote_at_k(spark, d):
    return op.vote_at_k(ad.samples(spark, d), 5)


@query("majority_accuracy_curve", f"""WITH {S}, s3 AS (SELECT s.*, kk, rep FROM s, (SELECT unnest([1, 4, 8]) AS kk), (SELECT unnest(range(0, 5)) AS rep)),
{_vote_sql('kk', "md5(concat_ws('-', rep, item, model, config, seed, idx)), idx", 'kk, rep,', 's3')}
SELECT model, config, kk AS k, count(*) AS n_votes, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS value FROM res GROUP BY ALL""")
def majority_accuracy_curve(spark, d):
    s = ad.samples(spark, d)
    votes = op.sampled_votes(s, (1, 4, 8), 5)
    return votes.groupBy("model", "config", "k").agg(F.count(F.lit(1)).alias("n_votes"), r6(F.avg(st.flag("correct"))).alias("value"))


@query("precision_delta", f"""WITH {CEIL}, a AS (SELECT * FROM ceil WHERE seed = 0), b AS (SELECT * FROM ceil WHERE seed = 1)
SELECT model, config, round(b.avg_at_1 - a.avg_at_1, 6) AS delta_avg, round(b.pi_mode - a.pi_mode, 6) AS delta_pi_mode, round(b.mean_margin - a.mean_margin, 6) AS delta_margin,
  abs(round(b.avg_at_1 - a.avg_at_1, 9)) > 0.05 OR abs(round(b.mean_margin - a.mean_margin, 9)) > 0.10 AS moved FROM a JOIN b USING (model, config)""")
def precision_delta(spark, d):
    rows = op.ceilings(op.with_modes(ad.samples(spark, d)), BY)
    change = lambda c: F.max(F.when(F.col("seed") == 1, F.col(c))) - F.max(F.when(F.col("seed") == 0, F.col(c)))
    got = rows.groupBy("model", "config").agg(change("avg_at_1").alias("a"), change("pi_mode").alias("p"), change("mean_margin").alias("m"))
    moved = (F.abs(F.round("a", 9)) > 0.05) | (F.abs(F.round("m", 9)) > 0.10)
    return got.select("model", "config", r6("a").alias("delta_avg"), r6("p").alias("delta_pi_mode"), r6("m").alias("delta_margin"), moved.alias("moved"))
