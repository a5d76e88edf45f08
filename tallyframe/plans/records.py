"""Queries on logs and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import identity as ident
from tallyframe.functions import stats as st
from tallyframe.operators import records as op
from tallyframe.plans.base_sql import C, L, R
from tallyframe.plans.registry import query
from tallyframe.sources import adapters as ad

r6 = st.r6


@query("dedupe_last_wins", f"""WITH {L} SELECT uid, max(line_no) AS line_no, min(line_no) AS first_seen,
  round(arg_max(value, line_no), 6) AS value, arg_max(failed, line_no) AS failed FROM l GROUP BY uid""")
def dedupe_last_wins(spark, d):
    return op.last_wins(ad.log(spark, d), "uid", "line_no").select("uid", "line_no", "first_seen", r6("value").alias("value"), "failed")


@query("duplicate_uids", f"WITH {L} SELECT uid, count(*) AS n FROM l GROUP BY uid HAVING count(*) > 1")
def duplicate_uids(spark, d):
    return op.repeated_keys(ad.log(spark, d), "uid")


@query("resume_anti_join", f"""WITH {L}, p AS (SELECT DISTINCT user_id || '-' || unnest(['click', 'error', 'view', 'retry']) AS uid FROM l)
SELECT uid FROM p WHERE uid NOT IN (SELECT uid FROM l WHERE NOT failed)""")
def resume_anti_join(spark, d):
    log = ad.log(spark, d)
    kinds = F.explode(F.array(*[F.lit(x) for x in ("click", "error", "view", "retry")])).alias("kind")
    planned = log.select("user_id").distinct().select("user_id", kinds).select(F.concat_ws("-", F.col("user_id").cast("string"), "kind").alias("uid"))
    return op.pending(planned, log, "uid", "failed")


@query("grade_cache_anti_join", f"""WITH {L}, g AS (SELECT uid, arg_max(line_no % 3, line_no) AS v FROM l WHERE line_no % 5 <> 0 GROUP BY uid)
SELECT DISTINCT l.uid FROM l LEFT JOIN g USING (uid) WHERE v IS DISTINCT FROM 2""")
def grade_cache_anti_join(spark, d):
    log = ad.log(spark, d)
    graded = log.where("line_no % 5 <> 0").select("uid", "line_no", (F.col("line_no") % 3).alias("version"))
    return op.ungraded(log.select("uid").distinct(), graded, "uid", "version", "line_no", 2)


@query("stable_uid", f"""WITH {R} SELECT uid AS idx, substr(sha256('{{"config_hash": "abc123", "dataset": "orders", "index": ' || uid || ', "model": "mock/tiny", "schema": 1, "seed": 0, "strategy": "' || strategy || '"}}'), 1, 16) AS uid FROM r""")
def stable_uid(spark, d):
    r = ad.records(spark, d)
    uid = ident.stable_uid(F.lit("mock/tiny"), F.col("strategy"), F.lit("orders"), F.col("uid"), F.lit(0), F.lit("abc123"))
    return r.select(F.col("uid").alias("idx"), uid.alias("uid"))


@query("shard_strided", f"""WITH {R}, p AS (SELECT uid, row_number() OVER (ORDER BY example, uid) - 1 AS position FROM r)
SELECT uid, position FROM p WHERE position % 4 = 1""")
def shard_strided(spark, d):
    placed = op.with_position(ad.records(spark, d).select("uid", "example"), "example", "uid")
    return op.shard(placed, 1, 4).select("uid", "position")


@query("example_seed", f"WITH {R} SELECT uid, (17 * 1000003 + uid * 7919) % 2147483647 AS seed FROM r")
def example_seed(spark, d):
    return ad.records(spark, d).select("uid", ident.example_seed(F.lit(17), F.col("uid")).alias("seed"))


@query("expand_design", f"""WITH {C} SELECT m.model, g.config, e.seed, (SELECT count(DISTINCT item) FROM s) AS n_items, (SELECT count(DISTINCT item) FROM s) * 24 AS n_samples
FROM (SELECT DISTINCT model FROM s) m, (SELECT DISTINCT config FROM s) g, (SELECT DISTINCT seed FROM s) e""")
def expand_design(spark, d):
    s = ad.samples(spark, d)
    sets = s.agg(*[F.collect_set(c).alias(c) for c in ("model", "config", "seed")], F.countDistinct("item").alias("n_items"))
    for c in ("model", "config", "seed"):
        sets = sets.withColumn(c, F.explode(c))
    return sets.select("model", "config", "seed", "n_items", (F.col("n_items") * 24).alias("n_samples"))


ACC = "count(*) AS n, CAST(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT) AS k"


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    z = st.Z95
    mid = f"(({k}) / CAST({n} AS DOUBLE) + {z * z / 2} / {n}) / (1 + {z * z} / {n})"
    half = f"{z} * sqrt(({k}) / CAST({n} AS DOUBLE) * (1 - ({k}) / CAST({n} AS DOUBLE)) / {n} + {z * z / 4} / {n} / {n}) / (1 + {z * z} / {n})"
    return f"round(greatest(0.0, {mid} - {half}), 6)", f"round(least(1.0, {mid} + {half}), 6)"


LOW, HIGH = _wilson_sql("k", "n")


@query("run_accuracy", f"WITH {R} SELECT strategy, n, k AS n_correct, round(k / CAST(n AS DOUBLE), 6) AS accuracy FROM (SELECT strategy, {ACC} FROM r GROUP BY strategy)")
def run_accuracy(spark, d):
    return op.accuracy_summary(ad.records(spark, d), ["strategy"]).select("strategy", "n", "n_correct", r6("accuracy").alias("accuracy"))


@query("wilson_ci", f"WITH {R}, x AS (SELECT strategy, {ACC} FROM r GROUP BY strategy) SELECT strategy, {LOW} AS ci_low, {HIGH} AS ci_high FROM x")
def wilson_ci(spark, d):
    return op.accuracy_summary(ad.records(spark, d), ["strategy"]).select("strategy", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


@query("token_cost", f"""WITH {R} SELECT strategy, count(*) AS n, CAST(sum(20 + uid % 7) AS BIGINT) AS total_prompt, CAST(sum(tokens) AS BIGINT) AS total_completion,
  CAST(sum(20 + uid % 7 + tokens) AS BIGINT) AS total, round(avg(20 + uid % 7), 6) AS mean_prompt, round(avg(tokens), 6) AS mean_completion,
  round(avg(20 + uid % 7 + tokens), 6) AS mean_total, round(avg(coalesce(CASE WHEN uid % 3 = 0 THEN NULL ELSE uid % 3 END, 0)), 6) AS mean_calls FROM r GROUP BY strategy""")
def token_cost(spark, d):
    calls = F.when(F.col("uid") % 3 != 0, F.col("uid") % 3)
    got = op.token_cost(ad.records(spark, d), ["strategy"], 20 + F.col("uid") % 7, F.col("tokens"), calls)
    return got.select(*[r6(c).alias(c) if c.startswith("mean") else F.col(c) for c in got.columns])


@query("tokens_per_correct", f"""WITH {R} SELECT strategy, example % 40 AS grp,
  CASE WHEN count(*) FILTER (is_correct) = 0 THEN CAST('infinity' AS DOUBLE) ELSE round(sum(tokens) / CAST(count(*) FILTER (is_correct) AS DOUBLE), 6) END AS tokens_per_correct
  FROM r GROUP BY ALL""")
def tokens_per_correct(spark, d):
    r = ad.records(spark, d).withColumn("grp", F.col("example") % 40)
    return op.tokens_per_correct(r, ["strategy", "grp"], "tokens").withColumn("tokens_per_correct", r6("tokens_per_correct"))


@query("accuracy_vs_compute", f"""WITH {R} SELECT strategy AS setting, round(avg(tokens), 6) AS x, round(avg(CASE WHEN is_correct THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n
FROM r GROUP BY strategy""")
def accuracy_vs_compute(spark, d):
    got = ad.records(spark, d).groupBy(F.col("strategy").alias("setting"))
    return got.agg(r6(F.avg("tokens")).alias("x"), r6(F.avg(st.flag("is_correct"))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("summarize_run", f"""WITH {C}, x AS (SELECT model, config, seed, count(*) AS n_records, count(*) FILTER (2 * k > n) AS k, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens,
  max(n) AS max_samples, min(n) AS min_samples, CAST(sum(fails) AS BIGINT) AS failures, avg(k / CAST(n AS DOUBLE)) AS p1, avg(CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END) AS pm FROM c GROUP BY ALL)
SELECT model, config, seed, n_records, k AS n_correct, round(k / CAST(n AS DOUBLE), 6) AS accuracy, {LOW} AS ci_low, {HIGH} AS ci_high, tokens AS total_tokens,
  round(tokens / CAST(n AS DOUBLE), 6) AS mean_tokens, max_samples, min_samples, failures, round(p1, 6) AS pass_at_1, round(pm, 6) AS pass_at_n FROM x""")
def summarize_run(spark, d):
    from tallyframe.operators import cells as cl

    c = cl.cells(ad.samples(spark, d)).withColumn("is_correct", 2 * F.col("k") > F.col("n"))
    got = c.groupBy("model", "config", "seed").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if("is_correct").alias("n_correct"), F.sum("tokens").alias("total_tokens"), F.max("n").alias("max_samples"),
        F.min("n").alias("min_samples"), F.sum("fails").alias("failures"), r6(F.avg(st.pass_at_k(F.col("n"), F.col("k"), F.lit(1)))).alias("pass_at_1"),
        r6(F.avg(st.pass_at_k(F.col("n"), F.col("k"), F.col("n")))).alias("pass_at_n"),
    )
    low, high = st.wilson(F.col("n_correct"), F.col("n_records"))
    return got.withColumns({
        "accuracy": r6(st.ratio(F.col("n_correct"), F.col("n_records"))), "ci_low": r6(low), "ci_high": r6(high),
        "mean_tokens": r6(st.ratio(F.col("total_tokens"), F.col("n_records"))),
    })


@query("aggregate_seeds", f"""WITH {C}, a AS (SELECT model, config, seed, avg(CASE WHEN 2 * k > n THEN 1.0 ELSE 0.0 END) AS acc FROM c GROUP BY ALL)
SELECT model, config, count(*) AS n_seeds, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS sd, round(min(acc), 6) AS least, round(max(acc), 6) AS most,
  round(greatest(0.0, avg(acc) - 1.96 * stddev_samp(acc) / sqrt(count(*))), 6) AS ci_low, round(least(1.0, avg(acc) + 1.96 * stddev_samp(acc) / sqrt(count(*))), 6) AS ci_high
FROM a GROUP BY ALL""")
def aggregate_seeds(spark, d):
    from tallyframe.operators import cells as cl

    a = cl.cells(ad.samples(spark, d)).groupBy("model", "config", "seed").agg(F.avg((2 * F.col("k") > F.col("n")).cast("int")).alias("acc"))
    got = a.groupBy("model", "config").agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("acc").alias("mean"), F.stddev_samp("acc").alias("sd"), F.min("acc").alias("least"), F.max("acc").alias("most"))
    half = 1.96 * F.col("sd") / F.sqrt("n_seeds")
    return got.select(
        "model", "config", "n_seeds", *[r6(c).alias(c) for c in ("mean", "sd", "least", "most")],
        r6(F.greatest(F.lit(0.0), F.col("mean") - half)).alias("ci_low"), r6(F.least(F.lit(1.0), F.col("mean") + half)).alias("ci_high"),
    )


PAIRS = f"""{R}, w AS (SELECT * FROM r WHERE strategy IN ('1-URGENT', '5-LOW') QUALIFY row_number() OVER (PARTITION BY example, strategy ORDER BY uid DESC) = 1),
a AS (SELECT example, CAST(is_correct AS INT) AS a FROM w WHERE strategy = '1-URGENT'), b AS (SELECT example, CAST(is_correct AS INT) AS b FROM w WHERE strategy = '5-LOW'),
j AS (SELECT example, a, b FROM a FULL JOIN b USING (example)),
x AS (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_pairs, count(*) FILTER (b IS NULL) AS n_only_a, count(*) FILTER (a IS NULL) AS n_only_b,
  avg(a) FILTER (b IS NOT NULL) AS aa, avg(b) FILTER (a IS NOT NULL) AS ab, count(*) FILTER (a = 0 AND b = 1) AS b01, count(*) FILTER (a = 1 AND b = 0) AS b10 FROM j)"""
TAIL = "CASE WHEN b01 + b10 = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(b01 + b10 + 1) - lgamma(i + 1) - lgamma(b01 + b10 - i + 1) - (b01 + b10) * ln(2))) FROM range(0, least(b01, b10) + 1) t(i))) END"


@query("compare_strategies", f"""WITH {PAIRS} SELECT n_pairs, n_only_a, n_only_b, round(aa, 6) AS accuracy_a, round(ab, 6) AS accuracy_b, b01, b10, round(ab - aa, 6) AS delta,
  round({TAIL}, 6) AS p_value FROM x""")
def compare_strategies(spark, d):
    got = op.comparison(op.paired(ad.records(spark, d), ["example"], "uid", "strategy", "1-URGENT", "5-LOW"))
    return got.select("n_pairs", "n_only_a", "n_only_b", *[r6(c).alias(c) for c in ("accuracy_a", "accuracy_b", "delta", "p_value")], "b01", "b10")


@query("mcnemar_exact", f"""WITH x AS (SELECT doc_id % 10 AS grp, count(*) AS n_pairs, count(*) FILTER (quality = 0 AND toxic = 1) AS b01, count(*) FILTER (quality = 1 AND toxic = 0) AS b10
  FROM labels GROUP BY ALL) SELECT grp, n_pairs, b01, b10, round({TAIL}, 6) AS p_value, round(power(greatest(abs(b01 - b10) - 1, 0), 2) / nullif(b01 + b10, 0), 6) AS chi2 FROM x""")
def mcnemar_exact(spark, d):
    t = ad.table(spark, d, "labels").select((F.col("doc_id") % 10).alias("grp"), F.col("quality").alias("a"), F.col("toxic").alias("b"), F.lit(True).alias("in_a"), F.lit(True).alias("in_b"))
    got = op.comparison(t, ["grp"])
    return got.select("grp", "n_pairs", "b01", "b10", r6("p_value").alias("p_value"), r6(st.mcnemar_chi2(F.col("b01"), F.col("b10"))[0]).alias("chi2"))


@query("mcnemar_corrected", f"""WITH x AS (SELECT doc_id % 3 AS grp, count(*) FILTER (quality = 0 AND toxic = 1) AS b01, count(*) FILTER (quality = 1 AND toxic = 0) AS b10 FROM labels GROUP BY ALL),
y AS (SELECT *, power(greatest(abs(b01 - b10) - 1, 0), 2) / (b01 + b10) AS chi2 FROM x WHERE b01 + b10 > 0)
SELECT grp, CASE WHEN b01 + b10 >= 25 THEN 'chi2_1df_continuity_corrected' ELSE 'exact_binomial' END AS method, round(CASE WHEN b01 + b10 >= 25 THEN chi2 ELSE least(b01, b10) END, 6) AS statistic FROM y""")
def mcnemar_corrected(spark, d):
    t = ad.table(spark, d, "labels").select((F.col("doc_id") % 3).alias("grp"), F.col("quality").alias("a"), F.col("toxic").alias("b"), F.lit(True).alias("in_a"), F.lit(True).alias("in_b"))
    return op.comparison(t, ["grp"], exact=False).select("grp", "method", r6("statistic").alias("statistic"))


@query("holm_bonferroni", f"""WITH {C}, p AS (SELECT model, config, item, exp(-abs(k - n / 2.0)) AS p FROM c WHERE seed = 0),
q AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY model, config) - row_number() OVER (PARTITION BY model, config ORDER BY p, item) + 1) * p) AS raw FROM p),
z AS (SELECT *, max(raw) OVER (PARTITION BY model, config ORDER BY p, item ROWS UNBOUNDED PRECEDING) AS h FROM q)
SELECT model, config, item, round(p, 6) AS p, round(h, 6) AS p_holm, h <= 0.05 AS reject FROM z""")
def holm_bonferroni(spark, d):
    from tallyframe.operators import cells as cl

    p = cl.cells(ad.samples(spark, d)).where("seed = 0").select("model", "config", "item", F.exp(-F.abs(F.col("k") - F.col("n") / F.lit(2.0))).alias("p"))
    return op.holm(p, ["model", "config"], "p", "item").select("model", "config", "item", r6("p").alias("p"), r6("p_holm").alias("p_holm"), "reject")


@query("cumulative_budget", f"""WITH {L} SELECT user_id, line_no, round(sum(value / 3600) OVER (PARTITION BY user_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 6) AS hours FROM l""")
def cumulative_budget(spark, d):
    log = ad.log(spark, d).withColumn("h", F.col("value") / 3600)
    return log.select("user_id", "line_no", r6(op.running_total(log, ["user_id"], "line_no", "h")).alias("hours"))


@query("recent_window_mean", f"""WITH {L} SELECT user_id, line_no, round(avg(value) OVER (PARTITION BY user_id ORDER BY line_no ROWS 19 PRECEDING), 6) AS recent FROM l""")
def recent_window_mean(spark, d):
    return ad.log(spark, d).select("user_id", "line_no", r6(op.recent_mean(["user_id"], "line_no", "value")).alias("recent"))


@query("config_drift", """WITH a AS (SELECT p_brand || '.' || p_type AS path, CAST(max(p_size) AS VARCHAR) AS value FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
b AS (SELECT p_brand || '.' || p_type AS path, CAST(max(p_size) AS VARCHAR) AS value FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL)
SELECT path, a.value AS stored, b.value AS current FROM a FULL JOIN b USING (path) WHERE a.value IS DISTINCT FROM b.value""")
def config_drift(spark, d):
    flat = ad.table(spark, d, "part").select(F.concat_ws(".", "p_brand", "p_type").alias("path"), F.col("p_size").cast("int").alias("v"), (F.col("p_partkey") % 2).alias("side"))
    two = flat.groupBy("path").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).cast("string").alias("stored"), F.max(F.when(F.col("side") == 1, F.col("v"))).cast("string").alias("current"))
    return two.where(~F.col("stored").eqNullSafe(F.col("current")))
