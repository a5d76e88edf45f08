"""Queries on generation, report tables and prediction verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.functions import stats as st
from tallyframe.operators import budgets as bu
from tallyframe.operators import cells as cl
from tallyframe.operators import generation as ge
from tallyframe.operators import transfer as tr
from tallyframe.plans import inference as inf
from tallyframe.plans.base_sql import S
from tallyframe.plans.budgets import BY, K, _draw_sql
from tallyframe.plans.cells import CEIL, TR
from tallyframe.plans.records import TAIL
from tallyframe.plans.registry import query
from tallyframe.sources import adapters as ad

r6 = st.r6


def _hash(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8) AS UBIGINT)"


MOCK = f"""x AS (SELECT item_id AS id, CAST(item_id % 7 AS VARCHAR) AS gold FROM benchmark),
g AS (SELECT id, gold, idx, CASE WHEN {_hash('0', 'id', 'idx', "'hit'")} % 1000000 < 600000 THEN gold ELSE 'x' || ({_hash('0', 'id', 'idx', "'miss'")} % 3) END AS answer,
  CAST(20 + {_hash('0', 'id', 'idx', "'tok'")} % 100 AS BIGINT) AS tok, -CAST({_hash('0', 'id', 'idx', "'lp'")} % 1000 AS DOUBLE) / 1000.0 AS logprob FROM x, (SELECT unnest(range(0, 8)) AS idx))"""


def _mock(spark, d):
    examples = ad.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 7).cast("string").alias("gold"))
    return ge.mock_samples(examples, 8, 0.6)


@query("mock_generate", f"WITH {MOCK} SELECT id, idx, answer, tok, round(logprob, 6) AS logprob FROM g")
def mock_generate(spark, d):
    return _mock(spark, d).select("id", "idx", "answer", "tok", r6("logprob").alias("logprob"))


@query("self_consistency", f"""WITH {MOCK}, v AS (SELECT id, answer, count(*) AS n, min(idx) AS f FROM g GROUP BY ALL)
SELECT id, answer, (SELECT CAST(sum(tok) AS BIGINT) FROM g WHERE g.id = v.id) AS tok FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, f) = 1""")
def self_consistency(spark, d):
    return ge.resolve(ge.STRATEGIES, "self_consistency")(_mock(spark, d))


@query("best_of_n_logprob", f"WITH {MOCK} SELECT id, answer, (SELECT CAST(sum(tok) AS BIGINT) FROM g h WHERE h.id = g.id) AS tok FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY logprob DESC, idx) = 1")
def best_of_n_logprob(spark, d):
    return ge.resolve(ge.STRATEGIES, "best_of_n")(_mock(spark, d), "logprob")


@query("build_prompts", """SELECT item_id, md5('system: Be brief.' || chr(10) || 'user: 1+1?' || chr(10) || 'assistant: 2' || chr(10) || 'user: ' || text || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. yes' || chr(10) || 'B. no' || chr(10) || chr(10) || 'Answer with a letter.') AS digest FROM benchmark""")
def build_prompts(spark, d):
    chat = ge.build_prompt(F.col("text"), F.array(F.lit("yes"), F.lit("no")), "Be brief.", "Answer with a letter.", [("1+1?", "2")])
    return ad.table(spark, d, "benchmark").select("item_id", F.md5(ge.render(chat).cast("binary")).alias("digest"))


_SAYS = (
    ("VERDICT: INCORRECT ... Verdict: correct", True), ("verdict - incorrect", False), ("this looks incorrect to me", False), ("the sum is wrong, not correct", False),
    ("Verdict: **correct**", True), ("all correct here", True), ("cannot say", None), ("verdict correct, then VERDICT:incorrect", False),
)


@query("parse_verdict", "SELECT said, count(*) AS n, verdict FROM lineitem JOIN (VALUES " + ", ".join(f"({i}, {'NULL' if v is None else str(v).lower()})" for i, (_, v) in enumerate(_SAYS)) + f") t(said, verdict) ON said = l_orderkey % {len(_SAYS)} GROUP BY ALL")
def parse_verdict(spark, d):
    said = (F.col("l_orderkey") % len(_SAYS)).cast("int")
    t = ad.table(spark, d, "lineitem").select(said.alias("said"), ge.verdict(F.get(F.array(*[F.lit(x) for x, _ in _SAYS]), said)).alias("verdict"))
    return t.groupBy("said", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("token_tally", """WITH p AS (SELECT l_suppkey, l_orderkey, max(l_partkey % 100) AS p, sum(l_quantity) AS c FROM lineitem GROUP BY ALL)
SELECT l_suppkey AS example, CAST(sum(p) AS BIGINT) AS tokens_prompt, CAST(sum(c) AS BIGINT) AS tokens_completion, count(*) AS n_calls FROM p GROUP BY ALL""")
def token_tally(spark, d):
    calls = ad.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("example"), "l_orderkey", (F.col("l_partkey") % 100).alias("prompt"), F.col("l_quantity").cast("long").alias("completion"))
    return ge.tally(calls, ["example"], "l_orderkey")


@query("subsample_hash", "SELECT o_orderkey AS uid FROM orders ORDER BY md5(concat_ws('-', 11, o_orderkey)), o_orderkey LIMIT 100")
def subsample_hash(spark, d):
    return ge.subsample(ad.records(spark, d).select("uid"), 100, 11, "uid")


@query("item_ids_digest", f"WITH {S} SELECT model, config, count(DISTINCT item) AS n_items, sha256((SELECT string_agg(item, ',' ORDER BY item) FROM (SELECT DISTINCT item FROM s t WHERE t.model = s.model AND t.config = s.config))) AS digest FROM s GROUP BY model, config")
def item_ids_digest(spark, d):
    got = ad.samples(spark, d).groupBy("model", "config").agg(F.array_sort(F.collect_set("item")).alias("xs"))
    return got.select("model", "config", F.size("xs").cast("long").alias("n_items"), F.sha2(F.array_join("xs", ","), 256).alias("digest"))


@query("apply_paraphrases", "SELECT p_partkey AS id, s_name AS question, p_size FROM part JOIN supplier ON p_partkey = s_suppkey")
def apply_paraphrases(spark, d):
    examples = ad.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), "p_size")
    return ge.paraphrased(examples, ad.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("question")), "id", "question")


@query("load_corpus_cells", f"""WITH {S}, a AS (SELECT item, model, config, seed, 1 AS run, count(*) AS n FROM s GROUP BY ALL), b AS (SELECT item, model, config, seed, 2 AS run, count(*) AS n FROM s WHERE CAST(item AS INT) % 2 = 0 AND (idx % 2 = 0 OR CAST(item AS INT) % 4 = 0) GROUP BY ALL),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT item, model, config, seed, run, n FROM u QUALIFY row_number() OVER (PARTITION BY item, model, config, seed ORDER BY n DESC, run DESC) = 1""")
def load_corpus_cells(spark, d):
    s = ad.samples(spark, d)
    k = F.col("item").cast("int")
    later = s.where((k % 2 == 0) & ((F.col("idx") % 2 == 0) | (k % 4 == 0)))
    both = cl.cells(s).withColumn("run", F.lit(1)).unionByName(cl.cells(later).withColumn("run", F.lit(2)))
    got = both.groupBy(*ad.CELL).agg(F.max_by(F.struct("run", "n"), F.struct("n", "run")).alias("b"))
    return got.select(*ad.CELL, "b.run", "b.n")


@query("main_results_table", f"WITH {CEIL} SELECT model, config, seed, round(avg_at_1, 6) AS accuracy, round(avg_at_1, 9) = max(round(avg_at_1, 9)) OVER (PARTITION BY model) AS best, round(tokens_per_sample, 6) AS tokens FROM ceil")
def main_results_table(spark, d):
    rows = cl.ceilings(cl.with_modes(ad.samples(spark, d)), ["model", "config", "seed"])
    top = F.max(F.round("avg_at_1", 9)).over(Window.partitionBy("model"))
    return rows.select("model", "config", "seed", r6("avg_at_1").alias("accuracy"), (F.round("avg_at_1", 9) == top).alias("best"), r6("tokens_per_sample").alias("tokens"))


@query("significance_stars", f"""WITH {TR}, x AS (SELECT model, config_a, config_b, count(*) FILTER (NOT ok_a AND ok_b) AS b01, count(*) FILTER (ok_a AND NOT ok_b) AS b10 FROM tr GROUP BY ALL), y AS (SELECT *, {TAIL} AS p FROM x)
SELECT model, config_a, config_b, round(p, 6) AS p_value, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM y""")
def significance_stars(spark, d):
    t = cl.transitions(cl.modes(ad.samples(spark, d)), ["model", "seed"])
    got = t.groupBy("model", "config_a", "config_b").agg(F.count_if(~F.col("ok_a") & F.col("ok_b")).alias("b01"), F.count_if(F.col("ok_a") & ~F.col("ok_b")).alias("b10"))
    p = st.binomial_two_sided(F.least("b01", "b10"), F.col("b01") + F.col("b10"))
    stars = F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("")
    return got.withColumn("p", p).select("model", "config_a", "config_b", r6("p").alias("p_value"), stars.alias("stars"))


@query("margin_quartiles", f"""WITH {TR}, e AS (SELECT config_a, config_b, quantile_cont(margin_a, [0.25, 0.5, 0.75]) AS q FROM tr GROUP BY ALL)
SELECT config_a, config_b, CAST(len(list_filter(q, lambda v: v <= margin_a)) AS INT) AS bucket, count(*) AS n, round(avg(CASE WHEN reordered THEN 1.0 ELSE 0.0 END), 6) AS reorder_rate FROM tr JOIN e USING (config_a, config_b) GROUP BY ALL""")
def margin_quartiles(spark, d):
    t = cl.transitions(cl.modes(ad.samples(spark, d)), ["model", "seed"])
    got = tr.quantile_bucket(t, ["config_a", "config_b"], "margin_a", 4)
    return got.groupBy("config_a", "config_b", "bucket").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("reordered").cast("int"))).alias("reorder_rate"))


@query("transfer_summary", f"""WITH {inf.Z}, {inf.PC}, {inf.PS}, q AS ({inf._rho('model, a, b', 'pc')}), e AS ({inf._rho('model, config', 'ps')}),
t AS (SELECT q.rho AS raw, CASE WHEN e.rho > 0 THEN q.rho / e.rho END AS dis, e.rho AS r FROM q JOIN e ON q.model = e.model AND e.config = 'c0')
SELECT count(*) AS n_pairs, round(avg(dis), 6) AS mean_disatt, round(min(dis), 6) AS least, round(max(dis), 6) AS most, round(avg(r), 6) AS mean_r, avg(dis) < 0.85 AND avg(r) > 0.95 AS supported FROM t""")
def transfer_summary(spark, d):
    c = inf._stats(spark, d)
    raw = tr.spearman(tr.pairs_of(c.where("seed = 0"), ["model"], "config", "p_hat"), ["model", "a", "b"])
    t = raw.join(tr.reliability(c.where("config = 'c0'"), ["model"]).select("model", "r_mm"), "model").withColumn("dis", tr.disattenuated(F.col("rho"), F.col("r_mm")))
    got = t.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("dis").alias("m"), F.min("dis").alias("lo"), F.max("dis").alias("hi"), F.avg("r_mm").alias("r"))
    return got.select("n_pairs", r6("m").alias("mean_disatt"), r6("lo").alias("least"), r6("hi").alias("most"), r6("r").alias("mean_r"), ((F.col("m") < 0.85) & (F.col("r") > 0.95)).alias("supported"))


HS = """hs AS (SELECT item, model, config, seed FROM (SELECT *, row_number() OVER (PARTITION BY model, config, seed ORDER BY p_hat, substr(sha256('"' || item || '"'), 1, 8), item) AS rn,
  greatest(1, CAST(round_even(0.25 * count(*) OVER (PARTITION BY model, config, seed), 0) AS INT)) AS sz FROM z) WHERE rn <= sz)"""


@query("overlap_excess", f"""WITH {inf.Z}, {HS}, n AS (SELECT model, config, seed, count(*) AS n FROM hs GROUP BY ALL),
pr AS (SELECT x.model, x.n + y.n AS total, (SELECT count(*) FROM hs p JOIN hs q ON p.item = q.item AND p.model = x.model AND q.model = x.model AND p.config = x.config AND q.config = y.config AND p.seed = 0 AND q.seed = 0) AS shared
  FROM n x JOIN n y ON x.model = y.model AND x.config < y.config AND x.seed = 0 AND y.seed = 0),
ps2 AS (SELECT x.model, x.n + y.n AS total, (SELECT count(*) FROM hs p JOIN hs q ON p.item = q.item AND p.model = x.model AND q.model = x.model AND p.config = 'c0' AND q.config = 'c0' AND p.seed = 0 AND q.seed = 1) AS shared
  FROM n x JOIN n y ON x.model = y.model AND x.config = 'c0' AND y.config = 'c0' AND x.seed = 0 AND y.seed = 1)
SELECT c.model, round(c.j, 6) AS j_config, round(s2.j, 6) AS j_seed, round(s2.j - c.j, 6) AS excess FROM (SELECT model, avg(shared / CAST(total - shared AS DOUBLE)) AS j FROM pr GROUP BY model) c
JOIN (SELECT model, avg(shared / CAST(total - shared AS DOUBLE)) AS j FROM ps2 GROUP BY model) s2 USING (model)""")
def overlap_excess(spark, d):
    h = tr.hard_subset(inf._stats(spark, d), ["model", "config", "seed"], "p_hat").select("item", "model", "config", "seed")
    config = tr.jaccard(h.where("seed = 0").drop("seed"), ["model"], "config").groupBy("model").agg(F.avg("jaccard").alias("c"))
    seed = tr.jaccard(h.where("config = 'c0'").drop("config"), ["model"], "seed").groupBy("model").agg(F.avg("jaccard").alias("s"))
    return config.join(seed, "model").select("model", r6("c").alias("j_config"), r6("s").alias("j_seed"), r6(F.col("s") - F.col("c")).alias("excess"))


@query("oracle_coverage", f"WITH RECURSIVE {S}, {_draw_sql('200')} SELECT replicate, {K}, bool_or(took AND cls = 'gold') AS covered FROM f GROUP BY ALL")
def oracle_coverage(spark, d):
    pool = bu.pools(ad.samples(spark, d), BY, 3)
    got = pool.withColumn("d", bu.take_within(F.col("chains"), F.lit(200)))
    return got.select("replicate", *BY, F.exists("d.taken", lambda c: c["ok"]).alias("covered"))


@query("certainty_weighted_vote", f"""WITH {S}, w AS (SELECT *, exp(-tok / 50.0 - max(-tok / 50.0) OVER (PARTITION BY item, model, config, seed)) AS e FROM s),
v AS (SELECT item, model, config, seed, cls, round(sum(e), 9) AS w, min(idx) AS f FROM w GROUP BY ALL)
SELECT item, model, config, seed, cls AS winner FROM v QUALIFY row_number() OVER (PARTITION BY item, model, config, seed ORDER BY w DESC, f) = 1""")
def certainty_weighted_vote(spark, d):
    s = ad.samples(spark, d).withColumn("lp", -F.col("tok") / F.lit(50.0))
    e = s.withColumn("e", F.exp(F.col("lp") - F.max("lp").over(Window.partitionBy(*ad.CELL))))
    v = e.groupBy(*ad.CELL, "cls").agg(F.round(F.sum("e"), 9).alias("w"), F.min("idx").alias("first"))
    return v.groupBy(*ad.CELL).agg(F.max_by("cls", F.struct("w", (-F.col("first")).alias("f"))).alias("winner"))


@query("zero_token_warning", f"WITH {S} SELECT model, CAST(sum(tok) AS BIGINT) AS tokens, count(*) AS n_chains, sum(tok) <= count(*) AS invalid FROM s GROUP BY model")
def zero_token_warning(spark, d):
    return ad.samples(spark, d).groupBy("model").agg(F.sum("tok").alias("tokens"), F.count(F.lit(1)).alias("n_chains"), (F.sum("tok") <= F.count(F.lit(1))).alias("invalid"))


def _hard_sql(source: str, value: str, by: str) -> str:
    return f"""(SELECT {by}, config, item FROM (SELECT *, row_number() OVER (PARTITION BY {by}, config ORDER BY {value}, substr(sha256('"' || item || '"'), 1, 8), item) AS rn,
  greatest(1, CAST(round_even(0.25 * count(*) OVER (PARTITION BY {by}, config), 0) AS INT)) AS sz FROM {source}) WHERE rn <= sz)"""


def _overlap_sql(hard: str, by: str) -> str:
    """Mean overlap over pairs of configurations."""
    return f"""(SELECT {by}, avg(shared / CAST(na + nb - shared AS DOUBLE)) AS jaccard FROM (SELECT {by}, a, b, count(*) FILTER (ina AND inb) AS shared, count(*) FILTER (ina) AS na, count(*) FILTER (inb) AS nb
  FROM (SELECT {by}, a, b, item, bool_or(config = a) AS ina, bool_or(config = b) AS inb FROM {hard}, (VALUES ('c0', 'c1'), ('c0', 'c2'), ('c1', 'c2')) t(a, b) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)"""


NULL_DRAWS = 1_000


@query("reestimation_null", f"""WITH {inf.Z}, ob AS (SELECT * FROM z WHERE seed = 0), ce AS (SELECT model, config, item, n, avg(p_hat) OVER (PARTITION BY model, item) AS p, concat_ws('-', model, config, item) AS unit FROM ob),
st AS (SELECT unit, list(step ORDER BY k) AS steps FROM (SELECT unit, k, CAST(round(sum(pmf) OVER (PARTITION BY unit ORDER BY k) * {st.MODULUS}) AS BIGINT) AS step
  FROM (SELECT unit, k, CASE WHEN p <= 0 THEN CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END WHEN p >= 1 THEN 0.0 ELSE exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)) END AS pmf
    FROM (SELECT unit, n, p, unnest(range(0, n)) AS k FROM ce))) GROUP BY unit),
{inf._weights_sql('ce', 'unit', NULL_DRAWS)}, dn AS (SELECT model, config, item, rep, len(list_filter(steps, lambda s: s <= x)) / CAST(n AS DOUBLE) AS v FROM ce JOIN st USING (unit) JOIN wx USING (unit)),
nl AS {_overlap_sql(_hard_sql('dn', 'v', 'model, rep'), 'model, rep')}, oj AS {_overlap_sql(_hard_sql('ob', 'p_hat', 'model'), 'model')}
SELECT model, round(any_value(oj.jaccard), 6) AS observed, round(avg(nl.jaccard), 6) AS null_mean, round(stddev_samp(nl.jaccard), 6) AS null_std, round(quantile_cont(nl.jaccard, 0.05), 6) AS null_q05,
  round((1 + count(*) FILTER (round(nl.jaccard, 12) <= round(oj.jaccard, 12))) / (1.0 + count(*)), 6) AS p_value, count(*) AS n_draws FROM nl JOIN oj USING (model) GROUP BY model""")
def reestimation_null(spark, d):
    got = tr.reestimation_null(inf._stats(spark, d).where("seed = 0"), ["model"], "config", NULL_DRAWS)
    return got.withColumns({x: r6(x) for x in ("observed", "null_mean", "null_std", "null_q05", "p_value")})

