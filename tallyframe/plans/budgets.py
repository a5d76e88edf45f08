"""Queries on voting at token budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import stats as st
from tallyframe.operators import budgets as op
from tallyframe.operators import cells as cl
from tallyframe.plans.base_sql import M, S
from tallyframe.plans.records import TAIL
from tallyframe.plans.registry import query
from tallyframe.sources import adapters as ad

r6 = st.r6
BY = ["model", "config", "item", "seed"]
REPS = 3


@query("token_budgets", f"""WITH {S}, p AS (SELECT model, seed, item, config, avg(tok) AS mean, sum(tok) AS total FROM s GROUP BY ALL),
u AS (SELECT model, seed, avg(mean) AS unit FROM p WHERE config = 'c0' GROUP BY ALL), m AS (SELECT model, seed, min(room) AS room FROM (SELECT model, seed, config, avg(total) AS room FROM p GROUP BY ALL) GROUP BY ALL)
SELECT model, seed, mult AS multiple, round(unit * mult, 6) AS budget, round(room, 6) AS room, unit * mult <= room * 1.05 AS kept FROM u JOIN m USING (model, seed), (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS mult)""")
def token_budgets(spark, d):
    return op.token_budgets(ad.samples(spark, d), ["model", "seed"], "c0", (1, 2, 4, 8, 16, 32, 64)).withColumns({"budget": r6("budget"), "room": r6("room")})


K = "model, config, item, seed"


def _ordered_sql(source: str = "s", budget: str = "0") -> str:
    """Every replicate's chains of a pool in hash order."""
    return f"""o AS (SELECT rep AS replicate, {K}, cls, greatest(tok, 1) AS tok, {budget} AS budget, row_number() OVER (PARTITION BY rep, {K} ORDER BY md5(concat_ws('-', rep, {K}, idx)), idx) AS pos
  FROM {source}, (SELECT unnest(range(0, {REPS})) AS rep))"""


def _draw_sql(budget: str, source: str = "s", stop: int = 0) -> str:
    """Chains in hash order, taken while they fit: a recursion over positions. With ``stop``, until that many taken are of
    one class: ``run`` counts the last ones that are."""
    fits = f"f.spent + o.tok <= o.budget{f' AND f.run < {stop}' if stop else ''}"
    return f"""{_ordered_sql(source, budget)},
f AS (SELECT replicate, {K}, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS spent, false AS took, CAST(NULL AS VARCHAR) AS cls, CAST(NULL AS VARCHAR) AS last, 0 AS run FROM o WHERE pos = 1
  UNION ALL SELECT o.replicate, o.model, o.config, o.item, o.seed, o.pos, CASE WHEN {fits} THEN f.spent + o.tok ELSE f.spent END, {fits}, o.cls,
    CASE WHEN {fits} THEN o.cls ELSE f.last END, CASE WHEN NOT ({fits}) THEN f.run WHEN o.cls = f.last THEN f.run + 1 ELSE 1 END
  FROM f JOIN o ON o.replicate = f.replicate AND o.model = f.model AND o.config = f.config AND o.item = f.item AND o.seed = f.seed AND o.pos = f.pos + 1),
vc AS (SELECT replicate, {K}, cls, count(*) AS w, min(pos) AS first FROM f WHERE took GROUP BY ALL),
vw AS (SELECT * FROM vc QUALIFY row_number() OVER (PARTITION BY replicate, {K} ORDER BY w DESC, first) = 1),
dr AS (SELECT replicate, {K}, max(f.spent) AS spent, count(*) FILTER (took) AS n_chains, coalesce(bool_or(vw.cls = 'gold'), false) AS correct FROM f LEFT JOIN vw USING (replicate, {K}) GROUP BY ALL)"""


def _draws(pool, budget, *keep):
    """(by, replicate, keep, spent, n_chains, correct) of drawing each pool at its budget."""
    return _voted(pool.withColumn("d", op.take_within(F.col("chains"), budget)), *keep)


def _voted(drawn, *keep):
    """(by, replicate, keep, spent, n_chains, correct) of the draws ``d``."""
    got = drawn.select(*BY, "replicate", *keep, "d.spent", F.size("d.taken").cast("long").alias("n_chains"), op.vote_of(F.col("d.taken")).alias("v"))
    return got.select(*BY, "replicate", *keep, "spent", "n_chains", "v.correct")


@query("sc_budget_draw", f"WITH RECURSIVE {S}, {_draw_sql('200')} SELECT replicate, model, config, item, seed, spent, n_chains, correct FROM dr")
def sc_budget_draw(spark, d):
    return _draws(op.pools(ad.samples(spark, d), BY, REPS), F.lit(200))


@query("budget_curves", " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {S}, {_draw_sql(str(b))} SELECT {b} AS budget, model, config, seed, count(*) AS n_draws, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(spent), 6) AS spent FROM dr GROUP BY ALL)" for b in (100, 300)))
def budget_curves(spark, d):
    pool = op.pools(ad.samples(spark, d), BY, REPS).withColumn("budget", F.explode(F.array(F.lit(100), F.lit(300))))
    both = _draws(pool, F.col("budget"), "budget")
    return both.groupBy("budget", "model", "config", "seed").agg(F.count(F.lit(1)).alias("n_draws"), r6(F.avg(F.col("correct").cast("int"))).alias("accuracy"), r6(F.avg("spent")).alias("spent"))


@query("compare_to_reference", f"""WITH RECURSIVE {S}, {_draw_sql('200')}, sc AS (SELECT model, config, item, seed, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS score FROM dr GROUP BY ALL),
x AS (SELECT a.model, a.config, a.seed, count(*) AS n_items, avg(a.score - b.score) AS mean_diff, count(*) FILTER (a.score > 0.5 AND b.score <= 0.5) AS b01, count(*) FILTER (a.score <= 0.5 AND b.score > 0.5) AS b10
  FROM sc a JOIN sc b ON a.model = b.model AND a.item = b.item AND a.seed = b.seed AND b.config = 'c0' AND a.config <> 'c0' GROUP BY ALL),
y AS (SELECT *, {TAIL} AS p FROM x),
q AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY model, seed) - row_number() OVER (PARTITION BY model, seed ORDER BY p, config) + 1) * p) AS raw FROM y),
h AS (SELECT *, max(raw) OVER (PARTITION BY model, seed ORDER BY p, config ROWS UNBOUNDED PRECEDING) AS ph FROM q)
SELECT model, config, seed, n_items, round(mean_diff, 6) AS mean_diff, b01, b10, round(p, 6) AS p_value, round(ph, 6) AS p_holm, ph <= 0.05 AS reject FROM h""")
def compare_to_reference(spark, d):
    draws = _draws(op.pools(ad.samples(spark, d), BY, REPS), F.lit(200))
    scores = draws.groupBy(*BY).agg(F.avg(F.col("correct").cast("int")).alias("score"))
    got = op.compare_scores(scores, ["model", "seed"], "config", "c0")
    return got.withColumns({x: r6(x) for x in ("mean_diff", "p_value", "p_holm")})


@query("early_stop_vote", f"WITH RECURSIVE {S}, {_draw_sql('200', stop=4)} SELECT replicate, model, config, item, seed, spent, n_chains, correct FROM dr")
def early_stop_vote(spark, d):
    pool = op.pools(ad.samples(spark, d), BY, REPS)
    return _voted(pool.withColumn("d", op.early_stop(F.col("chains"), F.lit(200))))


def _turns_sql(budget: int, probe: int) -> str:
    """The allocators over configurations, position by position. A state is the cursors ``cur`` of the configurations, whose
    turn it is, what is spent and the taken classes ``got``. Probing takes the first ``probe`` positions of each in
    order; if all modes of the probes agree, cursors go to the end; else only configurations with a mode go on."""
    pools = f"""{_ordered_sql()},
pl AS (SELECT replicate, model, item, seed, config, list(cls ORDER BY pos) AS cs, list(tok ORDER BY pos) AS ts FROM o GROUP BY ALL),
pp AS (SELECT replicate, model, item, seed, list(cs ORDER BY config) AS cs, list(ts ORDER BY config) AS ts, list(len(cs) ORDER BY config) AS n FROM pl GROUP BY ALL)"""
    here, tok = "cur[turn]", "ts[turn][cur[turn] + 1]"
    bump = "list_transform(cur, lambda v, i: v + CASE WHEN i = turn THEN 1 ELSE 0 END)"
    fits = f"{here} < n[turn] AND spent + {tok} <= {budget}"
    walk = f"""SELECT replicate, model, item, seed, cs, ts, n, CASE WHEN {here} < n[turn] THEN {bump} ELSE cur END, CASE WHEN {here} >= n[turn] OR {fits} THEN turn % len(n) + 1 ELSE turn END,
    CASE WHEN {fits} THEN spent + {tok} ELSE spent END, CASE WHEN {fits} THEN list_append(got, cs[turn][{here} + 1]) ELSE got END FROM w WHERE list_sum(list_transform(n, lambda v, i: greatest(v - cur[i], 0))) > 0"""
    if not probe:
        first = "SELECT replicate, model, item, seed, cs, ts, n, list_transform(n, lambda v: 0) AS cur, 1 AS turn, CAST(0 AS BIGINT) AS spent, CAST([] AS VARCHAR[]) AS got FROM pp"
        before = ""
    else:
        mode = "list_transform(own, lambda l: CASE WHEN len(l) > 0 THEN list_extract(list_sort(list_transform(list_distinct(l), lambda c: {'w': -len(list_filter(l, lambda x: x = c)), 'f': list_position(l, c), 'c': c})), 1).c END)"
        tok = "ts[turn][k + 1]"
        fits = f"k < n[turn] AND spent + {tok} <= {budget}"
        before = f"""pb AS (SELECT replicate, model, item, seed, cs, ts, n, 1 AS turn, 0 AS k, CAST(0 AS BIGINT) AS spent, CAST([] AS VARCHAR[]) AS got, list_transform(n, lambda v: CAST([] AS VARCHAR[])) AS own FROM pp
  UNION ALL SELECT replicate, model, item, seed, cs, ts, n, CASE WHEN k + 1 >= {probe} THEN turn + 1 ELSE turn END, CASE WHEN k + 1 >= {probe} THEN 0 ELSE k + 1 END, CASE WHEN {fits} THEN spent + {tok} ELSE spent END,
    CASE WHEN {fits} THEN list_append(got, cs[turn][k + 1]) ELSE got END, list_transform(own, lambda l, i: CASE WHEN i = turn AND {fits} THEN list_append(l, cs[turn][k + 1]) ELSE l END) FROM pb WHERE turn <= len(n)),
md AS (SELECT *, {mode} AS modes FROM pb WHERE turn > len(n)),
"""
        on = "len(list_distinct(modes)) <> 1 AND (modes[i] IS NOT NULL OR len(list_distinct(modes)) = 0)"
        first = f"SELECT replicate, model, item, seed, cs, ts, n, list_transform(n, lambda v, i: CASE WHEN {on} THEN least({probe}, v) ELSE v END) AS cur, 1 AS turn, spent, got FROM md"
    return f"""{pools}, {before}w(replicate, model, item, seed, cs, ts, n, cur, turn, spent, got) AS ({first} UNION ALL {walk}),
e AS (SELECT * FROM w WHERE list_sum(list_transform(n, lambda v, i: greatest(v - cur[i], 0))) = 0),
ev AS (SELECT *, list_extract(list_sort(list_transform(list_distinct(got), lambda c: {{'w': -len(list_filter(got, lambda x: x = c)), 'f': list_position(got, c), 'c': c}})), 1).c AS top FROM e)
SELECT model, item, seed, replicate, spent, CAST(len(got) AS BIGINT) AS n_chains, coalesce(top = 'gold', false) AS correct FROM ev"""


@query("cdv_round_robin", f"WITH RECURSIVE {S}, {_turns_sql(300, 0)}")
def cdv_round_robin(spark, d):
    return _spread(spark, d, None)


@query("cdv_adaptive", f"WITH RECURSIVE {S}, {_turns_sql(300, 4)}")
def cdv_adaptive(spark, d):
    return _spread(spark, d, 4)


def _spread(spark, d, adaptive):
    key = ["model", "item", "seed"]
    # The configurations of an item meet before replicates multiply them.
    met = op.chains_of(ad.samples(spark, d), BY).groupBy(*key).agg(F.collect_list(F.struct("config", "chains")).alias("xs"))
    place = lambda x: [F.col("replicate"), F.col("model"), x["config"], F.col("item"), F.col("seed")]
    ordered = F.transform("xs", lambda x: F.struct(x["config"], op.shuffled(x["chains"], *place(x))))
    rows = op.each_replicate(met, REPS).select(*key, "replicate", F.map_from_entries(ordered).alias("chains"), F.lit(300).cast("bigint").alias("budget"))
    got = op.round_robin(rows, adaptive=adaptive).select(*key, "replicate", "spent", F.size("taken").cast("long").alias("n_chains"), op.vote_of(F.col("taken")).alias("v"))
    return got.select(*key, "replicate", "spent", "n_chains", "v.correct")


HARDER = "hd AS (SELECT model, seed, item, rn <= sz AS hard FROM (SELECT model, seed, item, row_number() OVER (PARTITION BY model, seed ORDER BY k / CAST(n AS DOUBLE), item) AS rn, CAST(round_even(0.5 * count(*) OVER (PARTITION BY model, seed), 0) AS INT) AS sz FROM m WHERE config = 'c0'))"


@query("transferred_allocation", f"""WITH RECURSIVE {M}, {HARDER}, s1 AS (SELECT s.*, hard FROM s JOIN hd USING (model, seed, item) WHERE config <> 'c0'),
{_draw_sql('CASE WHEN hard THEN 400 ELSE 200 END', 's1')}
SELECT model, seed, config, hard, count(*) AS n_draws, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(spent), 6) AS spent FROM dr JOIN hd USING (model, seed, item) GROUP BY ALL""")
def transferred_allocation(spark, d):
    from pyspark.sql import Window

    s = ad.samples(spark, d)
    source = cl.cells(s.where("config = 'c0'")).select("model", "seed", "item", st.ratio(F.col("k"), F.col("n")).alias("p"))
    whole = Window.partitionBy("model", "seed")
    size = F.bround(F.lit(0.5) * F.count(F.lit(1)).over(whole)).cast("int")
    hard = source.select("model", "seed", "item", (F.row_number().over(whole.orderBy("p", "item")) <= size).alias("hard"))
    pool = op.dealt(op.chains_of(s.where("config <> 'c0'"), BY).join(hard, ["model", "seed", "item"]), BY, REPS)
    both = _draws(pool, F.when(F.col("hard"), 400).otherwise(200), "hard")
    return both.groupBy("model", "seed", "config", "hard").agg(F.count(F.lit(1)).alias("n_draws"), r6(F.avg(F.col("correct").cast("int"))).alias("accuracy"), r6(F.avg("spent")).alias("spent"))


@query("gain_decomposition", f"""WITH {M}, i AS (SELECT model, seed, item, bool_or(mode_ok) FILTER (config = 'c0') AS ref_ok, bool_or(mode_ok) FILTER (config <> 'c0') AS other_ok FROM m GROUP BY ALL)
SELECT model, seed, count(*) AS n_items, count(*) FILTER (NOT ref_ok AND other_ok) AS selectable, count(*) FILTER (ref_ok AND NOT other_ok) AS at_risk, count(*) FILTER (NOT ref_ok AND NOT other_ok) AS out_of_reach FROM i GROUP BY ALL""")
def gain_decomposition(spark, d):
    m = cl.modes(ad.samples(spark, d))
    side = lambda c: F.coalesce(F.max(F.when(c, F.col("mode_ok"))), F.lit(False))
    i = m.groupBy("model", "seed", "item").agg(side(F.col("config") == "c0").alias("ref"), side(F.col("config") != "c0").alias("other"))
    return i.groupBy("model", "seed").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(~F.col("ref") & F.col("other")).alias("selectable"), F.count_if(F.col("ref") & ~F.col("other")).alias("at_risk"), F.count_if(~F.col("ref") & ~F.col("other")).alias("out_of_reach")
    )


@query("best_of_n_argmax", f"WITH {S} SELECT item, model, config, seed, cls AS answer, tok FROM s QUALIFY row_number() OVER (PARTITION BY item, model, config, seed ORDER BY tok, idx) = 1")
def best_of_n_argmax(spark, d):
    score = F.struct((-F.col("tok")).alias("score"), (-F.col("idx")).alias("first"))
    got = ad.samples(spark, d).groupBy(*ad.CELL).agg(F.max_by(F.struct("cls", "tok"), score).alias("b"))
    return got.select(*ad.CELL, F.col("b.cls").alias("answer"), F.col("b.tok").alias("tok"))


@query("audit_sample", f"""WITH {S}, r AS (SELECT *, cls = '<unparsed>' AS failed, row_number() OVER (PARTITION BY config, cls = '<unparsed>' ORDER BY md5(concat_ws('-', item, model, config, seed, idx))) AS rn FROM s)
SELECT config, failed, item, model, seed, idx FROM r WHERE rn <= CASE WHEN failed THEN 13 ELSE 12 END""")
def audit_sample(spark, d):
    return op.audit_sample(ad.samples(spark, d), ["config"], 25).select("config", "failed", "item", "model", "seed", "idx")


@query("greedy_accuracy", f"WITH {S} SELECT model, config, round(count(*) FILTER (cls = 'gold') / CAST(count(*) AS DOUBLE), 6) AS accuracy, round(avg(tok), 6) AS mean_tokens FROM s WHERE idx = 0 GROUP BY ALL")
def greedy_accuracy(spark, d):
    got = ad.samples(spark, d).where("idx = 0").groupBy("model", "config")
    return got.agg(r6(F.avg(F.col("ok").cast("int"))).alias("accuracy"), r6(F.avg("tok")).alias("mean_tokens"))
