"""Queries on variance, transfer of difficulty and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import stats as st
from tallyframe.operators import cells as cl
from tallyframe.operators import resampling as rs
from tallyframe.operators import transfer as tr
from tallyframe.operators import variance as va
from tallyframe.plans.base_sql import C
from tallyframe.plans.registry import query
from tallyframe.sources import adapters as ad

r6 = st.r6


def _stats(spark, d):
    return cl.cell_stats(cl.cells(ad.samples(spark, d)))


Z = f"{C}, z AS (SELECT item, model, config, seed, n, k, k / CAST(n AS DOUBLE) AS p_hat, ln((k + 0.5) / (n - k + 0.5)) AS z, 1 / (k + 0.5) + 1 / (n - k + 0.5) AS sv FROM c)"
_TERMS = list(va.TERMS)
MS = """g AS (SELECT {by} item, model, config, z, avg(z) OVER (PARTITION BY {b0}) AS g, avg(z) OVER (PARTITION BY {by} item) AS i, avg(z) OVER (PARTITION BY {by} model) AS m, avg(z) OVER (PARTITION BY {by} config) AS c,
  avg(z) OVER (PARTITION BY {by} item, model) AS im, avg(z) OVER (PARTITION BY {by} item, config) AS ic, avg(z) OVER (PARTITION BY {by} model, config) AS mc FROM {src}),
ms AS (SELECT {by} count(DISTINCT item) AS ni, count(DISTINCT model) AS nm, count(DISTINCT config) AS nc, sum((i - g) ** 2) AS item, sum((m - g) ** 2) AS model, sum((c - g) ** 2) AS config,
  sum((im - i - m + g) ** 2) AS item_model, sum((ic - i - c + g) ** 2) AS item_config, sum((mc - m - c + g) ** 2) AS model_config, sum((z - im - ic - mc + i + m + c - g) ** 2) AS residual FROM g {group})"""
DF = {"item": "(ni - 1)", "model": "(nm - 1)", "config": "(nc - 1)", "item_model": "(ni - 1) * (nm - 1)", "item_config": "(ni - 1) * (nc - 1)", "model_config": "(nm - 1) * (nc - 1)", "residual": "(ni - 1) * (nm - 1) * (nc - 1)"}
ONE = MS.format(by="", b0="1", src="z WHERE seed = 0", group="")


@query("anova_mean_squares", f"WITH {Z}, {ONE} SELECT ni AS n_items, nm AS n_models, nc AS n_configs, {', '.join(f'round({t}, 6) AS ss_{t}, CAST({DF[t]} AS BIGINT) AS df_{t}, round({t} / ({DF[t]}), 6) AS ms_{t}' for t in _TERMS)} FROM ms")
def anova_mean_squares(spark, d):
    ms = va.mean_squares(_stats(spark, d).where("seed = 0"))
    return ms.select("n_items", "n_models", "n_configs", *[r6(f"{p}_{t}").alias(f"{p}_{t}") for t in _TERMS for p in ("ss", "ms")], *[F.col(f"df_{t}").cast("long").alias(f"df_{t}") for t in _TERMS])


@query("noise_floor", f"""WITH {Z}, v AS (SELECT item, model, var_samp(z) AS v FROM z WHERE config = 'c0' GROUP BY ALL HAVING count(*) >= 2)
SELECT round(avg(v), 6) AS replicate, count(*) AS n_pairs, round((SELECT avg(sv) FROM z), 6) AS analytic, round(avg(v) / (SELECT avg(sv) FROM z), 6) AS ratio,
  NOT (avg(v) / (SELECT avg(sv) FROM z) BETWEEN 0.4 AND 2.5) AS suspicious FROM v""")
def noise_floor(spark, d):
    return va.noise_floor(cl.cells(ad.samples(spark, d)), "c0").withColumns({x: r6(x) for x in ("replicate", "analytic", "ratio")})


def _components_sql(by: str = "") -> str:
    ms = ", ".join(f"{t} / ({DF[t]}) - f AS {t}" for t in _TERMS)
    return f"""cm AS (SELECT {by} ni, nm, nc, {ms} FROM ms, fl),
co AS (SELECT {by} unnest([{', '.join(f"'{t}'" for t in _TERMS)}]) AS component, unnest([(item - item_model - item_config + residual) / (nm * nc), (model - item_model - model_config + residual) / (ni * nc),
  (config - item_config - model_config + residual) / (ni * nm), (item_model - residual) / nc, (item_config - residual) / nm, (model_config - residual) / ni, residual]) AS v FROM cm)"""


FLOOR = "fl AS (SELECT avg(v) AS f FROM (SELECT var_samp(z) AS v FROM z WHERE config = 'c0' GROUP BY item, model HAVING count(*) >= 2))"


@query("variance_components", f"WITH {Z}, {ONE}, {FLOOR}, {_components_sql()} SELECT component, round(v, 6) AS variance, v < 0 AS negative, round(greatest(v, 0) / (SELECT sum(greatest(v, 0)) FROM co), 6) AS share FROM co")
def variance_components(spark, d):
    c = cl.cells(ad.samples(spark, d))
    floor = va.noise_floor(c, "c0").select(F.col("replicate").alias("_floor"), F.lit(1).alias("_one"))
    ms = va.mean_squares(cl.cell_stats(c).where("seed = 0")).withColumn("_one", F.lit(1)).join(F.broadcast(floor), "_one")
    return va.components(ms, F.col("_floor")).withColumns({"variance": r6("variance"), "share": r6("share")})


#: Replicates of the registered queries.
REPLICATES, REFITS = 10_000, 2_000


def _weights_sql(values: str, unit: str, replicates: int) -> str:
    """wx: the draw of every unit of ``values`` in every replicate; wt: its Poisson weight."""
    number = lambda at: f"CAST(CAST('0x' || substr(md5({unit}), {at}, 8) AS UBIGINT) % {st.MODULUS} AS BIGINT)"
    x = f"(a + rep * {st.STRIDE}) % {st.MODULUS}"
    steps = f"w0 AS (SELECT {unit}, rep, b, {x} AS x FROM (SELECT DISTINCT {unit}, {number(1)} AS a, {number(9)} AS b FROM {values}), (SELECT unnest(range(0, {replicates})) AS rep))"
    for i in range(st.SQUARINGS):
        steps += f",\nw{i + 1} AS (SELECT {unit}, rep, b, (x * x + b) % {st.MODULUS} AS x FROM w{i})"
    weight = " + ".join(f"(x >= {s})::INT" for s in st.poisson_steps())
    return f"{steps}, wx AS (SELECT {unit}, rep, x FROM w{st.SQUARINGS}), wt AS (SELECT {unit}, rep, {weight} AS w FROM wx)"


VB = MS.format(by="rep, ", b0="rep", src="zz", group="GROUP BY rep")


@query("variance_bootstrap", f"""WITH {Z}, one AS (SELECT * FROM z WHERE seed = 0), {_weights_sql('one', 'item', REFITS)}, cp AS (SELECT item, rep, unnest(range(0, w)) AS nth FROM wt),
zz AS (SELECT rep, item || '#' || nth AS item, model, config, z FROM one JOIN cp USING (item)), {VB},
fv AS (SELECT item, model, var_samp(z) AS v FROM z WHERE config = 'c0' GROUP BY item, model HAVING count(*) >= 2), fl AS (SELECT rep, avg(v) AS f FROM fv JOIN cp USING (item) GROUP BY rep),
{_components_sql('rep,').replace('FROM ms, fl', 'FROM ms JOIN fl USING (rep)')}
SELECT component, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high FROM (SELECT component, greatest(v, 0) / sum(greatest(v, 0)) OVER (PARTITION BY rep) AS s FROM co) GROUP BY component""")
def variance_bootstrap(spark, d, replicates: int = REFITS):
    c = cl.cells(ad.samples(spark, d))
    z = cl.cell_stats(c).where("seed = 0").select("item", "model", "config", "z")
    got = va.resampled_components(z, va.seed_floors(c, "c0"), replicates)
    got = got.groupBy("component").agg(F.percentile("share", F.array(F.lit(0.025), F.lit(0.975))).alias("e"))
    return got.select("component", r6(F.col("e")[0]).alias("ci_low"), r6(F.col("e")[1]).alias("ci_high"))


RANK = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0"


@query("average_ranks", f"WITH {Z} SELECT item, model, config, round({RANK.format('model, config', 'p_hat')}, 6) AS r FROM z WHERE seed = 0")
def average_ranks(spark, d):
    c = _stats(spark, d).where("seed = 0")
    return c.select("item", "model", "config", r6(st.average_rank(F.col("p_hat"), [F.col("model"), F.col("config")])).alias("r"))


def _rho(keys: str, src: str) -> str:
    return f"SELECT {keys}, count(*) AS n_items, corr(rx, ry) AS rho FROM (SELECT {keys}, {RANK.format(keys, 'x')} AS rx, {RANK.format(keys, 'y')} AS ry FROM {src}) GROUP BY ALL HAVING count(*) >= 3"


PC = "pc AS (SELECT a.model, a.item, a.config AS a, b.config AS b, a.p_hat AS x, b.p_hat AS y FROM z a JOIN z b ON a.model = b.model AND a.item = b.item AND a.seed = 0 AND b.seed = 0 AND a.config < b.config)"
PS = "ps AS (SELECT a.model, a.config, a.item, a.p_hat AS x, b.p_hat AS y FROM z a JOIN z b ON a.model = b.model AND a.config = b.config AND a.item = b.item AND a.seed = 0 AND b.seed = 1)"


@query("spearman_transfer", f"WITH {Z}, {PC}, q AS ({_rho('model, a, b', 'pc')}) SELECT model, a AS config_a, b AS config_b, n_items, round(rho, 6) AS rho FROM q")
def spearman_transfer(spark, d):
    got = tr.spearman(tr.pairs_of(_stats(spark, d).where("seed = 0"), ["model"], "config", "p_hat"), ["model", "a", "b"])
    return got.select("model", F.col("a").alias("config_a"), F.col("b").alias("config_b"), "n_items", r6("rho").alias("rho"))


@query("reliability", f"WITH {Z}, {PS}, q AS ({_rho('model, config', 'ps')}) SELECT model, config, n_items, round(rho, 6) AS r_mm, 1 AS n_pairs FROM q")
def reliability(spark, d):
    return tr.reliability(_stats(spark, d), ["model", "config"]).select("model", "config", "n_items", r6("r_mm").alias("r_mm"), F.col("n_pairs").cast("int").alias("n_pairs"))


@query("disattenuated_transfer", f"""WITH {Z}, {PC}, {PS}, q AS ({_rho('model, a, b', 'pc')}), e AS ({_rho('model, config', 'ps')})
SELECT q.model, a AS config_a, b AS config_b, round(q.rho, 6) AS rho_raw, round(CASE WHEN e.rho > 0 THEN q.rho / e.rho END, 6) AS rho_disatt FROM q JOIN e ON q.model = e.model AND e.config = 'c0'""")
def disattenuated_transfer(spark, d):
    c = _stats(spark, d)
    raw = tr.spearman(tr.pairs_of(c.where("seed = 0"), ["model"], "config", "p_hat"), ["model", "a", "b"])
    r = tr.reliability(c.where("config = 'c0'"), ["model"]).select("model", "r_mm")
    got = raw.join(r, "model")
    return got.select("model", F.col("a").alias("config_a"), F.col("b").alias("config_b"), r6("rho").alias("rho_raw"), r6(tr.disattenuated(F.col("rho"), F.col("r_mm"))).alias("rho_disatt"))


@query("model_transfer", f"""WITH {Z}, pm AS (SELECT a.item, a.model AS a, b.model AS b, a.p_hat AS x, b.p_hat AS y FROM z a JOIN z b ON a.item = b.item AND a.config = 'c0' AND b.config = 'c0' AND a.seed = 0 AND b.seed = 0 AND a.model < b.model),
{PS}, q AS ({_rho('a, b', 'pm')}), e AS ({_rho('model, config', 'ps')})
SELECT q.a AS model_a, q.b AS model_b, q.n_items, round(q.rho, 6) AS rho_raw, round(CASE WHEN x.rho > 0 AND y.rho > 0 THEN q.rho / sqrt(x.rho * y.rho) END, 6) AS rho_disatt
FROM q JOIN e x ON x.model = q.a AND x.config = 'c0' JOIN e y ON y.model = q.b AND y.config = 'c0'""")
def model_transfer(spark, d):
    c = _stats(spark, d).where("config = 'c0'")
    raw = tr.spearman(tr.pairs_of(c.where("seed = 0"), [], "model", "p_hat"), ["a", "b"])
    r = tr.reliability(c, ["model"])
    got = raw.join(r.select(F.col("model").alias("a"), F.col("r_mm").alias("ra")), "a").join(r.select(F.col("model").alias("b"), F.col("r_mm").alias("rb")), "b")
    both = F.when((F.col("ra") > 0) & (F.col("rb") > 0), F.sqrt(F.col("ra") * F.col("rb")))
    return got.select(F.col("a").alias("model_a"), F.col("b").alias("model_b"), "n_items", r6("rho").alias("rho_raw"), r6(tr.disattenuated(F.col("rho"), both)).alias("rho_disatt"))


HARD = """h AS (SELECT item, model, config, p_hat FROM (SELECT *, row_number() OVER (PARTITION BY model, config ORDER BY p_hat, substr(sha256('"' || item || '"'), 1, 8), item) AS rn,
  greatest(1, CAST(round_even(0.25 * count(*) OVER (PARTITION BY model, config), 0) AS INT)) AS sz FROM z WHERE seed = 0) WHERE rn <= sz)"""


@query("hard_subset", f"WITH {Z}, {HARD} SELECT item, model, config, round(p_hat, 6) AS p_hat FROM h")
def hard_subset(spark, d):
    return tr.hard_subset(_stats(spark, d).where("seed = 0"), ["model", "config"], "p_hat").select("item", "model", "config", r6("p_hat").alias("p_hat"))


@query("boundary_tie_fraction", f"""WITH {Z}, q AS (SELECT model, config, p_hat, row_number() OVER (PARTITION BY model, config ORDER BY p_hat) AS rn, greatest(1, CAST(round_even(0.25 * count(*) OVER (PARTITION BY model, config), 0) AS INT)) AS sz FROM z WHERE seed = 0),
x AS (SELECT model, config, p_hat AS v FROM q WHERE rn = sz) SELECT model, config, round(avg(CASE WHEN p_hat = v THEN 1.0 ELSE 0.0 END), 6) AS tie_fraction FROM q JOIN x USING (model, config) GROUP BY ALL""")
def boundary_tie_fraction(spark, d):
    return tr.boundary_ties(_stats(spark, d).where("seed = 0"), ["model", "config"], "p_hat").withColumn("tie_fraction", r6("tie_fraction"))


@query("hard_subset_jaccard", f"""WITH {Z}, {HARD} SELECT a.model, a.config AS config_a, b.config AS config_b,
  round((SELECT count(*) FROM h x JOIN h y ON x.item = y.item AND x.model = a.model AND y.model = a.model AND x.config = a.config AND y.config = b.config)
   / CAST(a.n + b.n - (SELECT count(*) FROM h x JOIN h y ON x.item = y.item AND x.model = a.model AND y.model = a.model AND x.config = a.config AND y.config = b.config) AS DOUBLE), 6) AS jaccard
FROM (SELECT model, config, count(*) AS n FROM h GROUP BY ALL) a JOIN (SELECT model, config, count(*) AS n FROM h GROUP BY ALL) b ON a.model = b.model AND a.config < b.config""")
def hard_subset_jaccard(spark, d):
    h = tr.hard_subset(_stats(spark, d).where("seed = 0"), ["model", "config"], "p_hat").select("item", "model", "config")
    got = tr.jaccard(h, ["model"], "config")
    return got.select("model", F.col("a").alias("config_a"), F.col("b").alias("config_b"), r6("jaccard").alias("jaccard"))


@query("difficulty_quintiles", f"""WITH {Z}, i AS (SELECT model, item, avg(p_hat) AS p FROM z GROUP BY ALL), e AS (SELECT model, quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM i GROUP BY model)
SELECT model, CAST(len(list_filter(q, lambda v: v <= p)) AS INT) AS bucket, count(*) AS n_items, round(avg(p), 6) AS mean_p FROM i JOIN e USING (model) GROUP BY ALL""")
def difficulty_quintiles(spark, d):
    i = _stats(spark, d).groupBy("model", "item").agg(F.avg("p_hat").alias("p"))
    return tr.quantile_bucket(i, ["model"], "p", 5).groupBy("model", "bucket").agg(F.count(F.lit(1)).alias("n_items"), r6(F.avg("p")).alias("mean_p"))


def _column(spark, d):
    return _stats(spark, d).where("seed = 0").select("model", "config", "item", "p_hat")


def _diffs(spark, d):
    side = lambda c: F.max(F.when(F.col("config") == c, F.col("p_hat")))
    return _column(spark, d).groupBy("model", "item").agg((side("c1") - side("c0")).alias("v")).where("v is not null")


V = "v AS (SELECT model, config, item, p_hat FROM z WHERE seed = 0)"
DV = "dv AS (SELECT a.model, a.item, b.p_hat - a.p_hat AS v FROM z a JOIN z b ON a.model = b.model AND a.item = b.item AND a.seed = 0 AND b.seed = 0 AND a.config = 'c0' AND b.config = 'c1')"


MEANS = "mn AS (SELECT {0}, rep, sum(w * {1}) / nullif(sum(w), 0) AS m FROM {2} JOIN wt USING (item) GROUP BY ALL)"


@query("bootstrap_ci", f"""WITH {Z}, {V}, {_weights_sql('v', 'item', REPLICATES)}, {MEANS.format('model, config', 'p_hat', 'v')},
e AS (SELECT model, config, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM mn GROUP BY ALL)
SELECT model, config, count(*) AS n, round(avg(p_hat), 6) AS point, round(min(lo), 6) AS ci_low, round(min(hi), 6) AS ci_high FROM v JOIN e USING (model, config) GROUP BY ALL""")
def bootstrap_ci(spark, d):
    got = rs.bootstrap_ci(_column(spark, d), ["model", "config"], "item", "p_hat", REPLICATES)
    return got.withColumns({x: r6(x) for x in ("point", "ci_low", "ci_high")})


@query("paired_bootstrap", f"""WITH {Z}, {DV}, {_weights_sql('dv', 'item', REPLICATES)}, {MEANS.format('model', 'v', 'dv')},
e AS (SELECT model, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, least(1.0, greatest(1.0 / {REPLICATES}, 2 * least(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN m >= 0 THEN 1.0 ELSE 0.0 END)))) AS p FROM mn WHERE m IS NOT NULL GROUP BY ALL)
SELECT model, round(avg(v), 6) AS point, round(min(lo), 6) AS ci_low, round(min(hi), 6) AS ci_high, round(min(p), 6) AS p_value FROM dv JOIN e USING (model) GROUP BY ALL""")
def paired_bootstrap(spark, d):
    return rs.paired_bootstrap(_diffs(spark, d), ["model"], "item", "v", REPLICATES).select("model", *[r6(x).alias(x) for x in ("point", "ci_low", "ci_high", "p_value")])


@query("permutation_test", f"""WITH {Z}, {DV}, {_weights_sql('dv', 'item', REPLICATES)}, f AS (SELECT model, rep, avg(CASE WHEN x >= {st.MODULUS // 2} THEN v ELSE -v END) AS m FROM dv JOIN wx USING (item) GROUP BY ALL),
pt AS (SELECT model, avg(v) AS point FROM dv GROUP BY model)
SELECT model, round(min(point), 6) AS point, round((1 + count(*) FILTER (round(abs(m), 12) >= round(abs(point), 12))) / {REPLICATES + 1.0}, 6) AS p_value FROM f JOIN pt USING (model) GROUP BY model""")
def permutation_test(spark, d):
    return rs.sign_permutation(_diffs(spark, d), ["model"], "item", "v", REPLICATES).select("model", r6("point").alias("point"), r6("p_value").alias("p_value"))


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]:.17e}"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c:.17e})"
    return out


def _quantile_sql(p: str) -> str:
    """Inverse of the normal distribution function of a column or number strictly between 0 and 1."""
    tail = lambda q: f"{_horner(st._QC, q)} / ({_horner(st._QD, q)} * {q} + 1)"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > 0.97575 THEN -({tail(f'sqrt(-2 * ln(1 - {p}))')}) ELSE {_horner(st._QA, r)} * ({p} - 0.5) / ({_horner(st._QB, r)} * {r} + 1) END"


def _cdf_sql(z: str) -> str:
    """Normal distribution function of a column."""
    t = f"(1 / (1 + {st._ERF_P:.17e} * abs({z}) / sqrt(2.0)))"
    poly = f"({_horner((*reversed(st._ERF), 0.0), t)})"
    return f"0.5 * (1 + sign({z}) * (1 - {poly} * exp(-{z} * {z} / 2)))"


_END = "s[CAST(floor({0}) AS BIGINT) + 1] + ({0} - floor({0})) * (s[least(CAST(floor({0}) AS BIGINT) + 2, len(s))] - s[CAST(floor({0}) AS BIGINT) + 1])"


@query("bca_ci_mean", f"""WITH {Z}, {V}, {_weights_sql('v', 'item', REFITS)}, {MEANS.format('model, config', 'p_hat', 'v')},
ce AS (SELECT model, config, p_hat, p_hat - avg(p_hat) OVER (PARTITION BY model, config) AS c FROM v),
pt AS (SELECT model, config, avg(p_hat) AS point, count(*) AS n, coalesce(sum(c ** 3) / nullif(6 * sum(c ** 2) ** 1.5, 0), 0) AS acc FROM ce GROUP BY ALL),
bl AS (SELECT model, config, n, point, acc, greatest({0.5 / REFITS}, least({1 - 0.5 / REFITS}, avg(CASE WHEN round(m, 12) < round(point, 12) THEN 1.0 ELSE 0.0 END))) AS b, list(m ORDER BY m) AS s FROM mn JOIN pt USING (model, config) WHERE m IS NOT NULL GROUP BY model, config, n, point, acc),
zs AS (SELECT *, {_quantile_sql('b')} AS z0, {_quantile_sql('2.5e-2')} AS za, {_quantile_sql('9.75e-1')} AS zb FROM bl),
ad AS (SELECT *, z0 + (z0 + za) / (1 - acc * (z0 + za)) AS ya, z0 + (z0 + zb) / (1 - acc * (z0 + zb)) AS yb FROM zs),
sp AS (SELECT *, ({_cdf_sql('ya')}) * (len(s) - 1) AS pa, ({_cdf_sql('yb')}) * (len(s) - 1) AS pb FROM ad)
SELECT model, config, n, round(point, 6) AS point, round({_END.format('pa')}, 6) AS ci_low, round({_END.format('pb')}, 6) AS ci_high FROM sp""")
def bca_ci_mean(spark, d):
    return rs.bca_ci(_column(spark, d), ["model", "config"], "item", "p_hat", REFITS).withColumns({x: r6(x) for x in ("point", "ci_low", "ci_high")})


@query("glmm_shares")
def glmm_shares(spark, d):
    from tallyframe.operators import glmm

    return glmm.decompose(cl.cells(ad.samples(spark, d)), ["seed"])
