"""Crossed variance components of cell logits, their noise floor and their resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import stats as st
from tallyframe.operators.resampling import with_replicates

#: Components and the factors that vary in each.
TERMS = {
    "item": "i", "model": "m", "config": "c", "item_model": "im", "item_config": "ic", "model_config": "mc", "residual": "imc",
}


def mean_squares(z: DataFrame, by: list[str] | None = None, unit: str = "item") -> DataFrame:
    """Sums of squares, degrees of freedom and mean squares of a crossed design with one value ``z`` a cell; one row for
    each group. All marginal totals come from one grouping-sets aggregation, combined before its shuffle."""
    by = by or []
    factors = {"i": unit, "m": "model", "c": "config"}
    totals = z.withColumn("_all", F.lit(0)).cube(*factors.values(), *[]) if not by else None
    if by:
        # The group's columns take part in every set.
        sets = [[*by, *[factors[f] for f in s]] for s in ("", "i", "m", "c", "im", "ic", "mc", "imc")]
        names = [*by, *factors.values()]
        totals = z.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    summed = totals.agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_g{f}") for f, c in factors.items()])
    in_set = lambda s: sum(((F.col(f"_g{f}") == (0 if f in s else 1)).cast("int") for f in "imc"), F.lit(0)) == 3
    q = lambda s: F.sum(F.when(in_set(s), F.col("s") * F.col("s") / F.col("n")))
    size = lambda f: F.count_if(in_set(f)).alias(f"n_{f}")
    got = summed.groupBy(*by).agg(*[q(s).alias(f"q_{s or '0'}") for s in ("", "i", "m", "c", "im", "ic", "mc", "imc")], *[size(f) for f in "imc"])
    return _squares(got, by)


def _squares(got: DataFrame, by: list[str]) -> DataFrame:
    """Sums of squares, degrees of freedom and mean squares from the totals q_ of every margin and the sizes n_."""
    c = lambda s: F.col(f"q_{s}")
    ss = {
        "item": c("i") - c("0"), "model": c("m") - c("0"), "config": c("c") - c("0"), "item_model": c("im") - c("i") - c("m") + c("0"),
        "item_config": c("ic") - c("i") - c("c") + c("0"), "model_config": c("mc") - c("m") - c("c") + c("0"),
        "residual": c("imc") - c("im") - c("ic") - c("mc") + c("i") + c("m") + c("c") - c("0"),
    }
    less = {f: F.col(f"n_{f}") - 1 for f in "imc"}
    out = got.select(
        *by, F.col("n_i").alias("n_items"), F.col("n_m").alias("n_models"), F.col("n_c").alias("n_configs"),
        *[v.alias(f"ss_{k}") for k, v in ss.items()], *[_product(less, TERMS[k]).alias(f"df_{k}") for k in ss],
    )
    return out.select("*", *[F.try_divide(F.col(f"ss_{k}"), F.col(f"df_{k}").cast("double")).alias(f"ms_{k}") for k in ss])


def _product(less: dict[str, Column], factors: str) -> Column:
    out = F.lit(1)
    for f in factors:
        out = out * less[f]
    return out


def components(ms: DataFrame, floor: Column, by: list[str] | None = None, clamp: bool = True) -> DataFrame:
    """One row for each component: its variance by the method of moments, the floor taken off every mean square, and its
    share; negative ones count as 0 and are flagged."""
    v = {k: F.col(f"ms_{k}") - floor for k in TERMS}
    sizes = {"i": F.col("n_items"), "m": F.col("n_models"), "c": F.col("n_configs")}
    two = {k: (v[k] - v["residual"]) / next(sizes[f] for f in "imc" if f not in TERMS[k]) for k in ("item_model", "item_config", "model_config")}
    one = {}
    for k in ("item", "model", "config"):
        own = TERMS[k]
        pairs = [p for p in two if own in TERMS[p]]
        rest = [sizes[f] for f in "imc" if f != own]
        one[k] = (v[k] - v[pairs[0]] - v[pairs[1]] + v["residual"]) / (rest[0] * rest[1])
    found = {**one, **two, "residual": v["residual"]}
    kept = {k: F.greatest(x, F.lit(0.0)) if clamp else x for k, x in found.items()}
    total = sum(kept.values(), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(k).alias("component"), found[k].alias("variance"), (found[k] < 0).alias("negative"), F.when(total > 0, kept[k] / total).alias("share")) for k in TERMS])
    return ms.select(*(by or []), F.explode(rows).alias("x")).select(*(by or []), "x.*")


def noise_floor(c: DataFrame, reference: str) -> DataFrame:
    """One row: the replicate floor (variance of logits between seeds of a cell at the reference) and the analytic one."""
    z = st.haldane_logit(F.col("k"), F.col("n"))
    per = c.where(F.col("config") == reference).groupBy("item", "model").agg(F.var_samp(z).alias("v"), F.count(F.lit(1)).alias("seeds")).where("seeds >= 2")
    one = per.agg(F.avg("v").alias("replicate"), F.count(F.lit(1)).alias("n_pairs")).withColumn("_one", F.lit(1))
    two = c.agg(F.avg(st.haldane_logit_var(F.col("k"), F.col("n"))).alias("analytic")).withColumn("_one", F.lit(1))
    got = one.join(two, "_one").drop("_one")
    ratio = F.try_divide(F.col("replicate"), F.col("analytic"))
    return got.withColumns({"ratio": ratio, "suspicious": ~ratio.between(0.4, 2.5)})


def unsaturated(c: DataFrame) -> DataFrame:
    """Cells of items that are not saturated everywhere."""
    gone = c.groupBy("item").agg(F.bool_and(st.saturated(F.col("k"), F.col("n"))).alias("all")).where("all").select("item")
    return c.join(gone, "item", "left_anti")


def resampled_components(z: DataFrame, floors: DataFrame, replicates: int) -> DataFrame:
    """(replicate, component, variance, negative, share) of every bootstrap replicate over items, each over its own floor.

    ``z`` has one value a cell (item, model, config, z); ``floors`` has, for items, the sum ``fv`` and number ``fn`` of their variances
    between seeds. A replicate takes an item by its Poisson weight. What an item adds on its own is squared once and then only
    weighted; the margins without items are weighted sums by model and configuration. Both are folded where the items are
    read, so rows moved grow with replicates times models times configurations."""
    own = z.groupingSets([[F.col(c) for c in s] for s in (["item"], ["item", "model"], ["item", "config"], ["item", "model", "config"])], "item", "model", "config")
    own = own.agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("n"), F.grouping("model").alias("gm"), F.grouping("config").alias("gc"))
    part = lambda gm, gc: F.sum(F.when((F.col("gm") == gm) & (F.col("gc") == gc), F.col("s") * F.col("s") / F.col("n")))
    own = own.groupBy("item").agg(part(1, 1).alias("q_i"), part(0, 1).alias("q_im"), part(1, 0).alias("q_ic"), part(0, 0).alias("q_imc"))
    w = st.poisson_weight(F.col("_x"))
    items = with_replicates(own.join(floors, "item", "left"), "item", replicates).withColumn("_w", w)
    weighed = lambda c: F.sum(F.col("_w") * F.col(c))
    items = items.groupBy("replicate").agg(
        *[weighed(q).alias(q) for q in ("q_i", "q_im", "q_ic", "q_imc")], F.sum("_w").alias("n_i"), F.try_divide(weighed("fv"), weighed("fn").cast("double")).alias("_floor"),
    )
    cells = with_replicates(z.select("item", "model", "config", "z"), "item", replicates).withColumn("_w", w)
    cells = cells.groupBy("replicate", "model", "config").agg(weighed("z").alias("s"), F.sum("_w").alias("n")).where("n > 0")
    sets = (["replicate"], ["replicate", "model"], ["replicate", "config"], ["replicate", "model", "config"])
    sums = cells.groupingSets([[F.col(c) for c in s] for s in sets], "replicate", "model", "config")
    sums = sums.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.grouping("model").alias("gm"), F.grouping("config").alias("gc"))
    size = lambda gm, gc: F.count_if((F.col("gm") == gm) & (F.col("gc") == gc))
    sums = sums.groupBy("replicate").agg(
        part(1, 1).alias("q_0"), part(0, 1).alias("q_m"), part(1, 0).alias("q_c"), part(0, 0).alias("q_mc"), size(0, 1).alias("n_m"), size(1, 0).alias("n_c"),
    )
    ms = _squares(items.join(sums, "replicate"), ["replicate"]).join(items.select("replicate", "_floor"), "replicate")
    return components(ms, F.col("_floor"), ["replicate"])


def seed_floors(c: DataFrame, reference: str) -> DataFrame:
    """(item, fv, fn): sum and number of an item's variances of logits between seeds at the reference."""
    z = st.haldane_logit(F.col("k"), F.col("n"))
    per = c.where(F.col("config") == reference).groupBy("item", "model").agg(F.var_samp(z).alias("v"), F.count(F.lit(1)).alias("seeds")).where("seeds >= 2")
    return per.groupBy("item").agg(F.sum("v").alias("fv"), F.count(F.lit(1)).alias("fn"))
