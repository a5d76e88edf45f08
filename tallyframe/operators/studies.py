"""Operators over whole studies: every strategy against a baseline, decompositions of every group, planners, item tiers
and orders, parsed choices, and the oracles and controls of budgeted voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import stats as st
from tallyframe.operators import records as rec
from tallyframe.operators import variance as va


def compare_all(records: DataFrame, by: list[str], key: list[str], order: str, side: str, baseline: str, value: str = "is_correct") -> DataFrame:
    """Every other strategy against the baseline in every group that has it, seeds pooled by their keys. A key's strategies
    meet in one row, each with its last value, so no strategy is joined to another."""
    last = records.groupBy(*by, *key, side).agg(F.max_by(st.flag(value), order).alias("v"))
    met = last.groupBy(*by, *key).agg(F.map_from_entries(F.collect_list(F.struct(side, "v"))).alias("m"))
    names = records.select(*by, F.col(side).alias(side)).distinct()
    has = names.where(F.col(side) == baseline).select(*by)
    others = names.where(F.col(side) != baseline).join(has, by, "left_semi").groupBy(*by).agg(F.collect_set(side).alias("others"))
    rows = met.join(F.broadcast(others), by).withColumn(side, F.explode("others"))
    a, b = F.try_element_at("m", F.lit(baseline)), F.try_element_at("m", F.col(side))
    pairs = rows.select(*by, side, a.alias("a"), b.alias("b"), a.isNotNull().alias("in_a"), b.isNotNull().alias("in_b"))
    return rec.comparison(pairs, [*by, side])


def decompose_all(cells: DataFrame, by: list[str], reference: str, least: int = 3) -> DataFrame:
    """Variance components of every group (by, component, variance, negative, share) over its floor: the variance between
    the seeds of cells at the reference, over all groups. Groups of under ``least`` items are left out."""
    floor = va.noise_floor(cells, reference).select(F.col("replicate").alias("_floor"), F.lit(1).alias("_one"))
    z = cells.withColumn("z", st.haldane_logit(F.col("k"), F.col("n")))
    ms = va.mean_squares(z, by).where(F.col("n_items") >= least).withColumn("_one", F.lit(1)).join(F.broadcast(floor), "_one")
    return va.components(ms, F.col("_floor"), by)


def backend_stats(calls: DataFrame, by: list[str], prompt: str, completion: str, seconds: str) -> DataFrame:
    """Counters of a backend and its completion tokens a second, null where no time was spent."""
    got = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(prompt).alias("tokens_prompt"), F.sum(completion).alias("tokens_completion"), F.sum(seconds).alias("seconds"))
    speed = F.round(F.when(F.col("seconds") > 0, F.col("tokens_completion") / F.col("seconds")), 2)
    return got.withColumns({"tokens_total": F.col("tokens_prompt") + F.col("tokens_completion"), "completion_tokens_per_s": speed})


def run_hours(examples: Column, seconds: Column, strategies: Column | int = 1, seeds: Column | int = 1, overhead_minutes: float = 15.0) -> Column:
    """Hours that a run takes."""
    return (examples * seconds * strategies * seeds + overhead_minutes * 60.0) / 3600.0


#: Bytes of a parameter.
PARAMETER_BYTES = {"float32": 4.0, "float16": 2.0, "bfloat16": 2.0}


def weights_gb(billions: Column, dtype: str = "float16", four_bit: bool = False) -> Column:
    """Memory of a model's weights, without cache and activations."""
    return F.round(billions * 1e9 * (0.55 if four_bit else PARAMETER_BYTES.get(dtype, 2.0)) / 1024**3, 2)


def tier(items: DataFrame, key: str, size: int, which: str, seed: int = 0) -> DataFrame:
    """The items of a tier: A the first ``size`` in a fixed random order, B the next ones, AB both. Only the best
    of each task meet."""
    first, last = {"A": (0, size), "B": (size, 2 * size), "AB": (0, 2 * size)}[which]
    head = items.withColumn("_k", st.order_key(F.lit(seed), F.col(key))).orderBy("_k", key).limit(last)
    place = F.row_number().over(Window.orderBy("_k", key)) - 1
    return head.withColumn("_at", place).where(F.col("_at") >= first).drop("_k", "_at")


def truncated(text: Column, limit: int = 400) -> Column:
    """A text of at most ``limit`` characters, cut ones with an ellipsis."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 3)), F.lit("...")))


def chunk(position: Column, size: int) -> Column:
    """Which run of ``size`` rows a position is in."""
    if size <= 0:
        raise ValueError("a chunk holds one row at least")
    return F.floor(position / size).cast("long")


def shuffled_choices(key: Column, choices: Column, gold: Column) -> Column:
    """struct(choices, letter): the choices in a random order of the key, and the letter of the right one."""
    mixed = F.transform(F.array_sort(F.transform(choices, lambda c, i: F.struct(st.order_key(key, i).alias("o"), c.alias("c")))), lambda x: x["c"])
    return F.struct(mixed.alias("choices"), F.substring(F.lit("ABCDEFGHIJ"), F.array_position(mixed, gold).cast("int"), F.lit(1)).alias("letter"))


def listed_choices(text: Column) -> Column:
    """Choices written as a list literal, else between bars, else one; none for an empty text."""
    t = F.trim(text)
    quoted = F.regexp_extract_all(t, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    items = F.transform(quoted, lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"))
    return F.when(t == "", F.array().cast("array<string>")).when(t.rlike(r"^\[.*\]$"), items).otherwise(F.transform(F.split(t, r"\|"), lambda x: F.trim(x)))


def inline_options(question: Column) -> Column:
    """The options that a question lists on lines of their own as (A) and so on; null for under two."""
    found = F.regexp_extract_all(question, F.lit(r"(?m)^\s*\([A-Z]\)\s*(.+)$"), F.lit(1))
    return F.when(F.size(found) >= 2, F.transform(found, lambda x: F.trim(x)))


def hard_halves(cells: DataFrame, by: list[str], share: float = 0.5) -> DataFrame:
    """(by, jaccard) of the hardest items of a group by difficulty (least accuracy) and by uncertainty (accuracy next to one half)."""
    p = st.ratio(F.col("k"), F.col("n"))
    own = Window.partitionBy(*by)
    size = F.greatest(F.lit(1), F.bround(F.lit(share) * F.count(F.lit(1)).over(own)).cast("int"))
    ranked = cells.select(*by, "item", (F.row_number().over(own.orderBy(p, "item")) <= size).alias("a"), (F.row_number().over(own.orderBy(F.abs(2 * p - 1), "item")) <= size).alias("b"))
    return ranked.groupBy(*by).agg(st.ratio(F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a") | F.col("b"))).alias("jaccard"))


def controls(draws: DataFrame, by: list[str], unit: list[str]) -> DataFrame:
    """Accuracy of the methods that choose among configurations after the fact or blindly, from each one's votes
    (by, unit, config, correct): oracle_config (any is right), best_single (the best on average) and random_config (by a hash)."""
    pick = F.min_by("correct", st.order_key(*[F.col(c) for c in (*by, *unit)], F.col("config")))
    each = draws.groupBy(*by, *unit).agg(F.max(F.col("correct").cast("int")).alias("oracle_config"), pick.cast("int").alias("random_config"))
    blind = each.groupBy(*by).agg(F.avg("oracle_config").alias("oracle_config"), F.avg("random_config").alias("random_config"))
    best = draws.groupBy(*by, "config").agg(F.avg(F.col("correct").cast("int")).alias("x")).groupBy(*by).agg(F.max("x").alias("best_single"))
    return blind.join(best, by)
