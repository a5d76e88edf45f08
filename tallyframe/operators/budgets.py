"""Voting at equal token budgets: pools of chains, allocators that draw from them, and their comparison.

Chains are drawn without replacement in a random order (a hash), and one that does not fit what is left is skipped, so
spend never exceeds the budget. The order of an item's chains is kept in one row; a draw is a fold over it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import stats as st
from tallyframe.sources.adapters import UNPARSED

CHAIN = "struct<key:string,idx:bigint,tok:bigint,cls:string,ok:boolean>"


def chains_of(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by, chains): an item's chains in no order and without keys; tokens count as 1 at least."""
    chain = F.struct(F.lit(None).cast("string").alias("key"), F.col("idx"), F.greatest(F.col("tok"), F.lit(1)).alias("tok"), F.col("cls"), F.col("ok"))
    return samples.groupBy(*by).agg(F.collect_list(chain).alias("chains"))


def shuffled(chains: Column, *parts: Column) -> Column:
    """Chains in the order of a hash of the parts and their place."""
    keyed = lambda head: F.transform(chains, lambda c: c.withField("key", st.order_key(head, c["idx"])))
    return F.array_sort(st.let(F.concat_ws("-", *[p.cast("string") for p in parts]), keyed))


def each_replicate(df: DataFrame, replicates: int) -> DataFrame:
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))


def pools(samples: DataFrame, by: list[str], replicates: int) -> DataFrame:
    """(by, replicate, chains): an item's chains in the replicate's random order. Chains meet in a row once, and are
    ordered there for each replicate."""
    return dealt(chains_of(samples, by), by, replicates)


def dealt(chains: DataFrame, by: list[str], replicates: int) -> DataFrame:
    """Rows of ``chains_of``, with columns joined since, once a replicate and in its order."""
    own = shuffled(F.col("chains"), F.col("replicate"), *[F.col(b) for b in by])
    return each_replicate(chains, replicates).withColumn("chains", own)


def take_within(chains: Column, budget: Column) -> Column:
    """struct(spent, taken): chains in order as long as the budget allows, others skipped."""
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.array().cast(f"array<{CHAIN}>").alias("taken"))

    def step(acc: Column, c: Column) -> Column:
        grown = F.struct((acc["spent"] + c["tok"]).alias("spent"), F.concat(acc["taken"], F.array(c)).alias("taken"))
        return F.when(acc["spent"] + c["tok"] <= budget, grown).otherwise(acc)

    return F.aggregate(chains, start, step)


def vote_of(taken: Column) -> Column:
    """struct(correct, top): see ``vote``."""
    right = lambda top: F.coalesce(F.exists(taken, lambda c: c["cls"].eqNullSafe(top) & c["ok"]), F.lit(False))
    result = lambda top: F.struct((right(top) & (F.coalesce(top, F.lit(UNPARSED)) != UNPARSED)).alias("correct"), top.alias("top"))
    return st.let(st.plurality(F.transform(taken, lambda c: c["cls"])), result)


def vote(df: DataFrame, key: list[str], taken: str = "taken", weight: Column | None = None) -> DataFrame:
    """(key, correct, top): the plurality of the taken chains, ties to the first; failed extractions may win, and are
    wrong. Without a chain the vote is wrong. Without weights the vote is counted within the row."""
    if weight is None:
        return df.select(*key, vote_of(F.col(taken)).alias("v")).select(*key, "v.correct", "v.top")
    each = df.select(*key, F.posexplode_outer(taken).alias("at", "c"))
    counts = each.groupBy(*key, F.col("c.cls").alias("cls")).agg(F.round(F.sum(F.when(F.col("c").isNotNull(), weight)), 12).alias("w"), F.min("at").alias("first"), F.max("c.ok").alias("ok"))
    best = counts.groupBy(*key).agg(F.max_by(F.struct("cls", "ok"), F.struct("w", (-F.col("first")).alias("f"))).alias("b"))
    return best.select(*key, (F.coalesce(F.col("b.ok"), F.lit(False)) & (F.coalesce(F.col("b.cls"), F.lit(UNPARSED)) != UNPARSED)).alias("correct"), F.col("b.cls").alias("top"))


def token_budgets(samples: DataFrame, by: list[str], reference: str, multiples: tuple[int, ...], slack: float = 1.05) -> DataFrame:
    """Budgets as multiples of the mean chain at the reference; kept where every configuration's items can spend that
    much on average, with a little slack."""
    per = samples.groupBy(*by, "item", "config").agg(F.avg("tok").alias("mean"), F.sum("tok").alias("all"))
    base = per.where(F.col("config") == reference).groupBy(*by).agg(F.avg("mean").alias("unit"))
    room = per.groupBy(*by, "config").agg(F.avg("all").alias("room")).groupBy(*by).agg(F.min("room").alias("room"))
    got = base.join(room, by).withColumn("multiple", F.explode(F.array(*[F.lit(m) for m in multiples])))
    budget = F.col("unit") * F.col("multiple")
    return got.select(*by, "multiple", budget.alias("budget"), "room", (budget <= F.col("room") * slack).alias("kept"))


def early_stop(chains: Column, budget: Column, window: int = 4) -> Column:
    """struct(spent, taken, done): chains in order that the budget allows, others skipped, until the last ``window`` taken
    are of one class."""
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.array().cast(f"array<{CHAIN}>").alias("taken"), F.lit(False).alias("done"))

    def step(acc: Column, c: Column) -> Column:
        spent, taken = acc["spent"] + c["tok"], F.concat(acc["taken"], F.array(c))
        last = F.slice(taken, -window, window)
        agreed = F.when(F.size(taken) >= window, F.size(F.array_distinct(F.transform(last, lambda x: x["cls"]))) == 1).otherwise(False)
        grown = F.struct(spent.alias("spent"), taken.alias("taken"), agreed.alias("done"))
        return F.when(acc["done"] | (spent > budget), acc).otherwise(grown)

    return F.aggregate(chains, start, step)


def round_robin(df: DataFrame, budget_col: str = "budget", adaptive: int | None = None) -> DataFrame:
    """Spreads each row's budget over its configurations: turn by turn, each takes its next chain that fits.
    ``chains`` maps configurations to ordered chains. With ``adaptive``, the first so many of each are probed first: if the
    modes of what fits agree, nothing more is spent, else the rest goes round the configurations that have a mode.
    Returns spent and taken in place of chains. Only tokens, and the classes of probes, leave the row."""
    keep = [c for c in df.columns if c != "chains"]
    own = df.select(*keep, F.transform(F.array_sort(F.map_keys("chains")), lambda name: F.element_at("chains", name)).alias("_own"))
    toks = F.transform("_own", lambda cs: F.transform(cs, lambda c: c["tok"]))
    probes = F.transform("_own", lambda cs: F.transform(F.slice(cs, 1, adaptive or 0), lambda c: c["cls"]))
    got = own.withColumn("_turns", _turns_udf(adaptive)(toks, probes, F.col(budget_col).cast("double")))
    place = lambda p: F.get(F.get(F.col("_own"), p["config"]), p["at"])
    return got.select(*keep, F.col("_turns.spent").alias("spent"), F.transform("_turns.places", place).alias("taken"))


_TURNS = pa.struct([("spent", pa.int64()), ("places", pa.list_(pa.struct([("config", pa.int32()), ("at", pa.int32())])))])


def _turns_udf(adaptive: int | None):
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for toks, probes, budgets in batches:
            got = [_spread(t, c, b, adaptive) for t, c, b in zip(toks.to_pylist(), probes.to_pylist(), budgets.to_pylist(), strict=True)]
            sizes = np.cumsum([0, *[len(g[1]) for g in got]]).astype(np.int32)
            flat = [p for g in got for p in g[1]]
            parts = [pa.array([p[i] for p in flat], pa.int32()) for i in (0, 1)]
            places = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(parts, ["config", "at"]))
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.int64()), places], fields=list(_TURNS))

    return F.arrow_udf(run, "spent bigint, places array<struct<config:int,at:int>>")


def _spread(toks: list[list[int]], probes: list[list[str]], budget: float, adaptive: int | None) -> tuple[int, list[tuple[int, int]]]:
    """What is spent, and configuration and position of each chain taken."""
    spent, taken = 0, []

    def fits(c: tuple[int, int, int]) -> bool:
        nonlocal spent
        if spent + c[2] > budget:
            return False
        spent += c[2]
        taken.append(c[:2])
        return True

    ahead = {name: iter([(name, at, t) for at, t in enumerate(own)]) for name, own in enumerate(toks)}
    if adaptive:
        # What a probe passes over for not fitting is not looked at again.
        probed = {name: [probes[name][c[1]] for c in islice(own, adaptive) if fits(c)] for name, own in ahead.items()}
        modes = {name: Counter(seen).most_common(1)[0][0] for name, seen in probed.items() if seen}
        if len(set(modes.values())) == 1:
            return spent, taken
        ahead = {name: own for name, own in ahead.items() if name in modes} or ahead
    while any([any(map(fits, own)) for own in ahead.values()]):
        pass
    return spent, taken


def compare_scores(scores: DataFrame, by: list[str], method: str, reference: str, score: str = "score") -> DataFrame:
    """Per item, each method against the reference: mean difference and McNemar's test on scores over one half, then
    Holm's adjustment over the methods of a group."""
    from tallyframe.operators import records as rec

    base = scores.where(F.col(method) == reference).select(*by, "item", F.col(score).alias("_ref"))
    joined = scores.where(F.col(method) != reference).join(base, [*by, "item"])
    flags = joined.select(*by, method, (F.col(score) - F.col("_ref")).alias("diff"), (F.col("_ref") > 0.5).cast("int").alias("a"), (F.col(score) > 0.5).cast("int").alias("b"))
    got = flags.groupBy(*by, method).agg(
        F.count(F.lit(1)).alias("n_items"), F.avg("diff").alias("mean_diff"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("b01"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("b10")
    )
    got = got.withColumn("p_value", st.binomial_two_sided(F.least("b01", "b10"), F.col("b01") + F.col("b10")))
    return rec.holm(got, by, "p_value", method)


def audit_sample(samples: DataFrame, by: list[str], n: int) -> DataFrame:
    """Per group n rows to look at: half of them parsed, the rest failures, picked by a hash."""
    key = [F.col(c) for c in ("item", "model", "config", "seed", "idx")]
    failed = F.col("cls") == UNPARSED
    least = n - n // 2
    # First within parts of a group, so that a group of any size is ranked by many tasks, then among what the parts leave.
    order = st.order_key(*key)
    keyed = samples.withColumns({"failed": failed, "_key": order}).withColumn("_part", F.substring("_key", -3, 3))
    rank = lambda *parts: F.row_number().over(Window.partitionBy(*by, "failed", *parts).orderBy("_key"))
    few = keyed.withColumn("_r", rank("_part")).where(F.col("_r") <= least)
    placed = few.withColumn("_r", rank()).where(F.col("_r") <= least)
    return placed.where(F.col("failed") | (F.col("_r") <= n // 2)).drop("_r", "_key", "_part")
