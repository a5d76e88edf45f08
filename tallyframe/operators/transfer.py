"""How difficulty carries over between configurations, models and seeds: ranks, reliability and hard subsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import identity as ident
from tallyframe.functions import stats as st


def pairs_of(df: DataFrame, by: list[str], level: str, value: str, item: str = "item", rank: Column | None = None) -> DataFrame:
    """Each item's values at two levels: (by, item, a, b, x, y), a before b. The levels of an item meet in one row."""
    order = F.col(level) if rank is None else rank
    got = df.groupBy(*by, item).agg(F.array_sort(F.collect_list(F.struct(order.alias("r"), F.col(level).alias("level"), F.col(value).alias("v")))).alias("xs"))
    first = got.select(*by, item, "xs", F.posexplode("xs").alias("at", "p"))
    both = first.select(*by, item, "p", F.explode(F.slice("xs", F.col("at") + 2, F.size("xs"))).alias("q"))
    return both.select(*by, item, F.col("p.level").alias("a"), F.col("q.level").alias("b"), F.col("p.v").alias("x"), F.col("q.v").alias("y"))


def spearman(pairs: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Rank correlation of x and y over the rows of a group, ties at their mean rank."""
    keys = [F.col(b) for b in by]
    ranked = pairs.withColumns({"_rx": st.average_rank(F.col("x"), keys), "_ry": st.average_rank(F.col("y"), keys)})
    got = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"), st.correlation(F.col("_rx"), F.col("_ry")).alias("rho"))
    return got.where(F.col("n_items") >= least)


def reliability(c: DataFrame, by: list[str]) -> DataFrame:
    """Mean rank correlation of p_hat over pairs of seeds."""
    per = spearman(pairs_of(c, by, "seed", "p_hat"), [*by, "a", "b"])
    return per.groupBy(*by).agg(F.avg("rho").alias("r_mm"), F.count(F.lit(1)).alias("n_pairs"), F.first("n_items").alias("n_items"))


def disattenuated(rho: Column, r: Column) -> Column:
    """Correlation over the one that noise alone allows; undefined for a reliability that is not positive."""
    return F.when(r > 0, rho / r)


def hard_subset(df: DataFrame, by: list[str], value: str, item: str = "item", share: float = 0.25, tie: Column | None = None) -> DataFrame:
    """The items of least value, ties by a hash of the item (``tie`` where it is known); at least one, their number rounded half to even."""
    whole = Window.partitionBy(*by)
    order = whole.orderBy(F.col(value).asc_nulls_last(), ident.stable_hash(F.col(item), 8) if tie is None else tie, item)
    size = F.greatest(F.lit(1), F.bround(F.lit(share) * F.count(F.lit(1)).over(whole)).cast("int"))
    return df.withColumns({"_r": F.row_number().over(order), "_size": size}).where("_r <= _size").drop("_r", "_size")


def boundary_ties(df: DataFrame, by: list[str], value: str, share: float = 0.25) -> DataFrame:
    """Share of items whose value equals the one at the cut."""
    whole = Window.partitionBy(*by)
    size = F.greatest(F.lit(1), F.bround(F.lit(share) * F.count(F.lit(1)).over(whole)).cast("int"))
    placed = df.withColumns({"_r": F.row_number().over(whole.orderBy(value)), "_size": size})
    cut = placed.withColumn("_cut", F.max(F.when(F.col("_r") == F.col("_size"), F.col(value))).over(whole))
    return cut.groupBy(*by).agg(F.avg((F.col(value) == F.col("_cut")).cast("int")).alias("tie_fraction"))


def jaccard(members: DataFrame, by: list[str], level: str, item: str = "item") -> DataFrame:
    """Overlap of the item sets of two levels: |both| / |either|; undefined for two empty sets."""
    sizes = members.groupBy(*by, level).agg(F.count(F.lit(1)).alias("size"))
    shared = pairs_of(members.withColumn("_v", F.lit(1)), by, level, "_v", item).groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("both"))
    levels = sizes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(level, "size"))).alias("xs"))
    first = levels.select(*by, "xs", F.posexplode("xs").alias("at", "p"))
    pairs = first.select(*by, "p", F.explode(F.slice("xs", F.col("at") + 2, F.size("xs"))).alias("q"))
    pairs = pairs.select(*by, F.col(f"p.{level}").alias("a"), F.col(f"q.{level}").alias("b"), (F.col("p.size") + F.col("q.size")).alias("total"))
    got = pairs.join(shared, [*by, "a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return got.withColumn("jaccard", st.ratio(F.col("both"), F.col("total") - F.col("both"))).drop("total", "both")


def quantile_bucket(df: DataFrame, by: list[str], value: str, parts: int) -> DataFrame:
    """``bucket`` of each row between linear quantiles, closed below; the last one above too."""
    edges = df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(i / parts) for i in range(1, parts)])).alias("_edges"))
    got = df.join(F.broadcast(edges) if not by else edges, by) if by else df.withColumn("_one", F.lit(1)).join(F.broadcast(edges.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return got.withColumn("bucket", F.size(F.filter("_edges", lambda e: e <= F.col(value)))).drop("_edges")


def binomial_steps(n: int, p: np.ndarray) -> np.ndarray:
    """Per place of ``p`` a column of the least draws below ``stats.MODULUS`` at which a binomial count of n is over 0, over 1, up
    to n - 1; terms are summed as logarithms, so any n fits."""
    sure = np.maximum(1e-300, np.minimum(1.0 - 1e-16, p))
    term, total, odds = n * np.log1p(-sure), np.zeros(len(p)), np.log(sure) - np.log1p(-sure)
    steps = np.empty((n, len(p)), np.int64)
    for k in range(n):
        total += np.exp(term)
        term += np.log((n - k) / (k + 1)) + odds
        steps[k] = np.floor(total * st.MODULUS + 0.5)
    return steps


def _draws(a: np.ndarray, b: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """``stats.replicate_draw`` of keys in replicates; a remainder by 2**31 - 1 is a sum of bits above and below."""

    def rest(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = (x & st.MODULUS) + (x >> 31)
        return np.where(x >= st.MODULUS, x - st.MODULUS, x)

    x = rest(a[None, :] + replicates[:, None] * st.STRIDE)
    for _ in range(st.SQUARINGS):
        x = rest(x * x + b[None, :])
    return x


#: Cells whose draws are compared with their steps at once; it bounds what a comparison holds.
BLOCK = 2_048


def binomial_counts(n: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Binomial counts (replicate, cell) by the draws of keys (a, b). Cells of one n are drawn together."""
    counts = np.zeros((len(replicates), len(n)), np.int32)
    order = np.argsort(n, kind="stable")
    edges = np.flatnonzero(np.diff(n[order], prepend=-1))
    for start, stop in zip(edges, [*edges[1:], len(n)], strict=True):
        for at in range(start, stop, BLOCK):
            cells = order[at : min(at + BLOCK, stop)]
            steps = binomial_steps(int(n[cells[0]]), p[cells]).clip(max=st.MODULUS).astype(np.int32)
            x = _draws(a[cells], b[cells], replicates).astype(np.int32)
            got = np.zeros(x.shape, np.int32)
            for step in steps:
                got += step <= x
            counts[:, cells] = got
    return counts


def _hard(values: np.ndarray, share: float = 0.25) -> np.ndarray:
    """Which places of values in the order of their tie breaks are hard: see ``hard_subset``."""
    size = max(1, round(share * len(values)))
    cut = np.partition(values, size - 1)[size - 1]
    hard = values < cut
    hard[np.flatnonzero(values == cut)[: size - np.count_nonzero(hard)]] = True
    return hard


def _overlap(values: list[np.ndarray], places: list[np.ndarray], items: int) -> float | None:
    """Mean overlap of the hard items over all pairs of levels, |both| / |either|; None for a single level."""
    sets = []
    for v, at in zip(values, places, strict=True):
        sets.append(np.zeros(items, bool))
        sets[-1][at[_hard(v)]] = True
    shares = [np.count_nonzero(x & y) / np.count_nonzero(x | y) for i, x in enumerate(sets) for y in sets[i + 1 :]]
    return sum(shares) / len(shares) if shares else None


#: Parts that the replicates of a group are dealt to, each with all its cells.
PARTS = 16


def null_overlaps(cells: DataFrame, by: list[str], level: str, draws: int) -> DataFrame:
    """(by, observed, jaccard) a replicate, of cells (by, level, item, n, p_hat). The cells of an item meet in a row, which goes to
    every part of the replicates; a part draws its cells a replicate at a time and sends back overlaps alone. So what moves grows
    with cells, not with draws, and a part holds some 40 bytes a cell of one group, and its counts."""
    unit = F.concat_ws("-", *by, level, "item")
    own = F.struct(F.col(level).cast("string").alias("level"), F.col("n").cast("long").alias("n"), F.col("p_hat").alias("v"), st.replicate_key(unit).alias("key"))
    met = cells.groupBy(*by, "item").agg(F.collect_list(own).alias("xs"), F.avg("p_hat").alias("p"))
    met = met.withColumn("tie", ident.stable_hash(F.col("item"), 8)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*by).schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("tie", "ascending"), ("item", "ascending")])).combine_chunks()
        xs = table["xs"].combine_chunks()
        flat, at = xs.flatten(), pc.list_parent_indices(xs).to_numpy()
        take = lambda *path: pc.struct_field(flat, list(path)).to_numpy(zero_copy_only=False)
        n, v, a, b = take("n"), take("v"), take("key", "a"), take("key", "b")
        names = pc.struct_field(flat, ["level"]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        p = table["p"].to_numpy()[at]
        groups = [np.flatnonzero(names == i) for i in range(names.max() + 1)]
        places, items = [at[g] for g in groups], table.num_rows
        seen = _overlap([np.where(np.isnan(v[g]), np.inf, v[g]) for g in groups], places, items)
        mine, found = np.arange(table["part"][0].as_py(), draws, PARTS), []
        room = max(1, 40_000_000 // len(n))
        for start in range(0, len(mine), room):
            for counts in binomial_counts(n, p, a, b, mine[start : start + room]):
                drawn = np.where(n > 0, counts / np.maximum(n, 1), np.inf)
                found.append(_overlap([drawn[g] for g in groups], places, items))
        keys = [pa.chunked_array([pc.take(table[c].combine_chunks(), pa.array(np.zeros(len(found), np.int64)))]) for c in by]
        return pa.table([*keys, pa.array([seen] * len(found), pa.float64()), pa.array(found, pa.float64())], names=[*by, "observed", "jaccard"])

    return met.groupBy(*by, "part").applyInArrow(run, f"{fields}, observed double, jaccard double")


def reestimation_null(c: DataFrame, by: list[str], level: str, draws: int) -> DataFrame:
    """(by, observed, null_mean, null_std, null_q05, p_value, n_draws): the overlap of hard items between levels against the one
    that sampling alone would leave. Under the null an item has one difficulty, its mean p_hat, and every cell (by, level,
    item, n, p_hat) is drawn anew from a binomial of its own n; p is one-sided, for less overlap."""
    seen = null_overlaps(c, by, level, draws)
    low = F.count_if(F.round("jaccard", 12) <= F.round("observed", 12))
    return seen.groupBy(*by).agg(
        F.first("observed").alias("observed"), F.avg("jaccard").alias("null_mean"), F.stddev_samp("jaccard").alias("null_std"), F.percentile("jaccard", F.lit(0.05)).alias("null_q05"),
        ((1 + low) / (1.0 + F.count(F.lit(1)))).alias("p_value"), F.count(F.lit(1)).alias("n_draws"),
    )
