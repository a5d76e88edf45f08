"""Operators on logs and records: repeats, resuming, accuracy, cost and paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import stats as st


def last_wins(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key, with ``first_seen``, the order of its first; rows without a key all stay. One
    aggregation, combined before the shuffle, so that a key of any size is a small state."""
    rest = [c for c in log.columns if c != key]
    named = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last"), F.min(order).alias("first_seen"))
    loose = log.where(F.col(key).isNull()).withColumn("first_seen", F.col(order))
    return named.select(key, *[F.col(f"_last.{c}").alias(c) for c in rest], "first_seen").unionByName(loose)


def repeated_keys(log: DataFrame, key: str) -> DataFrame:
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def completed(log: DataFrame, key: str, failed: str, include_errors: bool = False) -> DataFrame:
    """Keys that need no further run."""
    return (log if include_errors else log.where(~F.coalesce(F.col(failed), F.lit(False)))).select(key).distinct()


def pending(planned: DataFrame, log: DataFrame, key: str, failed: str, include_errors: bool = False) -> DataFrame:
    """Planned rows whose key is not completed."""
    return planned.join(completed(log, key, failed, include_errors), key, "left_anti")


def ungraded(records: DataFrame, graded: DataFrame, key: str, version: str, order: str, current: int | str) -> DataFrame:
    """Records whose last grade is not of the current version."""
    done = graded.groupBy(key).agg(F.max_by(version, order).alias("v")).where(F.col("v") == F.lit(current))
    return records.join(done, key, "left_anti")


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """Rows numbered from 0 in the order given, which must tell rows apart, without gathering them in one task: rows go to
    ranges of ``order`` whose bounds are read off the table once, and only the ranges' sizes meet. Bounds are values,
    not samples of a run, so a task that runs again numbers its rows as before."""
    head = order[0]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(F.col(head), F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10_000))).first()[0] if parts > 1 else []
    bounds = sorted(set(cuts or []))
    rank = F.when(F.col(head).isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(head))) if bounds else F.lit(0))
    dealt = df.withColumn("_part", rank.cast("int"))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_at", own).join(F.broadcast(starts), "_part").withColumn("position", (F.col("_at") + F.col("_start")).cast("long")).drop("_part", "_at", "_start")


def shard(positioned: DataFrame, index: int, count: int) -> DataFrame:
    return positioned.where(F.col("position") % count == index)


def accuracy_summary(records: DataFrame, by: list[str], correct: str = "is_correct") -> DataFrame:
    """n, n_correct, accuracy and its Wilson interval."""
    got = records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(st.flag(correct)).cast("long").alias("n_correct"))
    low, high = st.wilson(F.col("n_correct"), F.col("n"))
    return got.select(*by, "n", "n_correct", st.ratio(F.col("n_correct"), F.col("n")).alias("accuracy"), low.alias("ci_low"), high.alias("ci_high"))


def token_cost(records: DataFrame, by: list[str], prompt: Column, completion: Column, calls: Column) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(zero(prompt)).alias("total_prompt"),
        F.sum(zero(completion)).alias("total_completion"),
        F.sum(zero(prompt) + zero(completion)).alias("total"),
        F.avg(zero(prompt)).alias("mean_prompt"),
        F.avg(zero(completion)).alias("mean_completion"),
        F.avg(zero(prompt) + zero(completion)).alias("mean_total"),
        F.avg(zero(calls)).alias("mean_calls"),
    )


def tokens_per_correct(records: DataFrame, by: list[str], completion: str, correct: str = "is_correct") -> DataFrame:
    """Tokens for each right answer; infinite where none is."""
    got = records.groupBy(*by).agg(F.sum(F.coalesce(F.col(completion), F.lit(0))).alias("t"), F.sum(st.flag(correct)).alias("c"))
    return got.select(*by, F.when(F.col("c") > 0, st.ratio(F.col("t"), F.col("c"))).otherwise(F.lit(float("inf"))).alias("tokens_per_correct"))


def paired(records: DataFrame, key: list[str], order: str, side: str, a: str, b: str, value: str = "is_correct") -> DataFrame:
    """Both sides' last value on every key that either has: in_a, in_b, a, b. One aggregation, no join."""
    own = records.where(F.col(side).isin(a, b))
    last = lambda name: F.max_by(F.when(F.col(side) == name, st.flag(value)), F.when(F.col(side) == name, F.col(order)))
    has = lambda name: F.max((F.col(side) == name).cast("int")) == 1
    return own.groupBy(*key).agg(last(a).alias("a"), last(b).alias("b"), has(a).alias("in_a"), has(b).alias("in_b"))


def mcnemar(b01: str, b10: str, exact: bool = True) -> tuple[Column, Column, Column]:
    """Method, statistic and p of McNemar's test; if not ``exact``, the corrected chi-square from 25 discordant pairs on."""
    n, small = F.col(b01) + F.col(b10), F.least(b01, b10)
    chi2, p = st.mcnemar_chi2(F.col(b01), F.col(b10))
    far = F.lit(not exact) & (n >= 25)
    return (
        F.when(far, "chi2_1df_continuity_corrected").otherwise("exact_binomial"), F.when(far, chi2).when(n > 0, small.cast("double")),
        F.when(far, p).otherwise(st.binomial_two_sided(small, n)),
    )


def comparison(pairs: DataFrame, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Counts, accuracies and McNemar's test over pairs."""
    both = F.col("in_a") & F.col("in_b")
    got = pairs.groupBy(*(by or [])).agg(
        F.count_if(both).alias("n_pairs"),
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("n_only_a"),
        F.count_if(F.col("in_b") & ~F.col("in_a")).alias("n_only_b"),
        F.avg(F.when(both, F.col("a"))).alias("accuracy_a"),
        F.avg(F.when(both, F.col("b"))).alias("accuracy_b"),
        F.count_if(both & (F.col("a") == 0) & (F.col("b") == 1)).alias("b01"),
        F.count_if(both & (F.col("a") == 1) & (F.col("b") == 0)).alias("b10"),
    )
    method, statistic, p = mcnemar("b01", "b10", exact)
    return got.withColumns({"delta": F.col("accuracy_b") - F.col("accuracy_a"), "method": method, "statistic": statistic, "p_value": p})


def holm(df: DataFrame, family: list[str], p: str, position: str, alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values of every family, and whether each is rejected."""
    order = Window.partitionBy(*family).orderBy(p, position)
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    raw = F.least(F.lit(1.0), (size - F.row_number().over(order) + 1) * F.col(p))
    stepped = df.withColumn("_raw", raw)
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    return stepped.withColumn("p_holm", F.max("_raw").over(up)).withColumn("reject", F.col("p_holm") <= alpha).drop("_raw")


def running_total(df: DataFrame, by: list[str], order: str, value: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def recent_mean(by: list[str], order: str, value: str, last: int = 20) -> Column:
    return F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - last, 0))
