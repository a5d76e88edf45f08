"""Bootstrap intervals and permutation tests whose randomness is a hash of unit and replicate.

A bootstrap replicate takes every unit as often as a Poisson count of mean 1 says, drawn from the hash, and its statistic is a
ratio of weighted sums. So a task folds its own units into one sum a group and replicate before anything moves: no draw is
joined back, no group is numbered, and rows moved grow with groups times replicates, not with units. Permutations flip signs
by the same hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import stats as st


def with_replicates(values: DataFrame, unit: str, replicates: int) -> DataFrame:
    """Every row once a replicate, with ``replicate`` and the draw ``_x`` of its unit there. Rows are dealt to all tasks
    first: few bytes of them are much work, and adaptive execution would join them into one task by their bytes."""
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = values.repartition(tasks, *values.columns).withColumn("_key", st.replicate_key(F.col(unit)))
    spread = keyed.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return spread.withColumn("_x", st.replicate_draw(F.col("_key"), F.col("replicate"))).drop("_key")


def replicate_means(values: DataFrame, by: list[str], unit: str, value: str, replicates: int) -> DataFrame:
    """Weighted mean of each replicate; null where it takes no unit."""
    rows = with_replicates(values.select(*by, unit, value).where(F.col(value).isNotNull()), unit, replicates)
    rows = rows.withColumn("_w", st.poisson_weight(F.col("_x")))
    return rows.groupBy(*by, "replicate").agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum("_w").cast("double")).alias("mean"))


def bootstrap_ci(values: DataFrame, by: list[str], unit: str, value: str, replicates: int, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean, one value a unit."""
    ends = F.percentile("mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    got = replicate_means(values, by, unit, value, replicates).groupBy(*by).agg(ends.alias("e"))
    point = values.groupBy(*by).agg(F.avg(value).alias("point"), F.count(F.lit(1)).alias("n"))
    return point.join(got, by).select(*by, "n", "point", F.col("e")[0].alias("ci_low"), F.col("e")[1].alias("ci_high"))


def paired_bootstrap(diffs: DataFrame, by: list[str], unit: str, value: str, replicates: int, alpha: float = 0.05) -> DataFrame:
    """The interval of a mean difference, and a two-sided p no less than one in the number of replicates."""
    means = replicate_means(diffs, by, unit, value, replicates)
    ends = F.percentile("mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    least = F.least(F.avg((F.col("mean") <= 0).cast("int")), F.avg((F.col("mean") >= 0).cast("int")))
    got = means.groupBy(*by).agg(ends.alias("e"), F.least(F.lit(1.0), F.greatest(2 * least, F.lit(1.0 / replicates))).alias("p_value"))
    point = diffs.groupBy(*by).agg(F.avg(value).alias("point"))
    return point.join(got, by).select(*by, "point", F.col("e")[0].alias("ci_low"), F.col("e")[1].alias("ci_high"), "p_value")


def bca_ci(values: DataFrame, by: list[str], unit: str, value: str, replicates: int, alpha: float = 0.05) -> DataFrame:
    """Bias-corrected and accelerated interval of a mean. The jackknife of a mean has a closed form, so acceleration is
    one aggregation."""
    means = replicate_means(values, by, unit, value, replicates)
    centred = values.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    point = centred.groupBy(*by).agg(
        F.avg(value).alias("point"), F.count(F.lit(1)).alias("n"),
        F.coalesce(F.try_divide(F.sum(F.pow("_d", F.lit(3.0))), 6 * F.pow(F.sum(F.pow("_d", F.lit(2.0))), F.lit(1.5))), F.lit(0.0)).alias("accel"),
    )
    joined = means.join(point, by)
    below = F.greatest(F.lit(0.5 / replicates), F.least(F.lit(1 - 0.5 / replicates), F.avg((F.round("mean", 12) < F.round("point", 12)).cast("int"))))
    got = joined.groupBy(*by).agg(
        F.first("point").alias("point"), F.first("n").alias("n"), F.first("accel").alias("accel"), st.normal_quantile(below).alias("z0"), F.array_sort(F.collect_list("mean")).alias("sorted"),  # one number a replicate
    )

    def end(q: float):
        z = st.normal_quantile(F.lit(q))
        level = st.normal_cdf(F.col("z0") + F.try_divide(F.col("z0") + z, 1 - F.col("accel") * (F.col("z0") + z)))
        spot = level * (F.size("sorted") - 1)
        low = F.floor(spot).cast("int")
        a, b = F.get("sorted", low), F.get("sorted", F.least(low + 1, F.size("sorted") - 1))
        return a + (spot - low) * (b - a)

    return got.select(*by, "n", "point", end(alpha / 2).alias("ci_low"), end(1 - alpha / 2).alias("ci_high"))


def sign_permutation(diffs: DataFrame, by: list[str], unit: str, value: str, replicates: int, side: str = "two-sided") -> DataFrame:
    """Permutation test of a mean difference by random signs: (1 + extreme) / (1 + replicates). ``side`` is two-sided,
    greater or less."""
    rows = with_replicates(diffs.select(*by, unit, value).where(F.col(value).isNotNull()), unit, replicates)
    sign = F.when(F.col("_x") >= st.MODULUS // 2, 1).otherwise(-1)
    means = rows.groupBy(*by, "replicate").agg(F.avg(F.col(value) * sign).alias("mean"))
    point = diffs.groupBy(*by).agg(F.avg(value).alias("point"))
    seen, own = F.round("mean", 12), F.round("point", 12)
    far: dict[str, Column] = {"two-sided": F.abs(seen) >= F.abs(own), "greater": seen >= own, "less": seen <= own}
    return means.join(point, by).groupBy(*by).agg(F.first("point").alias("point"), ((1 + F.count_if(far[side])) / F.lit(1.0 + replicates)).alias("p_value"))
