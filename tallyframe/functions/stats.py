"""Statistics as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quantile of the standard normal at 0.975.
Z95 = 1.959963984540054

# Coefficients of the rational approximation of erf, error under 1.5e-7.
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911

# Coefficients of Acklam's rational approximation of the normal quantile.
_QA = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_QB = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_QC = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_QD = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def plurality(labels: Column) -> Column:
    """The most frequent element of an array, ties to the first; null for an empty one."""
    count = lambda c: F.size(F.filter(labels, lambda x: x.eqNullSafe(c)))
    return let(F.array_distinct(labels), lambda seen: let(F.transform(seen, count), lambda n: F.get(seen, (F.array_position(n, F.array_max(n)) - 1).cast("int"))))


def flag(c: Column | str) -> Column:
    """1 for true, 0 for false or unknown."""
    return F.coalesce(col(c).cast("int"), F.lit(0))


def r6(c: Column | str) -> Column:
    return F.round(col(c), 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b, or null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of k successes out of n; (0, 0) for none."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    d = 1 + F.try_divide(F.lit(z * z), n.cast("double"))
    mid = (p + F.try_divide(F.lit(z * z / 2), n.cast("double"))) / d
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n.cast("double")) + F.try_divide(F.lit(z * z / 4), n.cast("double") * n)) / d
    bound = lambda x: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), F.lit(0.0))
    return bound(mid - half), bound(mid + half)


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """Chance that k of n samples, c of them right, hold a right one; null for n < k or k < 1. The product form
    is stable for any n."""
    miss = F.aggregate(F.sequence(F.lit(0), (k - 1).cast("int")), F.lit(1.0), lambda acc, i: acc * (n - c - i) / (n - i))
    inner = F.when(c <= 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(1 - miss)
    return F.when((k >= 1) & (n >= k), inner)


def haldane_logit(k: Column, n: Column, add: float = 0.5) -> Column:
    return F.log((k + add) / (n - k + add))


def haldane_logit_var(k: Column, n: Column, add: float = 0.5) -> Column:
    return 1 / (k + add) + 1 / (n - k + add)


def saturated(k: Column, n: Column) -> Column:
    return (k <= 0) | (k >= n)


def erf(x: Column) -> Column:
    """Error function, right to 1.5e-7."""
    a = F.abs(x)
    t = 1 / (1 + _ERF_P * a)
    poly = F.lit(0.0)
    for c in reversed(_ERF):
        poly = (poly + c) * t
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / 2**0.5))


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function; null outside (0, 1)."""

    def horner(coefficients: tuple[float, ...], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    low = 0.02425
    tail = lambda q: horner(_QC, q) / (horner(_QD, q) * q + 1)
    r = (p - 0.5) * (p - 0.5)
    middle = horner(_QA, r) * (p - 0.5) / (horner(_QB, r) * r + 1)
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < low, tail(F.sqrt(-2 * F.log(p))))
        .when(p > 1 - low, -tail(F.sqrt(-2 * F.log(1 - p))))
        .otherwise(middle)
    )


def binomial_two_sided(small: Column, n: Column) -> Column:
    """Two-sided exact p of the smaller of two discordant counts; terms are summed as logarithms, so any n fits."""
    first = F.struct((-n.cast("double") * 0.6931471805599453).alias("term"), F.exp(-n.cast("double") * 0.6931471805599453).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(small >= 1, F.sequence(F.lit(1), small.cast("int"))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, first, step, lambda acc: acc["sum"])
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar_chi2(b01: Column, b10: Column, correct: bool = True) -> tuple[Column, Column]:
    """Statistic and p of the chi-square form."""
    diff = F.abs(b01 - b10)
    diff = F.greatest(diff - 1, F.lit(0)) if correct else diff
    chi2 = F.try_divide((diff * diff).cast("double"), (b01 + b10).cast("double"))
    return chi2, 1 - erf(F.sqrt(chi2 / 2))


def draw(*parts: Column, below: Column) -> Column:
    """A whole number from 0 on, under ``below``, from the MD5 of the parts joined by '-'."""
    digest = F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % below


#: Modulus of the hash of replicates, 2**31 - 1: the square of a number below it fits a signed 64-bit integer.
MODULUS = 2_147_483_647
#: What a replicate adds to the start of the hash, and how often it squares.
STRIDE, SQUARINGS = 69_621, 3


def replicate_key(*parts: Column) -> Column:
    """Two numbers below ``MODULUS`` from the MD5 of the parts, made once a row for all its replicates."""
    digest = F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]).cast("binary"))
    number = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % MODULUS
    return F.struct(number(1).alias("a"), number(9).alias("b"))


def replicate_draw(key: Column, replicate: Column) -> Column:
    """A number from 0 to ``MODULUS`` - 1 for a key in a replicate. Squares of whole numbers alone, so a draw makes no
    string and any engine can repeat it."""
    x = (key["a"] + replicate.cast("long") * STRIDE) % MODULUS
    for _ in range(SQUARINGS):
        x = (x * x + key["b"]) % MODULUS
    return x


def poisson_steps() -> list[int]:
    """The least draws at which a Poisson count of mean 1 is over 0, over 1, and so on."""
    steps, total, term, k = [], 0.0, math.exp(-1), 0
    while term * MODULUS >= 1:
        total += term
        steps.append(round(total * MODULUS))
        k += 1
        term /= k
    return steps


def poisson_weight(x: Column) -> Column:
    """How often a replicate takes a unit, from its draw."""
    return sum(((x >= step).cast("int") for step in poisson_steps()), F.lit(0))


def order_key(*parts: Column) -> Column:
    """A random order that every engine can repeat."""
    return F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]).cast("binary"))


def average_rank(value: Column, by: list[Column]) -> Column:
    """Ranks from 1; equal values share the mean of theirs."""
    from pyspark.sql import Window

    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null where a side is constant or there are under two rows."""
    return F.when(F.count(F.lit(1)) >= 2, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
