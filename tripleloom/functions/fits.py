"""Distribution fits as column expressions and small numeric kernels.

A fit that has too little to go on is null inside plans and NaN in a feature
vector.  Quantiles are interpolated linearly.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SAMPLES, MIN_RANKS = 10, 3
#: Levels of a quantile function, and the names of its entries (fixed values).
LEVELS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
SUFFIXES = ("q00", "q10", "q25", "q50", "q75", "q90", "q100")
#: Ends to which per-relation exponents' quantile functions are pinned, and the bounds of the exponent (fixed values).
ALPHA_ENDS = (1.4, 3.0)
ALPHA_BOUNDS = (1.0, 3.0)


def finite(c: F.Column) -> F.Column:
    """Null for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def quantiles(value: F.Column, min_samples: int = MIN_SAMPLES, ends: tuple[float, float] | None = None) -> list[F.Column]:
    """Aggregates: the sample's quantile function at :data:`LEVELS`, never falling, ends pinned if given."""
    x = finite(value.cast("double"))
    q = F.percentile(x, F.array(*map(F.lit, LEVELS)))
    if ends:
        inner = F.slice(q, 2, len(LEVELS) - 2)
        q = F.concat(F.array(F.lit(ends[0])), inner, F.array(F.lit(ends[1])))
    rising = lambda i: F.array_max(F.slice(q, 1, i + 1))
    return [F.when(F.count(x) >= min_samples, rising(i)).alias(s) for i, s in enumerate(SUFFIXES)]


def rank_decay(df: DataFrame, value: str) -> DataFrame:
    """``(rate, scale)`` of value = scale * exp(-rate * rank), largest first, over the positive values.

    The ranks come from a sort by range, so the list may be of any length.
    """
    from ..operators.ranks import numbered

    x = df.select(finite(F.col(value).cast("double")).alias("x")).filter("x > 0")
    x = numbered(x, [F.desc("x")]).select(F.log("x").alias("y"), (F.col("rank") - 1).cast("double").alias("k"))
    ok = F.count(F.lit(1)) >= MIN_RANKS
    return x.agg(F.when(ok, -F.regr_slope("y", "k")).alias("rate"), F.when(ok, F.exp(F.regr_intercept("y", "k"))).alias("scale"))


def log_slope(size: F.Column, mult: F.Column) -> F.Column:
    """Aggregate: slope of ln(mult) on ln(size); null below ten pairs or without spread."""
    ok = (F.count(F.lit(1)) >= MIN_SAMPLES) & (F.min(size) < F.max(size))
    return F.when(ok, F.regr_slope(F.log(mult.cast("double")), F.log(size.cast("double"))))


def entropy(p: F.Column) -> F.Column:
    """Aggregate: Shannon entropy of probabilities, natural logarithm."""
    return -F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))


def zipf_mle(count: F.Column) -> F.Column:
    """Aggregate: continuous maximum-likelihood exponent of positive counts above their smallest, within [1.01, 50]."""
    x = F.when(count >= 1, count.cast("double"))
    total = F.sum(F.log(x)) - F.count(x) * F.log(F.min(x))
    return F.when((F.count(x) >= 2) & (total > 0), F.greatest(F.lit(1.01), F.least(F.lit(50.0), 1 + F.count(x) / total)))


def power_sums(alpha: float, lo: int, hi: int) -> tuple[float, float]:
    """Sum of k**-alpha, and of ln(k) k**-alpha, for lo <= k <= hi (Euler-Maclaurin beyond 100,000 terms)."""
    top = min(hi, lo + 100_000)
    k = np.arange(lo, top + 1, dtype=float)
    w = k**-alpha
    s, t = float(w.sum()), float((w * np.log(k)).sum())
    if hi > top:
        a, b = float(top), float(hi)
        f = lambda x: x**-alpha
        g = lambda x: math.log(x) * x**-alpha
        df = lambda x: -alpha * x ** (-alpha - 1)
        dg = lambda x: x ** (-alpha - 1) * (1 - alpha * math.log(x))
        c = 1 - alpha
        if abs(c) < 1e-4:  # the closed form cancels: four terms of exp(c t) over t = ln x
            u, v = math.log(a), math.log(b)
            power = lambda m: (v**m - u**m) / m
            i = sum(c**m / math.factorial(m) * power(m + 1) for m in range(4))
            j = sum(c**m / math.factorial(m) * power(m + 2) for m in range(4))
        else:
            i = (b**c - a**c) / c
            j = (b**c * (math.log(b) / c - 1 / c**2)) - (a**c * (math.log(a) / c - 1 / c**2))
        s += i + (f(b) - f(a)) / 2 + (df(b) - df(a)) / 12
        t += j + (g(b) - g(a)) / 2 + (dg(b) - dg(a)) / 12
    return s, t


def power_alpha(n: int, sum_log: float, lo: int, hi: int, bounds: tuple[float, float] = ALPHA_BOUNDS) -> float:
    """Exponent of the discrete power law on [lo, hi] that makes n values with this sum of logarithms most likely.

    The likelihood is concave in the exponent, so its derivative is bisected.
    """
    if n < MIN_SAMPLES or lo >= hi:
        return math.nan
    mean = sum_log / n

    def slope(a: float) -> float:
        s, t = power_sums(a, lo, hi)
        return t / s - mean

    a, b = bounds[0] + 1e-9, bounds[1] - 1e-15
    if slope(a) <= 0:
        return a
    if slope(b) >= 0:
        return b
    for _ in range(60):
        m = (a + b) / 2
        a, b = (m, b) if slope(m) > 0 else (a, m)
    return (a + b) / 2


def power_fit(df: DataFrame, value: str, by: list[str], pin_low: bool = True) -> DataFrame:
    """``(*by, n, lo, hi, alpha)``: a fit per group from its sufficient statistics.

    The statistics are one aggregate; only one row per group reaches Python, in
    Arrow batches.  With ``pin_low`` the support starts at 1, else at the smallest value.
    """
    from ..plans.session import ship

    ship(df.sparkSession)
    x = df.filter(F.col(value) > 0)
    one = F.lit(1).cast("long")
    stats = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.log(F.col(value).cast("double"))).alias("sum_log"),
        (one if pin_low else F.min(value).cast("long")).alias("lo"), F.max(value).cast("long").alias("hi"),
    )

    @F.pandas_udf("double")
    def alpha(n, sum_log, lo, hi):
        import pandas as pd

        return pd.Series([power_alpha(*r) for r in zip(n, sum_log, lo, hi, strict=True)], dtype=float)

    return stats.withColumn("alpha", alpha("n", "sum_log", "lo", "hi"))


def power_distance(df: DataFrame, value: str, by: list[str], pin_low: bool = True) -> DataFrame:
    """``(*by, alpha, distance)``: the Kolmogorov-Smirnov distance of each group's values to its fitted power law.

    Both distribution functions are compared at each value that occurs and just
    before it; between these the law alone rises.
    """
    from ..operators.ranks import numbered

    fit = power_fit(df, value, by, pin_low)
    seen = df.filter(F.col(value) > 0).groupBy(*by, F.col(value).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    seen = numbered(seen, ["k"], by, F.col("m")).join(fit, by).filter(~F.isnan("alpha"))

    @F.pandas_udf("double")
    def law(k, alpha, lo, hi):
        import pandas as pd

        return pd.Series([power_sums(a, x, int(y))[0] / power_sums(a, x, h)[0] if y >= x else 0.0 for y, a, x, h in zip(k, alpha, lo, hi, strict=True)], dtype=float)

    at, ahead = law("k", "alpha", "lo", "hi"), law(F.col("k") - 1, "alpha", "lo", "hi")
    d = F.greatest(F.abs((F.col("before") + F.col("m")) / F.col("n") - at), F.abs(F.col("before") / F.col("n") - ahead))
    return seen.groupBy(*by).agg(F.first("alpha").alias("alpha"), F.max(d).alias("distance"))
