"""Distances between signatures and between fitted distributions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features
from ..functions.fits import LEVELS, SUFFIXES
from ..functions.uniform import uniform

SAMPLE, RANKS = 4000, 10


def relative_errors(target: DataFrame, achieved: DataFrame) -> DataFrame:
    """``(feature, target, achieved, relative_error)``; features that either side lacks or could not fit have none."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    x = target.select("feature", clean("value").alias("target")).join(achieved.select("feature", clean("value").alias("achieved")), "feature", "full_outer")
    return x.withColumn("relative_error", F.abs(F.col("target") - F.col("achieved")) / F.greatest(F.abs("target"), F.lit(1e-9)))


def summary(errors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, median and largest of the errors that exist."""
    e = F.col("relative_error")
    return errors.groupBy(*(by or [])).agg(F.count(e).alias("n"), F.avg(e).alias("mean_error"), F.percentile(e, 0.5).alias("median_error"), F.max(e).alias("max_error"))


def _interpolate(u: F.Column, q: list[F.Column]) -> F.Column:
    out = q[-1]
    for i in range(len(LEVELS) - 2, -1, -1):
        a, b = LEVELS[i], LEVELS[i + 1]
        out = F.when(u <= b, q[i] + (u - a) / (b - a) * (q[i + 1] - q[i])).otherwise(out)
    return out


def inverse_power(u: F.Column, alpha: F.Column, lo: F.Column, hi: F.Column) -> F.Column:
    """Inverse distribution function of the power law on [lo, hi]; log-uniform at exponent 1, the lower end where the range is empty."""
    c = 1 - alpha
    body = F.pow(F.pow(lo, c) + u * (F.pow(hi, c) - F.pow(lo, c)), 1 / c)
    return F.when(hi <= lo, lo).when(F.abs(c) < 1e-6, lo * F.pow(hi / lo, u)).otherwise(body)


def sample_fit(fits: DataFrame, kind: str, n: int = SAMPLE, seed: int = 0) -> DataFrame:
    """``fits`` rows (one per ``name``) as samples ``(name, i, x)`` at uniforms that all fits share.

    Kinds: ``quantile`` (columns q00 to q100), ``powerlaw`` (alpha, lo; unbounded,
    capped at its own 99.9th percentile), ``trunc_powerlaw`` (alpha, lo, hi) and
    ``exp_decay`` (rate, scale; the first ten ranks).  A fit that is not there
    gives no rows.
    """
    spark = fits.sparkSession
    u = spark.range(n if kind != "exp_decay" else RANKS).select(F.col("id").alias("i")).withColumn("u", uniform(seed, "i"))
    need = {"quantile": SUFFIXES, "powerlaw": ("alpha", "lo"), "trunc_powerlaw": ("alpha", "lo", "hi"), "exp_decay": ("rate", "scale")}
    if kind not in need:
        raise ValueError(f"unknown kind of fit: {kind}")
    for c in need[kind]:
        fits = fits.filter(F.col(c).isNotNull() & ~F.isnan(c))
    if kind == "powerlaw":
        fits = fits.filter("alpha > 1 and lo > 0")
    elif kind == "trunc_powerlaw":
        fits = fits.filter("lo > 0")
    x = u.crossJoin(F.broadcast(fits))  # a handful of fits
    if kind == "quantile":
        value = _interpolate(F.col("u"), [F.col(s) for s in SUFFIXES])
    elif kind == "trunc_powerlaw":
        value = inverse_power(F.col("u"), F.col("alpha"), F.col("lo").cast("double"), F.col("hi").cast("double"))
    elif kind == "powerlaw":
        value = F.col("lo") * F.pow(1 - F.col("u"), -1 / (F.col("alpha") - 1))
    else:
        value = F.col("scale") * F.exp(-F.col("rate") * F.col("i"))
    x = x.select("name", "i", value.alias("x"))
    if kind == "powerlaw":
        cap = x.groupBy("name").agg(F.percentile("x", 0.999).alias("cap"))
        x = x.join(F.broadcast(cap), "name").select("name", "i", F.least("x", "cap").alias("x"))
    return x


def wasserstein(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(name, w1)`` between samples of equal size: the mean difference of order statistics."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy("x"))
    x = a.select("name", F.col("x").alias("xa"), rank.alias("r")).join(b.select("name", F.col("x").alias("xb"), rank.alias("r")), ["name", "r"])
    return x.groupBy("name").agg(F.avg(F.abs(F.col("xa") - F.col("xb"))).alias("w1"))


def spread(sample: DataFrame) -> DataFrame:
    """``(name, iqr)``."""
    return sample.groupBy("name").agg((F.percentile("x", 0.75) - F.percentile("x", 0.25)).alias("iqr"))


def normalised_wasserstein(target: DataFrame, achieved: DataFrame, kind: str, seed: int = 0) -> DataFrame:
    """``(name, w1, iqr, w1_iqr)`` of fits by name; the scale is the target's spread."""
    a, b = sample_fit(target, kind, seed=seed), sample_fit(achieved, kind, seed=seed)
    return wasserstein(a, b).join(spread(a), "name").withColumn("w1_iqr", F.when(F.col("iqr") > 0, F.col("w1") / F.col("iqr")))


def error_split(errors: DataFrame, covered: DataFrame, distances: DataFrame) -> DataFrame:
    """``(block, name, kind, error)``: distances of distributions, and the errors of the features that no distribution covers."""
    scalar = errors.join(covered.select("feature"), "feature", "left_anti").select("block", F.col("feature").alias("name"), F.lit("scalar").alias("kind"), F.col("relative_error").alias("error"))
    return distances.select("block", "name", F.lit("w1_iqr").alias("kind"), F.col("w1_iqr").alias("error")).union(scalar)


def distributions(values: dict[str, float]) -> list[tuple[str, str, str, dict[str, float], list[str]]]:
    """``(block, name, kind, fit, features)`` of the distributions that a signature describes; fits with something unmeasured are left out."""
    out = []
    for first, names in features.QUANTILES.items():
        out.append((features.BLOCK_OF[first], first[: -len("_q00")], "quantile", dict(zip(SUFFIXES, names, strict=True))))
    for side in ("subj", "obj"):
        names = [f"{side}_row_entropy_{s}" for s in SUFFIXES]
        out.append(("c", f"{side}_row_entropy", "quantile", dict(zip(SUFFIXES, names, strict=True))))
    for block, name, lo, hi in (("b", "out_degree", "out_degree_xmin", "out_degree_max"), ("b", "in_degree", "in_degree_xmin", "in_degree_max"), ("c", "class_size", "class_size_xmin", "class_size_max"), *(("d", x, f"{x}_vmin", f"{x}_vmax") for x in ("cs_freq", "inv_cs_freq", "two_step"))):
        out.append((block, name, "trunc_powerlaw", {"alpha": f"{name}_alpha", "lo": lo, "hi": hi}))
    for name in ("subj_cooc", "obj_cooc", "type_rel_spectrum", "per_type_entropy"):
        out.append(("c", name, "exp_decay", {"rate": f"{name}_rate", "scale": f"{name}_scale"}))
    return [(b, n, k, {p: values[f] for p, f in fit.items()}, list(fit.values())) for b, n, k, fit in out if not any(math.isnan(values.get(f, math.nan)) for f in fit.values())]


def curves(spark: SparkSession, values: dict[str, float], points: int = 50) -> DataFrame:
    """``(block, name, kind, x, y)``: what to draw for each distribution that a signature describes: values by level, values by rank, or the share above each value."""
    rows = []
    for block, name, kind, fit, _ in distributions(values):
        if kind == "quantile":
            line = list(zip(LEVELS, fit.values(), strict=True))
        elif kind == "exp_decay":
            line = [(float(k), fit["scale"] * math.exp(-fit["rate"] * k)) for k in range(RANKS)]
        else:
            lo, hi, c = max(fit["lo"], 1e-9), max(fit["hi"], fit["lo"]), 1 - fit["alpha"]
            at = [lo * (hi / lo) ** (k / (points - 1)) for k in range(points)] if hi > lo else [lo]
            above = lambda x: (math.log(hi / x) / math.log(hi / lo) if abs(c) < 1e-6 else (hi**c - x**c) / (hi**c - lo**c)) if hi > lo else 1.0  # noqa: E731, B023
            line = [(x, above(x)) for x in at]
        rows += [(block, name, kind, float(x), float(y)) for x, y in line]
    return spark.createDataFrame(rows, "block string, name string, kind string, x double, y double")


def report(spark: SparkSession, target: dict[str, float], achieved: dict[str, float], seed: int = 0) -> DataFrame:
    """``(block, name, kind, error)``: distances of the distributions that both signatures describe, over the target's spread, and relative errors of the features that none of them covers."""
    a, b = ({(blk, n, k): (fit, names) for blk, n, k, fit, names in distributions(v)} for v in (target, achieved))
    both = sorted(set(a) & set(b))
    found, covered = None, []
    for kind in sorted({k for _, _, k in both}):
        mine = [x for x in both if x[2] == kind]
        params = list(a[mine[0]][0])
        sides = [spark.createDataFrame([(n, *(float(side[blk, n, kind][0][p]) for p in params)) for blk, n, _ in mine], "name string, " + ", ".join(f"`{p}` double" for p in params)) for side in (a, b)]
        d = normalised_wasserstein(*sides, kind, seed)
        blocks = spark.createDataFrame([(n, blk) for blk, n, _ in mine], "name string, block string")
        d = d.join(F.broadcast(blocks), "name").select("block", "name", "w1_iqr")
        found = d if found is None else found.union(d)
        covered += [f for x in mine for f in a[x][1]]
    rows = [(features.BLOCK_OF[f], f, None if math.isnan(t := target.get(f, math.nan)) else float(t), None if math.isnan(x := achieved.get(f, math.nan)) else float(x)) for f in features.ORDER]
    e = spark.createDataFrame(rows, "block string, feature string, target double, achieved double").withColumn("relative_error", F.abs(F.col("target") - F.col("achieved")) / F.greatest(F.abs("target"), F.lit(1e-9)))
    found = found if found is not None else spark.createDataFrame([], "block string, name string, w1_iqr double")
    return error_split(e, spark.createDataFrame([(f,) for f in covered], "feature string"), found)


def error_pool(errors: DataFrame) -> DataFrame:
    """The five numbers of each block's box plot."""
    e = F.col("relative_error")
    return errors.filter(e.isNotNull()).groupBy("block").agg(*(F.percentile(e, q).alias(n) for n, q in (("low", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1.0))), F.count(F.lit(1)).alias("n"))
