"""Stage one: what a graph with a given signature is made of.

The schema is small (relations, classes, parameters), so it lives on the driver.
Everything per entity is an expression over a range, drawn from hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fits import LEVELS, SUFFIXES
from ..functions.uniform import uniform
from ..operators.compare import inverse_power
from ..operators.ranks import numbered

#: Without these there is no graph to make.
REQUIRED = (
    ["num_entities", "mean_degree", "num_relations", "num_distinct_cs", "inv_num_distinct_cs", "num_components", "largest_component_fraction"]
    + [f"{p}_{s}" for p in ("cs_size", "inv_cs_size") for s in SUFFIXES]
    + [f"{side}_degree_{x}" for side in ("out", "in") for x in ("alpha", "p90", "max")]
)
ZIPF, TAIL = 1.0, 0.1
#: Features that this stage reads, and what is to be said about changing them.
READS = {
    "num_entities": "changes the size, and what grows with it does not follow", "mean_degree": "", "num_relations": "", "num_classes": "", "type_edge_frac": "",
    **{f"rel_freq_logq_{s}": "" for s in SUFFIXES}, **{f"recip_symmetric_frac_bin{i}": "" for i in range(6)}, "recip_symmetric_value": "",
    "type_rel_spectrum_rate": "", "type_rel_spectrum_scale": "a common factor of the spectrum has no effect",
}


def check_target(values: dict[str, float]) -> None:
    for f in REQUIRED:
        if f not in values or math.isnan(values[f]):
            raise ValueError(f"the signature lacks {f}")


def zipf_weights(n: int, exponent: float = ZIPF) -> np.ndarray:
    w = np.arange(1, n + 1, dtype=float) ** -exponent
    return w / w.sum() if n else w


def relation_weights(n: int, logq: list[float], seed: int = 0) -> np.ndarray:
    """Shares of n relations: the quantile function of logarithmic shares at n even levels, in an order drawn by hash."""
    if not n:
        return np.empty(0)
    w = zipf_weights(n) if any(math.isnan(q) for q in logq) else np.exp(np.interp(np.linspace(0, 1, n), LEVELS, logq))
    return np.random.default_rng(seed).permutation(w / w.sum())


def decay_curve(rate: float, scale: float, k: int = 10) -> np.ndarray:
    return np.zeros(0) if math.isnan(rate) or math.isnan(scale) else scale * np.exp(-rate * np.arange(k))


def class_relations(classes: int, weights: np.ndarray, spectrum: np.ndarray, seed: int = 0) -> np.ndarray:
    """Row-stochastic classes x relations: random factors with the spectrum's shape tilt the global weights."""
    r = len(weights)
    s = spectrum[spectrum > 0][: min(classes, r)]
    if not classes or not r:
        return np.zeros((classes, r))
    if not len(s):
        return np.tile(weights, (classes, 1))
    rng = np.random.default_rng(seed)
    left, right = (np.linalg.qr(rng.standard_normal((n, len(s))))[0] for n in (classes, r))
    tilt = (left * (s / s.sum())) @ right.T
    p = np.exp(tilt - tilt.max(1, keepdims=True)) * weights
    return p / p.sum(1, keepdims=True)


def reciprocities(weights: np.ndarray, fractions: list[float], value: float, seed: int = 0) -> np.ndarray:
    """Reciprocity of each relation: symmetric with the chance of its bin by cumulative weight; empty bins take the nearest one's."""
    known = [i for i, f in enumerate(fractions) if not math.isnan(f)]
    out = np.zeros(len(weights))
    if not known or math.isnan(value) or not len(weights):
        return out
    order = np.argsort(-weights, kind="stable")
    bins = np.clip(np.searchsorted(LEVELS[1:], np.cumsum(weights[order]) / weights.sum()), 0, len(fractions) - 1)
    chance = np.array([fractions[min(known, key=lambda k: (abs(k - b), k))] for b in bins])
    out[order] = np.where(np.random.default_rng(seed).random(len(weights)) < chance, value, 0.0)
    return out


@dataclass
class Schema:
    """What stage two needs."""

    values: dict[str, float]
    entities: int
    edges: int
    type_edges: int
    relations: list[str]
    weights: np.ndarray
    class_probs: np.ndarray
    reciprocity: np.ndarray
    seed: int
    notes: dict = field(default_factory=dict)


def sample_schema(values: dict[str, float], seed: int = 0) -> Schema:
    """Draw the schema; ValueError names the first required feature that is missing."""
    check_target(values)
    get = lambda f, d=math.nan: d if math.isnan(values.get(f, math.nan)) else values[f]
    v, r, t = int(values["num_entities"]), int(values["num_relations"]), int(get("num_classes", 0))
    v = max(1, v - t)  # classes are vertices of their own
    edges = round(values["num_entities"] * values["mean_degree"])
    typed = min(v, round(edges * get("type_edge_frac", 0.0))) if t else 0
    r = max(1, r - (1 if typed else 0))
    w = relation_weights(r, [values.get(f"rel_freq_logq_{s}", math.nan) for s in SUFFIXES], seed)
    probs = class_relations(t, w, decay_curve(get("type_rel_spectrum_rate"), get("type_rel_spectrum_scale")), seed + 1)
    rec = reciprocities(w, [values.get(f"recip_symmetric_frac_bin{i}", math.nan) for i in range(6)], get("recip_symmetric_value"), seed + 2)
    return Schema(dict(values), v, edges, typed, [f"relation/{i}" for i in range(r)], w, probs, rec, seed)


# Sampling expressions


def quantile_sample(u: F.Column, q: list[float]) -> F.Column:
    """Inverse of a quantile function at uniforms."""
    out = F.lit(float(q[-1]))
    for i in range(len(LEVELS) - 2, -1, -1):
        a, b = LEVELS[i], LEVELS[i + 1]
        out = F.when(u <= b, F.lit(float(q[i])) + (u - a) / (b - a) * float(q[i + 1] - q[i])).otherwise(out)
    return out


def power_sample(u: F.Column, alpha: float, lo: float, hi: float) -> F.Column:
    """Bounded power-law draws; a law that is flat, unknown or has an empty range gives the lower end."""
    lo = lo if math.isfinite(lo) and lo > 1 else 1.0
    if math.isnan(alpha) or alpha <= 1 or not math.isfinite(hi) or hi <= lo:
        return F.lit(float(lo))
    return inverse_power(u, F.lit(float(alpha)), F.lit(float(lo)), F.lit(float(hi)))


def largest_remainder(df: DataFrame, weight: str, total: F.Column | int, by: list[str], key: str) -> DataFrame:
    """``df`` with ``quota``: whole numbers in proportion to the weight that sum to ``total`` in each group.

    Floors first, then one more for the largest fractional parts, ties by key.
    Sums are aggregates and places come from :func:`numbered`, so a group of any size is spread.
    """
    total = F.lit(total) if isinstance(total, int) else total
    x = df.join(df.groupBy(*by).agg(F.sum(weight).alias("_w")), by)
    x = x.withColumn("_s", F.col(weight) / F.col("_w") * total).withColumn("_f", F.floor(F.round("_s", 9))).withColumn("_d", F.round(F.col("_s") - F.col("_f"), 9))
    x = numbered(x, [F.desc("_d"), key], by)
    x = x.join(x.groupBy(*by).agg(F.sum("_f").alias("_g")), by)
    return x.withColumn("quota", (F.col("_f") + (F.col("rank") <= total - F.col("_g")).cast("int")).cast("long")).drop("_w", "_s", "_f", "_d", "_g", "rank")


def degree_sequence(spark: SparkSession, n: int, alpha: float, p90: float, top: float, mean: float, active: float = 1.0, seed: int = 0, tag: str = "out", partitions: int | None = None) -> DataFrame:
    """``(i, d)`` for n entities: some without edges, a body up to the 90th percentile, a tail up to the largest; the sum is exact.

    The body is a bounded power law on [1, p90], the tail on [p90, top] with the
    largest set apart.  The rest that the sum lacks, or has too much, is spread
    over the body in proportion to what each entry can give or take.
    """
    alpha = 2.5 if math.isnan(alpha) else alpha
    p90, top = max(1.0, p90), max(1.0, top, p90)
    u = uniform(seed, F.lit(tag), F.col("i"), F.lit("kind"))
    x = spark.range(n).select(F.col("id").alias("i"))
    x = x.withColumn("u", u).withColumn("w", uniform(seed, F.lit(tag), F.col("i"), F.lit("size")))
    tail = F.col("u") < TAIL
    on = F.col("u") < max(0.0, min(1.0, active))
    d = F.when(~on, 0.0).when(tail, power_sample(F.col("w"), max(alpha, 1.0 + 1e-3), p90, top)).otherwise(power_sample(F.col("w"), max(alpha, 1.0 + 1e-3), 1.0, p90))
    x = x.select("i", F.round(d).cast("long").alias("d"), (on & ~tail).alias("body"), on.alias("on"))
    first = x.filter("on").orderBy(F.desc("d"), "i").limit(1).select(F.col("i").alias("first"))
    x = x.join(F.broadcast(first), F.lit(True), "left").withColumn("d", F.when(F.col("i") == F.col("first"), F.lit(int(top))).otherwise(F.col("d"))).withColumn("body", F.col("body") & ~F.coalesce(F.col("i") == F.col("first"), F.lit(False)))
    return repair_sum(x.select("i", "d", "body"), round(n * mean), seed, tag)


def repair_sum(x: DataFrame, total: int, seed: int = 0, tag: str = "") -> DataFrame:
    """Bring ``d`` to the total by changing only rows with ``body``; each keeps at least 1."""
    s = x.agg(F.sum("d"), F.sum(F.col("body").cast("long")), F.sum(F.when(F.col("body"), F.greatest(F.col("d") - 1, F.lit(0))))).first()
    have, n, room = (s[0] or 0), (s[1] or 0), (s[2] or 0)
    miss = total - have
    if not miss or not n:
        return x.select("i", "d")
    weight = F.lit(1.0) if miss > 0 else F.greatest(F.col("d") - 1, F.lit(0)).cast("double")
    amount = min(abs(miss), room) if miss < 0 else miss
    scale = n if miss > 0 else max(1, room)
    # each row's exact share, and its fraction rounded by a threshold that makes the sum exact
    x = x.withColumn("share", F.when(F.col("body"), weight * float(amount) / float(scale)).otherwise(0.0)).withColumn("base", F.floor("share"))
    rest = amount - (x.agg(F.sum("base")).first()[0] or 0)
    able = F.col("body") & ((F.col("d") - 1 > F.col("base")) if miss < 0 else F.lit(True))
    pick = x.filter(able).orderBy(F.desc(F.col("share") - F.col("base")), uniform(seed, F.lit(tag), F.col("i"), F.lit("fix")), "i").limit(int(rest)).select("i", F.lit(1).alias("more"))
    x = x.join(pick, "i", "left").withColumn("step", F.col("base") + F.coalesce("more", F.lit(0)))
    return x.select("i", (F.col("d") + (1 if miss > 0 else -1) * F.col("step")).cast("long").alias("d"))
