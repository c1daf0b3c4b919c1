"""Perturbing feature vectors, and drawing new ones from a population.

Feature tables are long: ``(graph, feature, value)``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features
from ..functions.uniform import normal, uniform

SATURATED = 0.5
WIDEN, SUPPORT = 0.1, 2


@dataclass(frozen=True)
class Spec:
    """How a feature moves: by a factor (lognormal, loguniform) or an offset (normal, uniform); ``levels`` for one-at-a-time designs."""

    dist: str = "lognormal"
    sigma: float = 0.1
    lo: float | None = None
    hi: float | None = None
    levels: tuple[float, ...] = ()
    clamp: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        if self.dist not in ("lognormal", "normal", "uniform", "loguniform"):
            raise ValueError(f"unknown distribution: {self.dist}")
        if "uniform" in self.dist and (self.lo is None or self.hi is None):
            raise ValueError(f"{self.dist} needs lo and hi")
        if "normal" in self.dist and self.sigma <= 0:
            raise ValueError(f"{self.dist} needs sigma above 0")

    @property
    def multiplicative(self) -> bool:
        return self.dist.startswith("log")


_SPEC = "name string, dist string, sigma double, lo double, hi double, multiplicative boolean, clo double, chi double"


def spec_table(spark: SparkSession, specs: dict[str, Spec]) -> DataFrame:
    rows = [(n, s.dist, s.sigma, s.lo, s.hi, s.multiplicative, *(s.clamp or (None, None))) for n, s in specs.items()]
    return spark.createDataFrame(rows, _SPEC)


def knobs(specs: dict[str, Spec]) -> list[str]:
    """The first-named member of each group that moves together."""
    out: dict[str, str] = {}
    for n in specs:
        out.setdefault(features.group_of(n)[0], n)
    return list(out.values())


def moves(spark: SparkSession, specs: dict[str, Spec]) -> DataFrame:
    """``(feature, name, ...)``: each spec on every member of its group."""
    grp = spark.createDataFrame([(n, f) for n in knobs(specs) for f in features.group_of(n)], "name string, feature string")
    return grp.join(F.broadcast(spec_table(spark, specs)), "name")


def move(table: DataFrame, amounts: DataFrame) -> DataFrame:
    """Apply ``amounts(graph, feature, amount, multiplicative, clo, chi)`` to a feature table.

    A group takes one amount, so a quantile function stays in order; clamping may
    flatten it but not turn it round.  Returns ``(graph, feature, value, raw,
    clamped, moved)``; values that are null or NaN do not move.
    """
    spark = table.sparkSession
    cat = F.broadcast(features.catalogue(spark).select("feature", F.col("lo").alias("dlo"), F.col("hi").alias("dhi"), "integer", "grp", "quantile"))
    x = table.join(cat, "feature").join(amounts, ["graph", "feature"], "left")
    v = F.when(~F.isnan("value"), F.col("value"))
    raw = F.when(F.col("multiplicative"), v * F.col("amount")).otherwise(v + F.col("amount"))
    custom = F.col("clo").isNotNull()
    lo, hi = F.coalesce("clo", "dlo"), F.coalesce("chi", "dhi")
    held = F.greatest(lo, F.least(hi, F.col("raw")))
    held = F.when(F.col("integer") & ~custom, F.bround(held, 0)).otherwise(held)
    x = x.withColumn("raw", raw).withColumn("moved", F.col("amount").isNotNull() & F.col("raw").isNotNull())
    x = x.withColumn("clamped", F.coalesce(F.col("moved") & ((F.col("raw") < lo) | (F.col("raw") > hi)), F.lit(False)))
    x = x.withColumn("new", F.when(F.col("moved"), held).otherwise(F.col("value")))
    # quantile groups are put in order; where nothing is out of order this changes nothing
    w = Window.partitionBy("graph", "grp", F.isnan("new") | F.col("new").isNull())
    place = F.row_number().over(w.orderBy("feature_at"))
    x = x.join(F.broadcast(features.catalogue(spark).select("feature", F.col("i").alias("feature_at"))), "feature")
    ordered = F.element_at(F.array_sort(F.collect_list("new").over(w)), place)
    value = F.when(F.col("quantile") & F.col("new").isNotNull() & ~F.isnan("new"), ordered).otherwise(F.col("new"))
    return x.select("graph", "feature", value.alias("value"), "raw", "clamped", "moved", "grp")


def perturb(table: DataFrame, specs: dict[str, Spec], copies: int = 1, seed: int = 0) -> DataFrame:
    """Move all features of ``specs`` at once, ``copies`` times: ``(graph, copy, feature, value, raw, clamped, moved, grp)``."""
    spark = table.sparkSession
    many = table.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("graph", F.concat_ws("#", "graph", "copy"))
    u, z = uniform(seed, "graph", "name"), normal(seed, "graph", "name")
    amount = (
        F.when(F.col("dist") == "lognormal", F.exp(z * F.col("sigma"))).when(F.col("dist") == "normal", z * F.col("sigma"))
        .when(F.col("dist") == "loguniform", F.exp(F.log("lo") + u * (F.log("hi") - F.log("lo")))).otherwise(F.col("lo") + u * (F.col("hi") - F.col("lo")))
    )
    graphs = many.select("graph").distinct()
    amounts = graphs.join(F.broadcast(moves(spark, specs)), F.lit(True)).select("graph", "feature", amount.alias("amount"), "multiplicative", "clo", "chi")
    x = move(many.select("graph", "feature", "value"), amounts)
    return x.withColumn("copy", F.substring_index("graph", "#", -1).cast("int")).withColumn("graph", F.regexp_replace("graph", "#[0-9]+$", ""))


def ofat_plan(spark: SparkSession, specs: dict[str, Spec]) -> DataFrame:
    """``(unit, name, level, label)``: the baseline, then each knob at each of its levels."""
    rows = [(0, None, None, "baseline")]
    for n in knobs(specs):
        for level in specs[n].levels:
            rows.append((len(rows), n, float(level), f"{n}{'*' if specs[n].multiplicative else '+'}{level:g}"))
    return spark.createDataFrame(rows, "unit int, name string, level double, label string")


def perturb_levels(table: DataFrame, specs: dict[str, Spec]) -> DataFrame:
    """Move one knob at a time: ``(graph, unit, label, feature, value, raw, clamped, moved, grp)`` for every unit of the plan."""
    spark = table.sparkSession
    plan = ofat_plan(spark, specs)
    units = table.join(F.broadcast(plan.select("unit", "label")), F.lit(True)).select(F.concat_ws("#", "graph", "unit").alias("graph"), "feature", "value")
    steps = plan.join(moves(spark, specs), "name").select(F.col("unit"), "feature", F.col("level").alias("amount"), "multiplicative", "clo", "chi")
    amounts = table.select("graph").distinct().join(F.broadcast(steps), F.lit(True)).select(F.concat_ws("#", "graph", "unit").alias("graph"), "feature", "amount", "multiplicative", "clo", "chi")
    x = move(units, amounts).withColumn("unit", F.substring_index("graph", "#", -1).cast("int")).withColumn("graph", F.regexp_replace("graph", "#[0-9]+$", ""))
    return x.join(F.broadcast(plan.select("unit", "label")), "unit")


def clamp_report(moved: DataFrame, by: list[str]) -> DataFrame:
    """Per group that moved: members, the share that its bounds absorbed, and whether that is most of it."""
    share = F.avg(F.col("clamped").cast("double"))
    return moved.filter("moved").groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("members"), share.alias("absorbed"), (share > SATURATED).alias("saturated"))


def realisable(table: DataFrame) -> DataFrame:
    """``(graph, reason)`` for vectors that no graph can have; graphs without a row are fine."""
    w = table.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("graph").pivot("feature", features.ORDER).agg(F.first("value"))
    c = F.col
    tests = [
        (~(c("num_entities") >= 1) | c("num_entities").isNull(), "num_entities"),
        (F.round(c("num_entities") * c("mean_degree")) < 1, "mean_degree"),
        *((c(f) > c("num_entities"), f) for f in ("num_distinct_cs", "inv_num_distinct_cs", "num_components")),
        *((c(f) < 1, f) for f in ("obj_mult_max", "subj_mult_max")),
        ((c("largest_component_fraction") <= 0) | (c("largest_component_fraction") > 1), "largest_component_fraction"),
        *((c(f) < 0, f) for f in features.MOTIFS),
    ]
    for first, group in features.QUANTILES.items():
        q = F.array_compact(F.array(*map(c, group)))
        tests.append((q != F.array_sort(q), first[: -len("_q00")]))
    return w.select("graph", F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in tests)))).alias("reason"))


def uniform_range(corpus: DataFrame, copies: int = 1, seed: int = 0, widen: float = WIDEN, support: int = SUPPORT) -> DataFrame:
    """``(copy, feature, value)``: features drawn uniformly from the population's range, widened on both sides.

    The class block is left untyped, and a feature with fewer than ``support``
    finite values in the population is null; values are clamped and rounded to their domains.
    """
    spark = corpus.sparkSession
    cat = features.catalogue(spark).filter("block <> 'e'")
    lim = corpus.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("feature").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count(F.lit(1)).alias("n"))
    x = cat.join(lim, "feature", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    pad = widen * (F.col("b") - F.col("a"))
    v = F.col("a") - pad + uniform(seed, "copy", "feature") * (F.col("b") - F.col("a") + 2 * pad)
    v = F.greatest(F.col("lo"), F.least(F.col("hi"), v))
    v = F.when(F.col("integer"), F.bround(v, 0)).otherwise(v)
    v = F.when(F.col("feature") == "num_classes", F.lit(0.0)).when((F.col("of") == "classes"), F.lit(None)).when(F.col("n") >= support, v)
    return x.select("copy", "feature", v.alias("value"))


class Sampler(ABC):
    """A way to draw feature vectors from a population ``(graph, feature, value)``: ``(copy, feature, value)``."""

    @abstractmethod
    def draw(self, corpus: DataFrame, copies: int = 1, seed: int = 0) -> DataFrame: ...

    def save(self, corpus: DataFrame, path: str, copies: int = 1, seed: int = 0, mode: str = "errorifexists") -> None:
        """Draw, and write a JSON object per copy with its features; unmeasured ones are left out."""
        x = self.draw(corpus, copies, seed).filter(F.col("value").isNotNull())
        x.groupBy("copy").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "value")))).alias("features")).write.mode(mode).json(path)


class UniformRange(Sampler):
    """:func:`uniform_range`."""

    def __init__(self, widen: float = WIDEN, support: int = SUPPORT):
        self.widen, self.support = widen, support

    def draw(self, corpus: DataFrame, copies: int = 1, seed: int = 0) -> DataFrame:
        return uniform_range(corpus, copies, seed, self.widen, self.support)


def size_free(table: DataFrame, weak: bool = False) -> DataFrame:
    """A feature table without the features that grow with the graph (and, with ``weak``, slowly with it)."""
    return table.filter(F.col("feature").isin(features.size_free(features.ORDER, weak)))


def identity(table: DataFrame, specs: dict[str, Spec] | None = None, copies: int = 1, seed: int = 0) -> DataFrame:
    """The table as it is, in the shape of :func:`perturb`."""
    x = table.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return x.select("graph", "copy", "feature", "value", F.col("value").alias("raw"), F.lit(False).alias("clamped"), F.lit(False).alias("moved"))


#: Transforms by name: functions of (table, specs, copies, seed).  Own ones may be added.
TRANSFORMS = {"identity": identity, "joint": perturb, "ofat": lambda table, specs, copies=1, seed=0: perturb_levels(table, specs)}
