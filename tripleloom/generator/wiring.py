"""Stage two: entities get relation sets and degrees, and relations are wired.

Per-entity work is DataFrame expressions.  Wiring is by relation and bucket: a
relation with many edges is split into buckets of about ``BUCKET`` edges by the
hash of the entities, so a frequent relation is many tasks.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fits import SUFFIXES
from ..functions.uniform import uniform
from ..operators.components import checkpointed, connected_components
from ..operators.ranks import numbered
from ..plans.graph import RDF_TYPE, Graph
from .allocation import ipf
from .schema import Schema, degree_sequence, largest_remainder, power_sample, quantile_sample

BUCKET, ROUNDS = 200_000, 12
log = logging.getLogger(__name__)
#: Features that this stage reads.
READS = dict.fromkeys(
    ["subject_frac", "object_frac", "num_components", "largest_component_fraction"] + [f"{side}_degree_{x}" for side in ("out", "in") for x in ("alpha", "p90", "max")]
    + [f"{inv}{x}" for inv in ("", "inv_") for x in ("num_distinct_cs", "cs_freq_alpha", "cs_freq_vmin", "cs_freq_vmax", *(f"cs_size_{s}" for s in SUFFIXES))], ""
)


def template_pool(spark: SparkSession, n: int, sizes: list[float], weights: np.ndarray, seed: int, tag: str) -> DataFrame:
    """``(t, cs)``: about n distinct sorted sets of relation numbers.

    A candidate's size comes from the quantile function; its relations are the
    first by an exponential race with the weights, run as one matrix a batch.  Twice as
    many candidates as needed are drawn, made distinct, and the first n stay.
    """
    from ..plans.session import ship

    ship(spark)
    r = len(weights)
    cand = spark.range(max(1, 2 * n + 10)).select(F.col("id").alias("c"))
    k = F.greatest(F.lit(1), F.least(F.lit(r), F.round(quantile_sample(uniform(seed, F.lit(tag), F.col("c"), F.lit("size")), sizes)).cast("int")))
    log_w, salt = np.log(np.maximum(weights, 1e-12)), seed * 1_000_003 + sum(map(ord, tag))
    rows = max(1, min(1000, 4_000_000 // max(1, r)))  # 32 MB of doubles

    def run(batches):
        import pandas as pd

        for b in batches:
            for at in range(0, len(b), rows):
                c, size = b["c"].to_numpy()[at : at + rows], b["k"].to_numpy()[at : at + rows]
                race = np.log(-np.log(hashed(salt, c[:, None], np.arange(r)[None, :]))) - log_w
                order = np.argsort(race, axis=1, kind="stable")
                yield pd.DataFrame({"c": c, "cs": [sorted(o[:m].tolist()) for o, m in zip(order, size, strict=True)]})

    x = cand.withColumn("k", k).mapInPandas(run, "c long, cs array<int>").groupBy("cs").agg(F.min("c").alias("c"))
    return checkpointed(numbered(first_rows(x, [F.col("c")], n), ["c"]).select(F.col("rank").alias("t"), "cs"))


def hashed(seed: int, *keys: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from whole numbers, the same everywhere."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed % (1 << 64))
        for k in keys:
            x = (x ^ k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x = x ^ (x >> np.uint64(32))
    return ((x >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def assign_templates(spark: SparkSession, entities: int, pool: DataFrame, alpha: float, lo: float, hi: float, seed: int, tag: str) -> DataFrame:
    """``(i, cs)``: every template to one entity at least, the rest in proportion to power-law weights.

    Templates own ranges of ranks; an entity's rank is its number, scrambled.
    """
    n = pool.count()
    x = pool.withColumn("w", power_sample(uniform(seed, F.lit(tag), F.col("t"), F.lit("use")), alpha, lo, hi))
    extra = max(0, entities - n)
    x = largest_remainder(x.withColumn("g", F.lit(1)), "w", extra, ["g"], "t").withColumn("m", F.col("quota") + 1)
    ranges = numbered(x.select("t", "cs", "m"), ["t"], value=F.col("m")).select("t", "cs", F.col("before").cast("long").alias("a"), "m")
    ranks = ranges.select("cs", F.explode(F.sequence(F.col("a"), F.col("a") + F.col("m") - 1)).alias("rank")).filter(F.col("rank") < entities)
    # numbers scrambled by a fixed multiplier that shares no factor with the size
    step = next(s for s in range(int(entities * 0.618) | 1, 2 * entities + 3) if math.gcd(s, entities) == 1) if entities > 1 else 1
    shift = (seed * 7919 + (len(tag) * 104729)) % entities
    return ranks.select(((F.col("rank") * step + shift) % entities).alias("i"), "cs")


def match_degrees(sets: DataFrame, degrees: DataFrame) -> DataFrame:
    """``(i, d)``: the largest degrees to the entities with the largest sets, ties by number."""
    a = numbered(sets.select("i", F.size("cs").alias("k")), [F.desc("k"), "i"]).select("i", "rank")
    b = numbered(degrees.select("i", "d"), [F.desc("d"), "i"]).select("d", "rank")
    return checkpointed(a.join(b, "rank", "left").select("i", F.coalesce("d", F.lit(1)).cast("long").alias("d")))


def assign_classes(sets: DataFrame, schema: Schema) -> DataFrame:
    """``(i, class)``: the class whose relations make the set most likely, for the entities with the best fit."""
    spark = sets.sparkSession
    if not schema.type_edges or not len(schema.class_probs):
        return spark.createDataFrame([], "i long, class int")
    logp = spark.createDataFrame([(int(t), int(r), float(math.log(max(p, 1e-12)))) for (t, r), p in np.ndenumerate(schema.class_probs)], "class int, r int, lp double")
    logp = F.broadcast(logp) if schema.class_probs.size <= 500_000 else logp  # 24 bytes each
    x = sets.select("i", F.explode("cs").alias("r")).join(logp, "r").groupBy("i", "class").agg(F.sum("lp").alias("lp"))
    best = x.groupBy("i").agg(F.max(F.struct(F.round("lp", 9).alias("lp"), (-F.col("class")).alias("c"))).alias("b")).select("i", (-F.col("b.c")).alias("class"), F.col("b.lp").alias("lp"))
    return first_rows(best, [F.desc(F.round("lp", 9)), F.col("i")], schema.type_edges).select("i", "class")


def first_rows(df: DataFrame, order: list[F.Column], n: int) -> DataFrame:
    """The first n rows in an order, however large n is: a global sort, whose partitions' sizes give each row its place."""
    x = df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    x = checkpointed(x)
    sizes, before = sorted((r["_p"], r["n"]) for r in x.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()), 0
    keep = F.lit(False)
    for part, size in sizes:  # all of a partition, none of it, or the rows up to a place
        if before + size <= n:
            keep = keep | (F.col("_p") == part)
        elif before < n:
            keep = keep | ((F.col("_p") == part) & (F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) < n - before))
        before += size
    return x.filter(keep).drop("_p", "_m")


def stubs(sets: DataFrame, degrees: DataFrame, budget: DataFrame, other: DataFrame, sweeps: int = 4) -> DataFrame:
    """``(r, i, n)``: edges of each entity in each relation of its set, whole numbers.

    The table of entities and relations is fitted to the degrees and the budget by
    proportional scaling, then rounded so that each relation's sum is its budget
    exactly and each entry is at least one.  No entry is above ``other(r, cap)``, the number of
    entities that the relation has on the other side; what that cuts off goes to entries with room.
    """
    x = sets.join(degrees, "i").select("i", F.explode("cs").alias("r"), "d").join(budget, "r")
    fitted = ipf(x.select(F.col("i").alias("row"), F.col("r").alias("col"), F.lit(1.0).alias("w")), degrees.select(F.col("i").alias("row"), F.col("d").cast("double").alias("rt")), budget.select(F.col("r").alias("col"), F.col("e").cast("double").alias("ct")), sweeps)
    per = x.groupBy("r").agg(F.count(F.lit(1)).alias("members"))
    x = fitted.select(F.col("col").alias("r"), F.col("row").alias("i"), F.greatest(F.col("x") - 1, F.lit(1e-3)).alias("w")).join(budget, "r").join(per, "r").join(other, "r")
    more = F.greatest(F.least(F.col("e"), F.col("members") * F.col("cap")) - F.col("members"), F.lit(0))
    x = checkpointed(largest_remainder(x.withColumn("more", more), "w", F.col("more"), ["r"], "i").withColumn("n", F.least(F.col("quota") + 1, F.col("cap"))))
    short = x.groupBy("r").agg((F.max(F.col("more") + F.col("members")) - F.sum("n")).alias("short"))
    room = x.join(short.filter("short > 0"), "r").withColumn("room", F.col("cap") - F.col("n")).filter("room > 0")
    extra = largest_remainder(room.withColumn("w", F.col("room").cast("double")), "w", F.col("short"), ["r"], "i").select("r", "i", F.least("quota", "room").alias("add"))
    return x.join(extra, ["r", "i"], "left").select("r", "i", (F.col("n") + F.coalesce("add", F.lit(0))).alias("n"))


def trim(edges: DataFrame, keep: DataFrame, surplus: int, seed: int = 0) -> DataFrame:
    """``edges(s, r, o)`` without ``surplus`` of them, or as many as can go: those whose ends have most edges of the relation first, ties by hash.

    An edge may go only if its subject and its object keep another of the relation,
    so no set changes, and ``keep`` (bridges) stay.  One round takes one edge of an
    end and relation at most; rounds go on until the surplus is gone or nothing can go.
    """
    for turn in range(ROUNDS):
        if surplus <= 0:
            break
        out, into = (edges.groupBy("r", end).agg(F.count(F.lit(1)).alias(name)) for end, name in (("s", "a"), ("o", "b")))
        able = edges.join(keep, ["s", "r", "o"], "left_anti").join(out, ["r", "s"]).join(into, ["r", "o"]).filter("a > 1 and b > 1").withColumn("w", F.col("a") + F.col("b")).withColumn("h", F.xxhash64(F.lit(seed + turn), "s", "r", "o"))
        first = F.max(F.struct("w", "h", "s", "o")).alias("x")
        able = able.groupBy("r", F.col("s").alias("at")).agg(first).select("r", "x.*").groupBy("r", F.col("o").alias("at")).agg(first).select("r", "x.*")
        gone = checkpointed(first_rows(able, [F.desc("w"), F.col("h")], surplus).select("s", "r", "o"))
        n = gone.count()
        if not n:
            break
        surplus -= n
        edges = checkpointed(edges.join(gone, ["s", "r", "o"], "left_anti"))
    return edges


def pair_stubs(out: np.ndarray, into: np.ndarray, mutual: float, seed: int) -> list[tuple[int, int]]:
    """Distinct pairs without loops from two lists of ends; a share of them in both directions.

    Ends are shuffled; a pair that repeats or loops swaps its target with a
    random other one a few times before it is given up.
    """
    rng = np.random.default_rng(seed)
    out, into = rng.permutation(out), rng.permutation(into)
    n = min(len(out), len(into))
    found: set[tuple[int, int]] = set()
    used_o, used_i = np.zeros(len(out), bool), np.zeros(len(into), bool)
    if mutual > 0:  # entities that have ends on both sides pair up with each other
        where: dict[int, list[int]] = {}
        for k, v in enumerate(into.tolist()):
            where.setdefault(v, []).append(k)
        ends: dict[int, list[int]] = {}
        for k, v in enumerate(out.tolist()):
            ends.setdefault(v, []).append(k)
        want, made = mutual * n, 0
        for _ in range(8):  # an entity with several ends on both sides gets other partners each time
            both = [v for v in ends if ends[v] and where.get(v)]
            if made >= want or len(both) < 2:
                break
            rng.shuffle(both)
            for a, b in zip(both[::2], both[1::2], strict=False):
                if made < want and (a, b) not in found and (b, a) not in found:
                    for s, t in ((a, b), (b, a)):
                        used_o[ends[s].pop()] = used_i[where[t].pop()] = True
                        found.add((s, t))
                    made += 2
    o, t = out[~used_o].tolist(), into[~used_i].tolist()
    n = min(len(o), len(t))
    for k in range(n):
        for _ in range(16):
            if o[k] != t[k] and (o[k], t[k]) not in found:
                found.add((o[k], t[k]))
                break
            j = int(rng.integers(k, n))
            t[k], t[j] = t[j], t[k]
    return sorted(found)


def wire(out: DataFrame, into: DataFrame, schema: Schema, bucket: int = BUCKET) -> DataFrame:
    """``(s, r, o)``: each relation's ends joined, by bucket; leftovers again in other buckets until a round places none.

    What no round could place is counted in ``schema.notes["unplaced"]``.
    """
    from ..plans.session import ship

    spark = out.sparkSession
    ship(spark)
    rec = {i: float(x) for i, x in enumerate(schema.reciprocity)}
    seed = schema.seed

    def run(key, left, right):
        import pandas as pd

        r = int(key[0])
        left, right = left.sort_values("i"), right.sort_values("i")  # rows come in any order
        a = np.repeat(left.i.to_numpy(), left.n.to_numpy()) if len(left) else np.empty(0, int)
        b = np.repeat(right.i.to_numpy(), right.n.to_numpy()) if len(right) else np.empty(0, int)
        pairs = pair_stubs(a, b, rec.get(r, 0.0), seed * 1_000_003 + r * 1009 + int(key[1]))
        return pd.DataFrame({"s": [p[0] for p in pairs], "r": r, "o": [p[1] for p in pairs]}, columns=["s", "r", "o"])

    made = None
    for turn in range(ROUNDS):
        size = out.groupBy("r").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / bucket)).alias("buckets"))
        deal = lambda x, s=size, k=turn: x.join(F.broadcast(s), "r").withColumn("b", F.pmod(F.xxhash64(F.lit(k), "i"), F.col("buckets")).cast("int")).select("r", "b", "i", "n")
        new = deal(out).groupBy("r", "b").cogroup(deal(into).groupBy("r", "b")).applyInPandas(run, "s long, r int, o long")
        if made is not None:
            new = new.join(made, ["s", "r", "o"], "left_anti")
        new = checkpointed(new)
        if made is not None and new.isEmpty():
            break
        made = new if made is None else checkpointed(made.unionByName(new))
        less = lambda x, end, n=new: x.join(n.groupBy("r", F.col(end).alias("i")).agg(F.count(F.lit(1)).alias("got")), ["r", "i"], "left").select("r", "i", (F.col("n") - F.coalesce("got", F.lit(0))).alias("n")).filter("n > 0")
        out, into = checkpointed(less(out, "s")), checkpointed(less(into, "o"))
        if out.isEmpty() or into.isEmpty():
            break
    schema.notes["unplaced"] = int(out.agg(F.sum("n")).first()[0] or 0)
    if schema.notes["unplaced"]:
        log.warning("%d edges could not be placed", schema.notes["unplaced"])
    return made


def connect_plan(sizes: DataFrame, entities: int, components: int, fraction: float) -> DataFrame:
    """``(component, size, action)``: which components stay apart and which are bridged to the largest.

    The smallest ones stay, as many (up to ``components`` - 1) as bring their sum
    closest to the share that is to lie outside the largest.
    """
    x = numbered(sizes, [F.desc("size"), "component"]).withColumn("big", F.col("rank") == 1).drop("rank")
    small = numbered(x.filter("not big"), ["size", "component"], value=F.col("size"))
    small = checkpointed(small.withColumn("j", F.col("rank").cast("int")).withColumn("sum", F.col("before") + F.col("size")))
    goal = (1 - fraction) * entities
    best = small.filter(F.col("j") <= max(0, components - 1)).select("j", F.abs(F.col("sum") - goal).alias("miss")).union(sizes.sparkSession.createDataFrame([(0, float(goal))], "j int, miss double")).orderBy("miss", "j").limit(1).select(F.col("j").alias("keep"))
    plan = small.join(F.broadcast(best), F.lit(True)).select("component", "size", F.when(F.col("j") <= F.col("keep"), F.lit("apart")).otherwise(F.lit("bridge")).alias("action"))
    return plan.union(x.filter("big").select("component", "size", F.lit("largest")))


def instantiate(spark: SparkSession, schema: Schema) -> Graph:
    """A graph with the schema's entities, sets, degrees and classes."""
    v, get = schema.entities, schema.values
    q = lambda p: [get[f"{p}_{s}"] for s in SUFFIXES]
    rest = lambda f, d: d if math.isnan(get.get(f, math.nan)) else get[f]
    content = max(1, schema.edges - schema.type_edges)
    sides = {}
    for tag, prefix, side, active in (("out", "", "out", "subject_frac"), ("in", "inv_", "in", "object_frac")):
        share = max(1.0 / v, min(1.0, rest(active, 1.0)))
        n = max(1, round(share * v))
        pool = template_pool(spark, max(1, min(n, int(get[f"{prefix}num_distinct_cs"]))), q(f"{prefix}cs_size"), schema.weights, schema.seed, tag)
        sets = assign_templates(spark, n, pool, rest(f"{prefix}cs_freq_alpha", math.nan), rest(f"{prefix}cs_freq_vmin", 1.0), rest(f"{prefix}cs_freq_vmax", math.nan), schema.seed, tag)
        sets = checkpointed(sets.withColumn("i", F.col("i").cast("long")))
        deg = degree_sequence(spark, n, get[f"{side}_degree_alpha"], get[f"{side}_degree_p90"], get[f"{side}_degree_max"], content / n, 1.0, schema.seed, tag)
        sides[tag] = sets, match_degrees(sets, deg)
    w = spark.createDataFrame([(i, float(x)) for i, x in enumerate(schema.weights)], "r int, w double")
    members = {tag: checkpointed(sets.select(F.explode("cs").alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias(f"n_{tag}"))) for tag, (sets, _) in sides.items()}
    # a relation needs an edge for each member of either side, and has no more than pairs of them
    both = members["out"].join(members["in"], "r")
    budget = largest_remainder(w.join(both, "r").withColumn("g", F.lit(1)), "w", content, ["g"], "r")
    least, most = F.greatest("n_out", "n_in"), F.col("n_out") * F.col("n_in")
    budget = checkpointed(budget.select("r", F.least(F.greatest("quota", least), most).alias("e")))
    ends = {tag: checkpointed(stubs(sets, deg, budget, members[facing].select("r", F.col(f"n_{facing}").alias("cap")))) for (tag, (sets, deg)), facing in zip(sides.items(), ("in", "out"), strict=True)}
    made = wire(ends["out"], ends["in"], schema)
    # components as wanted: the rest is bridged to the largest by one edge each
    comp = connected_components(made.select(F.col("s").alias("u"), F.col("o").alias("v")))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    plan = checkpointed(connect_plan(sizes, v, int(get["num_components"]), get["largest_component_fraction"]))
    hub = plan.filter("action = 'largest'").select(F.col("component").alias("o"))
    bridge = plan.filter("action = 'bridge'").select(F.col("component").alias("s")).join(F.broadcast(hub), F.lit(True)).select("s", F.lit(int(np.argmax(schema.weights))).cast("int").alias("r"), "o")
    bridge = checkpointed(bridge)
    edges = checkpointed(made.unionByName(bridge).distinct())
    surplus = edges.count() - content
    edges = trim(edges, bridge, surplus, schema.seed)
    schema.notes["surplus"] = max(0, surplus)
    rel = F.concat(F.lit("relation/"), F.col("r"))
    name = lambda c: F.concat(F.lit("entity/"), F.col(c))
    triples = edges.select(name("s").alias("s"), rel.alias("p"), name("o").alias("o"), F.lit(False).alias("o_is_literal"))
    typed = assign_classes(sides["out"][0], schema).select(name("i").alias("s"), F.lit(RDF_TYPE).alias("p"), F.concat(F.lit("class/"), F.col("class")).alias("o"), F.lit(False).alias("o_is_literal"))
    return Graph(checkpointed(triples.unionByName(typed)), distinct=True)
