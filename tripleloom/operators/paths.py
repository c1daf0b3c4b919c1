"""Connectivity: components, clustering, assortativity, shortest paths, bridges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph
from .components import checkpointed, connected_components
from .motifs import triangles


def components(g: Graph) -> DataFrame:
    """``(name, component)`` of every vertex, literals and isolated ones included; the component is its smallest name."""
    c = connected_components(g.undirected)
    return g.names.select("name").join(c.withColumnRenamed("id", "name"), "name", "left").select("name", F.coalesce("component", "name").alias("component"))


def component_sizes(g: Graph) -> DataFrame:
    return components(g).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def largest_fraction(g: Graph) -> DataFrame:
    """Components, and the largest one's share of all vertices."""
    return component_sizes(g).agg(F.count(F.lit(1)).alias("num_components"), (F.max("size") / F.sum("size")).alias("largest_component_fraction"))


def clustering(g: Graph) -> DataFrame:
    """Mean local clustering over all vertices; below two neighbours it is 0."""
    t = triangles(g).select(F.explode(F.array("x", "y", "z")).alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("t"))
    local = t.join(g.ranked.select("r", "d"), "r").agg(F.coalesce(F.sum(2 * F.col("t") / (F.col("d") * (F.col("d") - 1))), F.lit(0.0)).alias("s"))
    return local.join(g.names.agg(F.count(F.lit(1)).alias("n")), F.lit(True)).select(F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("clustering_coefficient"))


def assortativity(g: Graph) -> DataFrame:
    """Correlation of the degrees at both ends of the edges."""
    d = g.ranked.select("r", "d")
    e = g.oriented.join(d.toDF("a", "da"), "a").join(d.toDF("b", "db"), "b")
    both = e.select("da", "db").union(e.select("db", "da"))
    return both.agg(F.corr("da", "db").alias("degree_assortativity"))


def draw_pairs(names: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``(i, src, dst)``: n sources and n targets, drawn by md5 of (seed, side, name) and paired by rank."""

    def side(tag: str, alias: str) -> DataFrame:
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), "name").cast("binary"))
        top = names.select(F.col("name").alias(alias), key.alias("k")).orderBy("k", alias).limit(n)
        return top.select(alias, F.row_number().over(Window.orderBy("k", alias)).alias("i"))

    return side("src", "src").join(side("dst", "dst"), "i")


def distances(g: Graph, sources: DataFrame) -> DataFrame:
    """``(src, name, dist)`` from each source to all it reaches, by breadth-first search from all at once.

    A round joins the frontier with the edges and drops what was reached before;
    it ends when nothing new is reached.
    """
    seen = checkpointed(sources.select("src").distinct().select("src", F.col("src").alias("name"), F.lit(0).alias("dist")))
    frontier = seen
    near = checkpointed(g.both_ways)
    for d in count(1):
        step = frontier.select("src", F.col("name").alias("u")).join(near, "u").select("src", F.col("v").alias("name")).distinct()
        frontier = checkpointed(step.join(seen, ["src", "name"], "left_anti").withColumn("dist", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.union(frontier))
    return seen


def sampled_distances(g: Graph, n: int = 1000, seed: int = 42) -> DataFrame:
    """``(i, src, dst, dist)`` of drawn pairs of non-literals in the largest component; equal ends are left out.

    All pairs are searched at once: a vertex holds one bit per pair, in words of
    64, and a round sends the new bits along all edges and joins them by OR.  A
    round's work is the edges, whatever the number of pairs; it ends when every
    target is reached.
    """
    at = g.ranked.select("name", "r")
    # by number, not by name; a vertex without edges is in no drawn pair
    comp = checkpointed(connected_components(g.oriented.toDF("u", "v")).join(at.toDF("name", "id"), "id").select("name", "component"))
    big = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first")).orderBy(F.desc("n"), "first").limit(1)
    inside = comp.join(F.broadcast(big.select("component")), "component").select("name").join(g.names.filter(~F.col("is_literal")).select("name"), "name")
    pairs = draw_pairs(inside, n, seed).filter("src <> dst").join(at.toDF("src", "a"), "src").join(at.toDF("dst", "b"), "dst")
    pairs = checkpointed(pairs.withColumn("word", F.floor((F.col("i") - 1) / 64).cast("int")).withColumn("bit", F.expr("shiftleft(1L, cast((i - 1) % 64 as int))")))
    left, words = pairs.count(), [f"w{k}" for k in range(-(-n // 64))]
    new = checkpointed(pairs.groupBy(F.col("a").alias("v")).agg(*(F.bit_or(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(w) for k, w in enumerate(words))))
    seen, found = new, pairs.select("i", "src", "dst", F.lit(0).alias("dist")).limit(0)
    for d in count(1):
        if not left:
            break
        step = new.withColumnRenamed("v", "u").join(g.numbered, "u").groupBy("v").agg(*(F.bit_or(w).alias(w) for w in words))
        old = seen.select("v", *(F.col(w).alias(f"s{w}") for w in words))
        fresh = step.join(old, "v", "left").select("v", *(F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"s{w}", F.lit(0).cast("long")))).alias(w) for w in words))
        new = checkpointed(fresh.filter(" OR ".join(f"{w} <> 0" for w in words)))
        if new.isEmpty():
            break
        mine = F.element_at(F.array(*words), F.col("word") + 1)
        hit = checkpointed(pairs.join(new, pairs.b == new.v).filter(mine.bitwiseAND(F.col("bit")) != 0).select("i", "src", "dst", F.lit(d).alias("dist")))
        left, found = left - hit.count(), found.union(hit)
        seen = checkpointed(seen.union(new).groupBy("v").agg(*(F.bit_or(w).alias(w) for w in words)))
    return found


def path_stats(g: Graph, n: int = 1000, seed: int = 42) -> DataFrame:
    """Largest, mean and (population) variance of the drawn pairs' distances."""
    x = F.col("dist").cast("double")
    return sampled_distances(g, n, seed).agg(F.max(x).alias("shortest_path_max"), F.avg(x).alias("shortest_path_mean"), F.var_pop(x).alias("shortest_path_var"))


def bridges(g: Graph, seed: int = 0) -> DataFrame:
    """``(u, v)``: edges whose loss parts a component.

    A forest is grown from the components' first vertices, a level a round.  Every edge
    outside the forest gets a random number of 64 bits, which its two ends carry;
    going up level by level, a vertex passes the exclusive or of all below it to its
    parent.  What arrives over a forest edge is then the exclusive or of the edges
    that go round it: zero where there is none.  A false bridge has a chance of
    2^-64 an edge.
    """
    e = checkpointed(g.undirected)
    near = checkpointed(e.union(e.select("v", "u")))
    seen = checkpointed(connected_components(e).select(F.col("component").alias("name")).distinct().select("name", F.lit(None).cast("string").alias("up"), F.lit(0).alias("depth")))
    new = seen
    for d in count(1):
        step = new.select(F.col("name").alias("u")).join(near, "u").groupBy(F.col("v").alias("name")).agg(F.min("u").alias("up"))
        new = checkpointed(step.join(seen.select("name"), "name", "left_anti").withColumn("depth", F.lit(d)))
        if new.isEmpty():
            break
        seen = checkpointed(seen.union(new))
    tree = seen.filter("up is not null").select(F.least("name", "up").alias("u"), F.greatest("name", "up").alias("v"))
    rest = e.join(tree, ["u", "v"], "left_anti").withColumn("x", F.xxhash64(F.lit(seed), "u", "v"))
    own = rest.select(F.col("u").alias("name"), "x").union(rest.select("v", "x")).groupBy("name").agg(F.bit_xor("x").alias("x"))
    levels = checkpointed(seen.join(own, "name", "left").select("name", "up", "depth", F.coalesce("x", F.lit(0).cast("long")).alias("x")))
    found, below = [], None
    for k in range(d - 1, 0, -1):
        at = levels.filter(F.col("depth") == k).select("name", "up", "x")
        if below is not None:
            at = at.join(below, "name", "left").select("name", "up", F.col("x").bitwiseXOR(F.coalesce("y", F.lit(0).cast("long"))).alias("x"))
        at = checkpointed(at)
        found.append(at.filter("x = 0").select(F.least("name", "up").alias("u"), F.greatest("name", "up").alias("v")))
        below = at.groupBy(F.col("up").alias("name")).agg(F.bit_xor("x").alias("y"))
    out = e.limit(0)
    for f in found:
        out = out.union(f)
    return out
