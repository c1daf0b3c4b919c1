"""Measurements of a graph, one plan each (blocks A to D of the signature).

Each function takes a :class:`~tripleloom.plans.graph.Graph` and returns a
DataFrame.  Counts are longs, ratios doubles; what cannot be measured is null.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fits
from ..plans.graph import RDF_TYPE, Graph

_long = lambda c: c.cast("long")

log = logging.getLogger(__name__)


def _ratio(a: F.Column, b: F.Column) -> F.Column:
    return F.when(b != 0, a.cast("double") / b)


# Block A


def size_vocabulary(g: Graph) -> DataFrame:
    """Entities (classes included), relations, triples per entity, share of rdf:type; one aggregate over edges and names."""
    e = g.edges.select(F.lit(1).alias("e"), (F.col("p") == RDF_TYPE).cast("int").alias("t"), "p", F.lit(0).alias("v"))
    v = g.names.filter(~F.col("is_literal")).select(F.lit(0), F.lit(0), F.lit(None).cast("string"), F.lit(1))
    x = e.union(v).agg(F.coalesce(F.sum("e"), F.lit(0)).alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.countDistinct("p").alias("r"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    zero = F.lit(0.0)
    return x.select(
        _long(F.col("v")).alias("num_entities"), _long(F.col("r")).alias("num_relations"),
        F.coalesce(_ratio(F.col("n"), F.col("v")), zero).alias("mean_degree"), F.coalesce(_ratio(F.col("t"), F.col("n")), zero).alias("type_edge_frac"),
    )


def relation_usage(g: Graph) -> DataFrame:
    """Edges of each relation, their share and its logarithm, and the rank by frequency (ties by name)."""
    n = g.edges.groupBy("p").agg(F.count(F.lit(1)).alias("n_edges"))
    share = F.col("n_edges") / F.sum("n_edges").over(Window.partitionBy())
    return n.select("p", "n_edges", share.alias("share"), F.log(share).alias("log_share"), F.row_number().over(Window.orderBy(F.desc("n_edges"), "p")).alias("rank"))


# Block B


def degree_stats(g: Graph, side: str) -> DataFrame:
    """Largest, 90th percentile, mean and share of nonzero content degrees over all entities; ``side`` is dout or din."""
    d = F.col(side)
    return g.content_degrees.agg(
        _long(F.max(d)).alias("max_degree"), F.percentile(d, 0.9).alias("p90"), F.avg(d).alias("mean_degree"), F.avg((d > 0).cast("double")).alias("active_frac"), _long(F.count(d)).alias("n_entities")
    )


def degree_histogram(g: Graph) -> DataFrame:
    """Entities at each content degree of either side, and the share at that degree or above (the plotted curve)."""
    x = g.content_degrees.select(F.explode(F.array(F.struct(F.lit("out").alias("side"), F.col("dout").alias("d")), F.struct(F.lit("in").alias("side"), F.col("din").alias("d")))).alias("x"))
    n = x.groupBy("x.side", "x.d").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("side")
    above = F.sum("n").over(w.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0))
    return n.select("side", _long(F.col("d")).alias("degree"), "n", (above / F.sum("n").over(w)).alias("ccdf"))


def multiplicities(g: Graph, side: str) -> DataFrame:
    """``(p, name, m)``: objects per (relation, subject) over all edges, or subjects per (relation, object) over non-literals."""
    if side == "obj":
        return g.edges.groupBy("p", F.col("s").alias("name")).agg(F.count(F.lit(1)).alias("m"))
    return g.edges.filter(~F.col("o_is_literal")).groupBy("p", F.col("o").alias("name")).agg(F.count(F.lit(1)).alias("m"))


def multiplicity_stats(g: Graph, side: str) -> DataFrame:
    """Per relation: groups, mean, largest and the sum of logarithms (the statistics of the power-law fit)."""
    m = F.col("m")
    return multiplicities(g, side).groupBy("p").agg(F.count(m).alias("n_groups"), F.avg(m).alias("mean_mult"), F.max(m).alias("max_mult"), F.sum(F.log(m.cast("double"))).alias("sum_log"))


def _set_sizes(g: Graph, side: str) -> DataFrame:
    """Number of relations of each subject (or of each non-literal object), without building the sets."""
    x = g.edges if side == "obj" else g.edges.filter(~F.col("o_is_literal"))
    name = F.col("s" if side == "obj" else "o").alias("name")
    return x.groupBy(name).agg(F.countDistinct("p").alias("size"))


def size_offset(g: Graph) -> DataFrame:
    """Slope of ln(multiplicity) on ln(size of the set), both sides.

    The size is the number of groups that a vertex has, so a window over the
    multiplicities gives it without a second scan.
    """
    out = []
    for side in ("obj", "subj"):
        x = multiplicities(g, side).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("name")))
        out.append(x.agg(fits.log_slope(F.col("size"), F.col("m")).alias("slope"), F.count(F.lit(1)).alias("n_pairs")).select(F.lit(f"a_{side}").alias("side"), "slope", "n_pairs"))
    return out[0].union(out[1])


def reciprocity(g: Graph) -> DataFrame:
    """Per relation: content pairs, pairs whose reverse also exists in the relation, and their share."""
    pairs = g.content
    back = pairs.select("p", F.col("o").alias("s"), F.col("s").alias("o"), F.lit(1).alias("hit"))
    x = pairs.join(back, ["p", "s", "o"], "left").groupBy("p").agg(F.count(F.lit(1)).alias("n_pairs"), _long(F.count("hit")).alias("n_mutual"))
    return x.withColumn("reciprocity", F.col("n_mutual") / F.col("n_pairs"))


def reciprocity_bins(g: Graph) -> DataFrame:
    """Relations by cumulative share of edges in six bins: their number and the share that is symmetric (over one half)."""
    total = g.edges.groupBy("p").agg(F.count(F.lit(1)).alias("n_edges"))
    x = reciprocity(g).join(total, "p")
    cum = F.sum("n_edges").over(Window.orderBy(F.desc("n_edges"), "p")) / F.sum("n_edges").over(Window.partitionBy())
    x = x.select("p", "reciprocity", F.round(cum, 12).alias("cum"))
    bin_ = F.lit(len(fits.LEVELS) - 2)
    for i in range(len(fits.LEVELS) - 2, -1, -1):
        bin_ = F.when(F.col("cum") <= fits.LEVELS[i + 1], F.lit(i)).otherwise(bin_)
    high = (F.col("reciprocity") > 0.5).cast("double")
    return x.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n_relations"), F.avg(high).alias("frac_symmetric"))


def symmetric_value(g: Graph) -> DataFrame:
    """Mean reciprocity of the relations that are symmetric."""
    return reciprocity(g).agg(F.avg(F.when(F.col("reciprocity") > 0.5, F.col("reciprocity"))).alias("recip_symmetric_value"))


def relation_quantiles(g: Graph) -> DataFrame:
    """Quantile function of the relations' logarithmic shares."""
    return relation_usage(g).agg(*fits.quantiles(F.col("log_share"), min_samples=2))


def degree_powerlaw(g: Graph) -> DataFrame:
    """Truncated power-law exponent of the positive content degrees of each side, support from 1."""
    x = g.content_degrees.select(F.explode(F.array(F.struct(F.lit("out").alias("side"), F.col("dout").alias("d")), F.struct(F.lit("in").alias("side"), F.col("din").alias("d")))).alias("x"))
    return fits.power_fit(x.select("x.side", "x.d"), "d", ["side"]).select("side", "n", "lo", "hi", "alpha")


def multiplicity_alphas(g: Graph, side: str) -> DataFrame:
    """Per relation: the exponent of its multiplicities; NaN where there are too few or all are equal."""
    return fits.power_fit(multiplicities(g, side), "m", ["p"])


def multiplicity_alpha_quantiles(g: Graph) -> DataFrame:
    """Quantile function of the relations' exponents, ends pinned, both sides."""
    out = []
    for side in ("obj", "subj"):
        q = multiplicity_alphas(g, side).agg(*fits.quantiles(F.col("alpha"), ends=fits.ALPHA_ENDS))
        out.append(q.select(F.lit(side).alias("side"), "*"))
    return out[0].union(out[1])


# Block C


def _members(g: Graph, side: str) -> DataFrame:
    """Distinct (vertex, relation): of subjects, or of objects, literals included."""
    return g.edges.select(F.col("s" if side == "subj" else "o").alias("name"), "p").distinct()


def cooccurrence(g: Graph, side: str) -> DataFrame:
    """``(p, q, n)``: vertices that have both relations; the diagonal is there.

    Vertices with the same set are counted once per set first, so a hub's weight
    or a million equal vertices cost one row.
    """
    sets = _members(g, side).groupBy("name").agg(F.array_sort(F.collect_set("p")).alias("cs")).groupBy("cs").agg(F.count(F.lit(1)).alias("n"))
    x = sets.select("cs", "n", F.explode("cs").alias("p")).select("p", "n", F.explode("cs").alias("q"))
    return x.groupBy("p", "q").agg(F.sum("n").alias("n"))


def cooccurrence_density(g: Graph) -> DataFrame:
    """Share of relation pairs that occur, both sides."""
    r = g.edges.agg(F.countDistinct("p").alias("r"))
    out = [cooccurrence(g, side).agg(F.count(F.lit(1)).alias("nnz")).select(F.lit(side).alias("side"), "nnz") for side in ("subj", "obj")]
    return out[0].union(out[1]).join(F.broadcast(r), F.lit(True)).select("side", "nnz", _ratio(F.col("nnz"), F.col("r") * F.col("r")).alias("density"))


def row_entropies(g: Graph, side: str) -> DataFrame:
    """Entropy of each relation's row of the co-occurrence matrix; 0 for a relation without one."""
    m = cooccurrence(g, side)
    share = F.col("n") / F.sum("n").over(Window.partitionBy("p"))
    h = m.withColumn("share", share).groupBy("p").agg(fits.entropy(F.col("share")).alias("h"))
    return g.edges.select("p").distinct().join(h, "p", "left").select("p", F.coalesce("h", F.lit(0.0)).alias("h"))


def row_entropy_quantiles(g: Graph) -> DataFrame:
    """Quantile function of the rows' entropies, both sides."""
    out = [row_entropies(g, side).agg(*fits.quantiles(F.col("h"))).select(F.lit(side).alias("side"), "*") for side in ("subj", "obj")]
    return out[0].union(out[1])


def class_sizes(g: Graph) -> DataFrame:
    """Instances of each class."""
    return g.edges.filter(F.col("p") == RDF_TYPE).groupBy(F.col("o").alias("class")).agg(F.countDistinct("s").alias("n_instances"))


def class_size_powerlaw(g: Graph) -> DataFrame:
    return fits.power_fit(class_sizes(g).withColumn("all", F.lit(1)), "n_instances", ["all"]).select("n", "lo", "hi", "alpha")


def type_relations(g: Graph) -> DataFrame:
    """``(class, p, n, prob)``: out-edges of a class's instances by relation, parallels and rdf:type included."""
    used = g.edges.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"))
    typed = g.edges.filter(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("class"))
    n = typed.join(used, "s").groupBy("class", "p").agg(F.sum("n").alias("n"))
    return n.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("class")))


def per_type_entropy(g: Graph) -> DataFrame:
    return type_relations(g).groupBy("class").agg(fits.entropy(F.col("prob")).alias("entropy"), F.count(F.lit(1)).alias("n_relations"))


def per_type_entropy_decay(g: Graph) -> DataFrame:
    """Exponential decay of the classes' entropies by rank."""
    return fits.rank_decay(per_type_entropy(g), "entropy")


def pair_ratios(g: Graph) -> DataFrame:
    """Content edges per directed pair, and directed per undirected pairs; pairs are counted once before the distincts."""
    d = g.content.groupBy("s", "o").agg(F.count(F.lit(1)).alias("n"))
    u = d.groupBy(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    x = u.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_content"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_directed"), F.count(F.lit(1)).alias("n_undirected"))
    return x.select("n_content", "n_directed", "n_undirected", _ratio(F.col("n_content"), F.col("n_directed")).alias("edge_multiplicity"), _ratio(F.col("n_directed"), F.col("n_undirected")).alias("bidirectional_ratio"))


#: Rows and columns, and entries, up to which a matrix is decomposed on the driver (32 MB dense).
DRIVER_MATRIX, DRIVER_ENTRIES = 2000, 500_000


def singular_values(m: DataFrame, row: str, col: str, value: str, k: int = 10) -> list[float]:
    """The largest singular values of a coordinate matrix.

    Up to :data:`DRIVER_MATRIX` rows and columns it is decomposed by numpy; beyond
    that by subspace iteration whose products are joins with aggregates.
    """
    sizes = m.agg(F.countDistinct(row), F.countDistinct(col)).first()
    entries = m.count()
    if not sizes[0]:
        return []
    k = min(k, max(0, min(sizes) - (1 if min(sizes) == max(sizes) else 0)))
    if max(sizes) <= DRIVER_MATRIX and entries <= DRIVER_ENTRIES:
        rows = m.select(row, col, F.col(value).cast("double")).toArrow()
        i, j = (rows.column(k).combine_chunks().dictionary_encode() for k in (0, 1))
        a = np.zeros((len(i.dictionary), len(j.dictionary)))
        a[i.indices.to_numpy(), j.indices.to_numpy()] = rows.column(2).to_numpy()
        return [float(x) for x in np.linalg.svd(a, compute_uv=False)]
    return subspace_iteration(m.select(F.col(row).alias("i"), F.col(col).alias("j"), F.col(value).cast("double").alias("x")), k)


def subspace_iteration(m: DataFrame, k: int, rounds: int = 30, seed: int = 0) -> list[float]:
    """Singular values by orthogonal iteration; only k x k matrices reach the driver."""
    from .components import checkpointed

    m = checkpointed(m)
    q = m.select("j").distinct().select("j", *((F.pmod(F.xxhash64("j", F.lit(seed + t)), F.lit(1 << 30)) / float(1 << 30) - 0.5).alias(f"q{t}") for t in range(k)))
    names = [f"q{t}" for t in range(k)]
    last = None
    for _ in range(rounds):
        up = m.join(q, "j").groupBy("i").agg(*(F.sum(F.col("x") * F.col(n)).alias(n) for n in names))
        z = checkpointed(m.join(up, "i").groupBy("j").agg(*(F.sum(F.col("x") * F.col(n)).alias(n) for n in names)))
        gram = z.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for s, a in enumerate(names) for b in names[s:])).first()
        g = np.array([[gram[f"{names[min(s, t)]}_{names[max(s, t)]}"] for t in range(k)] for s in range(k)])
        w, v = np.linalg.eigh(g)
        order = np.argsort(w)[::-1]
        w, v = np.maximum(w[order], 1e-300), v[:, order]
        t = v / np.sqrt(w)
        q = z.select("j", *(sum((F.col(names[s]) * float(t[s, u]) for s in range(k)), F.lit(0.0)).alias(names[u]) for u in range(k)))
        now = np.sqrt(np.sqrt(w))
        if last is not None and np.abs(now - last).max() <= 1e-9 * now.max():
            break
        before, last = last if last is not None else now, now
    else:
        log.warning("singular values still moved by %.2g of the largest after %d rounds", np.abs(now - before).max() / now.max(), rounds)
    return [float(x) for x in now]


def cooccurrence_spectrum(g: Graph, side: str, k: int = 10) -> DataFrame:
    """The largest singular values of the co-occurrence matrix over the number of entities, by rank."""
    spark = g.edges.sparkSession
    r = g.edges.agg(F.countDistinct("p")).first()[0]
    v = g.names.filter(~F.col("is_literal")).count() or 1
    s = singular_values(cooccurrence(g, side), "p", "q", "n", k)[: min(k, max(0, r - 1))]
    return spark.createDataFrame([(i, x / v) for i, x in enumerate(s)], "rank int, value double")


def type_spectrum(g: Graph, k: int = 10) -> DataFrame:
    """The largest singular values of the class-by-relation probabilities, by rank."""
    spark = g.edges.sparkSession
    r = g.edges.agg(F.countDistinct("p")).first()[0]
    m = type_relations(g)
    t = m.agg(F.countDistinct("class")).first()[0]
    s = singular_values(m, "class", "p", "prob", k)[: min(k, max(0, min(r, t) - 1))]
    return spark.createDataFrame([(i, x) for i, x in enumerate(s)], "rank int, value double")


# Block D


def set_frequencies(g: Graph, inverse: bool = False) -> DataFrame:
    """``(cs, size, n)``: each distinct (inverse) characteristic set, joined by spaces, and the vertices that have it."""
    sets = g.inverse_sets if inverse else g.characteristic_sets
    return sets.groupBy("cs").agg(F.count(F.lit(1)).alias("n")).select(F.array_join("cs", " ").alias("cs"), _long(F.size("cs")).alias("size"), "n")


def set_size_quantiles(g: Graph, inverse: bool = False) -> DataFrame:
    """Quantile function of the set sizes over the vertices."""
    return _set_sizes(g, "subj" if inverse else "obj").agg(*fits.quantiles(F.col("size")))


def set_frequency_powerlaw(g: Graph, inverse: bool = False) -> DataFrame:
    x = set_frequencies(g, inverse).withColumn("all", F.lit(1))
    return fits.power_fit(x, "n", ["all"], pin_low=False).select("n", "lo", "hi", "alpha")


def two_step_pairs(g: Graph) -> DataFrame:
    """``(q, p, n)``: paths that enter a vertex by q and leave it by p, with multiplicity.

    Both sides are counted per vertex before they meet, so a hub contributes one
    row per pair of relations and not one per path.
    """
    into = g.edges.filter(~F.col("o_is_literal")).groupBy(F.col("o").alias("x"), F.col("p").alias("q")).agg(F.count(F.lit(1)).alias("ci"))
    out = g.edges.groupBy(F.col("s").alias("x"), "p").agg(F.count(F.lit(1)).alias("co"))
    return into.join(out, "x").groupBy("q", "p").agg(F.sum(F.col("ci") * F.col("co")).alias("n"))


def two_step_top(g: Graph, k: int = 20) -> DataFrame:
    """The k most frequent pairs, ties by name."""
    return two_step_pairs(g).orderBy(F.desc("n"), "q", "p").limit(k)


def two_step_powerlaw(g: Graph) -> DataFrame:
    return fits.power_fit(two_step_pairs(g).withColumn("all", F.lit(1)).withColumnRenamed("n", "c"), "c", ["all"], pin_low=False).select("n", "lo", "hi", "alpha")
