"""Motif counts of the undirected simple graph.

Exact counts up to four vertices are closed forms over triangles, degrees and
shared neighbours, all on edges oriented from lower to higher degree; larger
motifs are enumerated under a degree guard or estimated by colour coding.
Colours and draws are hashes of (seed, colouring, vertex), so results depend on
neither partitioning nor what ran before.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce
from itertools import combinations
from math import comb, factorial
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fits
from ..plans.graph import KINDS, Graph
from .components import checkpointed
from .ranks import numbered

#: Buckets that the running sum of a colouring's counts is cut into.
BUCKETS = 4096
#: Most neighbours of a vertex whose wedges are counted in arrays.
LIGHT = 4000

_zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
_pairs = lambda n: (n * (n - 1) / 2).cast("long")


def kind_legs(pairs: list[tuple[int, int]]) -> tuple[list, list, list]:
    """Of the pairs of kinds on edges, those that can be the edges (x, y), (x, z) and (y, z) of a triangle x < y < z."""
    after, before = {}, {}
    for a, b in pairs:
        after[a], before[b] = after.get(a, 0) | 1 << b, before.get(b, 0) | 1 << a
    two = {a: reduce(or_, (after.get(b, 0) for b in range(bits.bit_length()) if bits >> b & 1), 0) for a, bits in after.items()}
    return ([(a, b) for a, b in pairs if after[a] & after.get(b, 0)], [(a, b) for a, b in pairs if two[a] >> b & 1], [(a, b) for a, b in pairs if before.get(a, 0) & before[b]])


def _of_kinds(df: DataFrame, left: str, right: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """Rows whose kinds are among ``pairs``."""
    codes = F.split(F.lit(",".join(str(a * KINDS + b) for a, b in pairs)), ",").cast("array<int>")
    allowed = df.sparkSession.range(0, 1, 1, 1).select(F.explode(codes).alias("code"))
    return df.join(F.broadcast(allowed), F.col(left) * KINDS + F.col(right) == F.col("code"), "left_semi")


def _closed(g: Graph, rows: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with an edge from number ``a`` to number ``b``; two numbers below 2^31 make one long, which is sorted by radix and shuffled alone."""
    if g.order >= 1 << 31:
        return rows.join(edges.select(a, b), [a, b])
    key, rest = F.shiftleft(a, 32).bitwiseOR(F.col(b)).alias("key"), [c for c in rows.columns if c not in (a, b)]
    found = rows.select(*rest, key).join(edges.select(key), "key")
    return found.select(*rest, F.shiftright("key", 32).alias(a), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias(b))


def triangles(g: Graph) -> DataFrame:
    """``(x, y, z)``: each triangle once, by vertex numbers, ascending.

    Edges and wedges whose kinds occur in no triangle of kinds are left out before anything is shuffled.
    """
    o, (low, long_, far) = g.kinded, kind_legs(g.kind_pairs)
    xy = _of_kinds(o.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("ka").alias("kx"), F.col("kb").alias("ky")), "kx", "ky", low).select("x", "y", "ky")
    xz = _of_kinds(o.select(F.col("a").alias("x"), F.col("b").alias("z"), F.col("ka").alias("kx"), F.col("kb").alias("kz")), "kx", "kz", long_).select("x", "z", "kz")
    yz = _of_kinds(o.select(F.col("a").alias("y"), F.col("b").alias("z"), F.col("ka").alias("ky"), F.col("kb").alias("kz")), "ky", "kz", far).select("y", "z")
    wedge = _of_kinds(xy.join(xz, "x").filter("y < z"), "ky", "kz", far).select("x", "y", "z")
    return _closed(g, wedge, yz, "y", "z").select("x", "y", "z")


def triangle_count(g: Graph) -> DataFrame:
    return triangles(g).agg(F.count(F.lit(1)).alias("triangles"))


def triangles_per_vertex(g: Graph) -> DataFrame:
    """Vertices in a triangle, and in how many."""
    t = triangles(g).select(F.explode(F.array("x", "y", "z")).alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("triangles"))
    return t.join(g.ranked, "r").select("name", "triangles")


def motifs3(g: Graph) -> DataFrame:
    """Edges, triangles and induced paths of three vertices."""
    d = g.degrees.agg(_zero(F.sum(_pairs(F.col("d")))).alias("w"), _zero(F.sum("d") / 2).alias("edges"))
    return triangle_count(g).join(d, F.lit(True)).select("edges", "triangles", (F.col("w") - 3 * F.col("triangles")).alias("wedges"))


def squares(g: Graph, light: int = LIGHT) -> DataFrame:
    """``(squares)``: 4-cycles, induced or not.

    Each is counted at its highest vertex: wedges from it over a lower vertex x to another lower one, w, are grouped
    by their ends.  Where w has at most ``light`` neighbours, x sends all that lies above it in one array, and
    equal ends are counted in the sorted arrays of a w; so a wedge costs four bytes and no row.  The few other w
    take rows that combine before their shuffle, as do all in graphs of 2^31 vertices.
    """
    first = g.order if g.order < 1 << 31 else 0  # the lowest heavy vertex; numbers rise with degrees
    if first:
        first = g.ranked.filter(F.col("d") > light).agg(F.coalesce(F.min("r"), F.lit(first))).first()[0]
    o, both = g.oriented, g.numbered.select(F.col("u").alias("x"), F.col("v").alias("w"))
    wedge = o.select(F.col("a").alias("x"), F.col("b").alias("top")).filter(F.col("top") > first).join(both.filter(F.col("w") >= first), "x").filter("w < top")
    rows = wedge.groupBy("top", "w").agg(F.count(F.lit(1)).alias("n")).select(_pairs(F.col("n")).alias("n"))
    if first:
        above = o.groupBy(F.col("a").alias("x")).agg(F.collect_list(F.col("b").cast("int")).alias("tops"))
        legs = both.filter(F.col("w") < first).join(above, "x").filter(F.array_max("tops") > F.col("w")).select(F.col("w").cast("int").alias("w"), "tops")

        def run(batches):
            import numpy as np
            import pyarrow as pa

            def equal(keys):
                keys.sort()
                at = np.flatnonzero(np.diff(keys, prepend=-1, append=-1))
                n = np.diff(at)
                return int((n * (n - 1) // 2).sum())

            total, open_, last = 0, [], -1  # ``open_``: ends of the last w, whose rows may go on
            for b in batches:
                if not b.num_rows:
                    continue
                w, tops = b.column(0).to_numpy(), b.column(1)
                ends = tops.flatten().to_numpy()
                of = np.repeat(w, tops.value_lengths().to_numpy())
                up = ends > of
                ends, of = ends[up].astype(np.int64), of[up].astype(np.int64)
                keys, newest = of << 32 | ends, int(w[-1])
                ready = np.searchsorted(of, newest)
                if newest != last:
                    total += equal(np.concatenate([*open_, keys[:ready]]))
                    open_, last = [], newest
                open_.append(keys[ready:])
            if open_:
                total += equal(np.concatenate(open_))
            yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64())})

        rows = rows.unionByName(legs.repartition("w").sortWithinPartitions("w").mapInArrow(run, "n long"))
    return rows.agg(_zero(F.sum("n")).alias("squares"))


def motifs4(g: Graph) -> DataFrame:
    """Induced 4-cycles, diamonds, complete graphs and tailed triangles."""
    t = checkpointed(triangles(g), tidy=True)
    by_edge = t.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("x").alias("a"), F.col("z").alias("b")), F.struct(F.col("y").alias("a"), F.col("z").alias("b")))).alias("e"))
    shared = by_edge.groupBy("e").agg(F.count(F.lit(1)).alias("n")).agg(_zero(F.sum(_pairs(F.col("n")))).alias("pairs"))
    o = g.oriented
    two = t.select("x", "y", F.col("z").alias("p")).join(t.select("x", "y", F.col("z").alias("q")), ["x", "y"]).filter("p < q")
    k4 = two.join(o.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"]).agg(F.count(F.lit(1)).alias("k4"))
    corner = t.select(F.explode(F.array("x", "y", "z")).alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("n")).join(g.ranked.select("r", "d"), "r").agg(_zero(F.sum(F.col("n") * F.col("d"))).alias("dsum"))
    n_t = t.agg(F.count(F.lit(1)).alias("t"))
    one = n_t
    for x in (shared, k4, squares(g), corner):  # tables of one row
        one = one.join(x, F.lit(True))
    one = one.withColumn("diamond", F.col("pairs") - 6 * F.col("k4"))
    return one.select(
        (F.col("squares") - F.col("diamond") - 3 * F.col("k4")).alias("four_cycle"), "diamond", "k4",
        (F.col("dsum") - 6 * F.col("t") - 4 * F.col("diamond") - 12 * F.col("k4")).alias("tailed_triangle"),
    )


def stars_triangle_free(g: Graph, largest: int = 10) -> DataFrame:
    """``(k, stars)``: induced stars with k leaves whose centre lies in no triangle."""
    busy = triangles(g).select(F.explode(F.array("x", "y", "z")).alias("r")).distinct()
    calm = g.ranked.select("r", "d").join(busy, "r", "left_anti")
    by_d = calm.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    choose = lambda k: F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(1.0), lambda a, i: a * (F.col("d") - k + i) / i)
    terms = F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.col("d") >= k, F.round(choose(k)) * F.col("n")).otherwise(0.0).alias("c")) for k in range(2, largest + 1)))
    return by_d.select(F.explode(terms).alias("x")).groupBy("x.k").agg(F.sum("x.c").alias("stars"))


def independent_sets(edges: list[tuple[int, int]], free: int, largest: int) -> list[int]:
    """Numbers of independent sets of 0..largest vertices: of a graph, and ``free`` vertices without edges."""
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def times(p: list[int], q: list[int]) -> list[int]:
        return [sum(p[i] * q[n - i] for i in range(n + 1) if i < len(p) and n - i < len(q)) for n in range(min(largest, len(p) + len(q) - 2) + 1)]

    memory: dict[frozenset, list[int]] = {}

    def count(nodes: frozenset) -> list[int]:
        if nodes in memory:
            return memory[nodes]
        out, left = [1], set(nodes)
        while left:  # parts multiply
            part, todo = set(), [left.pop()]
            while todo:
                v = todo.pop()
                part.add(v)
                new = near[v] & left
                left -= new
                todo += new
            if len(part) == 1:
                one = [1, 1]
            else:
                v = max(part, key=lambda u: len(near[u] & part))
                a, b = count(frozenset(part - {v})), count(frozenset(part - {v} - near[v]))
                one = [(a[i] if i < len(a) else 0) + (b[i - 1] if 0 < i <= len(b) else 0) for i in range(min(largest, max(len(a), len(b) + 1) - 1) + 1)]
            out = times(out, one)
        memory[nodes] = out
        return out

    out = times(count(frozenset(near)), [comb(free, i) for i in range(min(free, largest) + 1)])
    return out + [0] * (largest + 1 - len(out))


def estimated_sets(edges: list[tuple[int, int]], free: int, largest: int, draws: int = 400, seed: int = 0) -> list[float]:
    """Unbiased estimates of what :func:`independent_sets` counts.

    A draw adds one vertex after the other, each from those that no earlier one
    touches; the product of their numbers, over k!, is in the mean the number of sets of k.
    """
    import random

    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rng, total = random.Random(seed), [0.0] * (largest + 1)
    for _ in range(draws):
        open_, rest, w = sorted(near), free, 1.0
        for k in range(largest + 1):
            total[k] += w
            n = len(open_) + rest
            if not n:
                break
            w *= n / (k + 1)
            i = rng.randrange(n)
            if i < len(open_):
                gone = near[open_[i]] | {open_[i]}
                open_ = [v for v in open_ if v not in gone]
            else:
                rest -= 1
    return [t / draws for t in total]


def stars(g: Graph, largest: int = 10, guard: int = 60, draws: int = 400) -> DataFrame:
    """``(k, stars, exact)``: induced stars with k leaves.

    A centre in triangles counts the independent sets among its neighbours.  For
    a centre with more than ``guard`` neighbours in triangles, whose sets can be
    exponentially many, their number is estimated from ``draws`` draws, and ``exact`` is false.
    """
    from ..plans.session import ship

    ship(g.edges.sparkSession)
    t = triangles(g)
    corner = F.explode(F.array(*(F.struct(F.col(c).alias("r"), F.col(a).alias("p"), F.col(b).alias("q")) for c, a, b in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))))).alias("e")
    inner = t.select(corner).groupBy("e.r").agg(F.count(F.lit(1)).alias("m"), F.array_size(F.array_union(F.collect_set("e.p"), F.collect_set("e.q"))).alias("core"), F.collect_list(F.struct("e.p", "e.q")).alias("edges"))
    inner = inner.join(g.ranked.select("r", "d"), "r")

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for r, edges, core, d in zip(b["r"], b["edges"], b["core"], b["d"], strict=True):
                pairs, exact = [(e["p"], e["q"]) for e in edges], core <= guard
                n = independent_sets(pairs, int(d - core), largest) if exact else estimated_sets(sorted(pairs), int(d - core), largest, draws, int(r))
                rows += [(k, float(n[k]), exact) for k in range(2, largest + 1)]
            yield pd.DataFrame(rows, columns=["k", "stars", "exact"])

    busy = inner.select("r", "edges", "core", "d").mapInPandas(run, "k int, stars double, exact boolean")
    calm = stars_triangle_free(g, largest).withColumn("exact", F.lit(True))
    return calm.unionByName(busy).groupBy("k").agg(F.sum("stars").alias("stars"), F.min("exact").alias("exact"))


def connected_sets(g: Graph, k: int, max_degree: int = 50) -> DataFrame:
    """``(vs)``: each connected set of k vertices, as a sorted array of numbers.

    Sets grow by a neighbour at a time and are made distinct at each size.  The
    work is edges x degree^(k-2), so a graph beyond ``max_degree`` raises.
    """
    top = g.degrees.agg(F.max("d")).first()[0] or 0
    if top > max_degree:
        raise RuntimeError(f"largest degree {top} is above the guard of {max_degree}")
    sets = g.oriented.select(F.array("a", "b").alias("vs")) if k > 1 else g.ranked.select(F.array("r").alias("vs"))
    near = g.numbered
    for _ in range(k - 2):
        grown = sets.select("vs", F.explode("vs").alias("u")).join(near, "u").filter(~F.array_contains("vs", F.col("v")))
        sets = checkpointed(grown.select(F.array_sort(F.array_append("vs", F.col("v"))).alias("vs")).distinct())
    return sets


def _degree_sequences(g: Graph, sets: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """``sets`` (with ``vs``) and ``ds``, the sorted degrees inside each set, as text."""
    at = [F.struct(F.element_at("vs", i + 1).alias("a"), F.element_at("vs", j + 1).alias("b"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in combinations(range(k), 2)]
    x = sets.select(*keep, F.explode(F.array(*at)).alias("e")).select(*keep, F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"), "e.i", "e.j").join(g.oriented, ["a", "b"])
    degree = lambda i: F.sum(((F.col("i") == i) | (F.col("j") == i)).cast("int"))
    return x.groupBy(*keep).agg(F.array_join(F.array_sort(F.array(*map(degree, range(k)))), ",").alias("ds"))


def graphlets(g: Graph, k: int, max_degree: int = 50) -> DataFrame:
    """``(ds, n)``: connected induced subgraphs of k vertices by their sorted degrees."""
    if k == 1:
        return g.ranked.agg(F.count(F.lit(1)).alias("n")).select(F.lit("0").alias("ds"), "n")
    return _degree_sequences(g, connected_sets(g, k, max_degree), k, ["vs"]).groupBy("ds").agg(F.count(F.lit(1)).alias("n"))


def cycles(g: Graph, k: int, max_degree: int = 50) -> DataFrame:
    """Induced cycles of k vertices, exact under the guard."""
    return graphlets(g, k, max_degree).filter(F.col("ds") == ",".join("2" * k)).agg(_zero(F.sum("n")).alias("cycles"))


#: Directed spanning paths of a graphlet, by its sorted degrees (fixed values, checked by enumeration in the tests).
SPANNING_PATHS = {"2,2,2": 6, "1,1,2,2": 2, "2,2,2,2": 8, "1,2,2,3": 4, "2,2,3,3": 12, "3,3,3,3": 24, "2,2,2,2,2": 10, "2,2,2,2,2,2": 12}


def _hash01(*parts: object) -> F.Column:
    """A uniform number in (0, 1) from md5 of the parts joined by colons; the same in any SQL engine."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, F.Column) else F.lit(str(p)) for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def coloured(g: Graph, k: int, colourings: int = 1, seed: int = 0) -> DataFrame:
    """``(c, r, bit)``: a colour for each vertex in each colouring, as a bit."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("c").cast("string"), "name")
    colour = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % k
    x = g.ranked.select("name", "r").withColumn("c", F.explode(F.array(*map(F.lit, range(colourings)))))
    return x.select("c", "r", F.expr("1").cast("int").alias("one"), colour.cast("int").alias("colour")).select("c", "r", F.expr("shiftleft(one, colour)").alias("bit"))


def path_counts(g: Graph, k: int, colourings: int = 1, seed: int = 0) -> tuple[list[DataFrame], DataFrame]:
    """Colourful paths: for each length ``(c, v, mask, n)``, the number that end at v with these colours; and the colours."""
    col = checkpointed(coloured(g, k, colourings, seed))
    levels = [col.select("c", F.col("r").alias("v"), F.col("bit").alias("mask"), F.lit(1.0).alias("n"))]
    near = g.numbered
    for _ in range(k - 1):
        last = levels[-1]
        step = last.select("c", F.col("v").alias("u"), "mask", "n").join(near, "u").join(col.select("c", F.col("r").alias("v"), "bit"), ["c", "v"])
        step = step.filter(F.col("mask").bitwiseAND(F.col("bit")) == 0)
        levels.append(checkpointed(step.groupBy("c", "v", F.col("mask").bitwiseOR(F.col("bit")).alias("mask")).agg(F.sum("n").alias("n"))))
    return levels, col


def colourful_total(g: Graph, k: int, colourings: int = 1, seed: int = 0) -> DataFrame:
    """Colourful directed paths of k vertices in each colouring, and what they estimate: all directed paths of k vertices."""
    levels, _ = path_counts(g, k, colourings, seed)
    p = factorial(k) / k**k
    return levels[-1].groupBy("c").agg(F.sum("n").alias("total")).select(F.col("c").alias("colouring"), "total", (F.col("total") / p).alias("paths"))


def colour_coding(g: Graph, k: int, samples: int = 1000, colourings: int = 4, seed: int = 0, diamond_paths: int = 12) -> DataFrame:
    """``(ds, estimate, ham_path_weight)``: graphlets of k vertices by their sorted degrees, estimated.

    In each colouring ``samples`` colourful paths are drawn uniformly by walking
    back through the counts (a draw is a place on the running sum of the counts, found by a join on ranges); a graphlet's share, scaled by the total, the chance of
    being colourful and its number of spanning paths, estimates its count.  For
    graphlets whose spanning paths are not tabled the weight stays undivided, as
    ``ham_path_weight`` says.  ``diamond_paths`` of 8 repeats the published, biased numbers.
    """
    levels, col = path_counts(g, k, colourings, seed)
    total = levels[-1].groupBy("c").agg(F.sum("n").alias("t"))
    spark = g.edges.sparkSession
    # draws and running sums meet by the bucket of the sum that they lie in
    place = lambda step: _hash01(seed, step, F.col("c"), F.col("sid"))
    bucket = lambda x: F.least(F.floor(x * BUCKETS), F.lit(BUCKETS - 1))
    draws = spark.range(samples * colourings).select((F.col("id") % colourings).cast("int").alias("c"), F.floor(F.col("id") / colourings).alias("sid"))
    draws = draws.withColumn("y", place("end")).withColumn("bucket", bucket(F.col("y")))
    sums = numbered(levels[-1], ["v", "mask"], ["c"], F.col("n")).join(F.broadcast(total), "c")
    sums = sums.withColumn("lo", F.col("before") / F.col("t")).withColumn("hi", (F.col("before") + F.col("n")) / F.col("t"))
    sums = sums.select("c", "v", "mask", "lo", "hi", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))).alias("bucket"))
    walk = draws.join(sums, ["c", "bucket"]).filter("lo <= y and y < hi").select("c", "sid", "v", "mask", F.array("v").alias("vs"))
    near = g.numbered
    for i in range(k - 2, -1, -1):
        rest = walk.join(col.select("c", F.col("r").alias("v"), "bit"), ["c", "v"]).withColumn("mask", F.col("mask").bitwiseXOR(F.col("bit"))).drop("bit")
        rest = checkpointed(rest.withColumnRenamed("v", "w").withColumn("y", place(i)))
        # the ways back from each place that a walk stands at, once however many stand there
        state = ["c", "w", "mask"]
        ways = rest.select(*state).distinct().join(near.select(F.col("u").alias("w"), "v"), "w").join(levels[i], ["c", "v", "mask"])
        by = Window.partitionBy(*state)
        ways = ways.withColumn("t", F.sum("n").over(by)).withColumn("hi", F.sum("n").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
        ways = ways.select(*state, "v", ((F.col("hi") - F.col("n")) / F.col("t")).alias("lo"), (F.col("hi") / F.col("t")).alias("hi"))
        walk = rest.join(ways, state).filter("lo <= y and y < hi").select("c", "sid", "v", "mask", F.array_append("vs", F.col("v")).alias("vs"))
    walk = checkpointed(walk.select("c", "sid", "vs"))
    drawn = walk.groupBy("c").agg(F.count(F.lit(1)).alias("drawn"))
    kinds = _degree_sequences(g, walk, k, ["c", "sid", "vs"]).groupBy("c", "ds").agg(F.count(F.lit(1)).alias("m"))
    table = F.create_map(*(F.lit(x) for ds, n in SPANNING_PATHS.items() for x in (ds, diamond_paths if ds == "2,2,3,3" else n)))
    sigma = F.try_element_at(table, F.col("ds"))
    weight = F.col("m") / F.col("drawn") * F.col("t") / (factorial(k) / k**k)
    per = kinds.join(total, "c").join(drawn, "c").select("ds", (weight / F.coalesce(sigma, F.lit(1))).alias("e"), sigma.isNull().alias("raw"))
    return per.groupBy("ds").agg((F.sum("e") / colourings).alias("estimate"), F.max("raw").alias("ham_path_weight"))


def colour_coding_stars(g: Graph, k: int, samples: int = 1000, colourings: int = 4, seed: int = 0) -> DataFrame:
    """``(k, estimate)``: induced stars with k leaves, estimated by colourings with k + 1 colours.

    The product of a centre's neighbours by colour counts its colourful stars;
    drawn stars whose leaves are not adjacent give the induced share.
    """
    col = checkpointed(coloured(g, k + 1, colourings, seed))
    near = g.numbered.join(col.select("c", F.col("r").alias("v"), F.col("bit").alias("leaf")), "v").join(col.select("c", F.col("r").alias("u"), F.col("bit").alias("own")), ["c", "u"]).filter("leaf <> own")
    by_colour = checkpointed(near.groupBy("c", "u", "leaf").agg(F.count(F.lit(1)).alias("m")))
    centre = checkpointed(by_colour.groupBy("c", "u").agg(F.count(F.lit(1)).alias("colours"), F.exp(F.sum(F.log(F.col("m").cast("double")))).alias("n")).filter(F.col("colours") == k))
    total = centre.groupBy("c").agg(F.sum("n").alias("t"))
    bucket = lambda x: F.least(F.floor(x * BUCKETS), F.lit(BUCKETS - 1))
    draws = g.edges.sparkSession.range(samples * colourings).select((F.col("id") % colourings).cast("int").alias("c"), F.floor(F.col("id") / colourings).alias("sid"))
    draws = draws.withColumn("y", _hash01(seed, "star", F.col("c"), F.col("sid"))).withColumn("bucket", bucket(F.col("y")))
    sums = numbered(centre, ["u"], ["c"], F.col("n")).join(F.broadcast(total), "c")
    sums = sums.select("c", "u", (F.col("before") / F.col("t")).alias("lo"), ((F.col("before") + F.col("n")) / F.col("t")).alias("hi"))
    drawn = draws.join(sums.withColumn("bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi"))))), ["c", "bucket"]).filter("lo <= y and y < hi").select("c", "sid", "u")
    leaf = near.join(drawn, ["c", "u"]).groupBy("c", "sid", "leaf").agg(F.min_by("v", _hash01(seed, "leaf", F.col("c"), F.col("sid"), F.col("v"))).alias("v"))
    leaves = checkpointed(leaf.groupBy("c", "sid").agg(F.collect_list("v").alias("vs")))
    pairs = leaves.select("c", "sid", F.explode("vs").alias("a"), "vs").select("c", "sid", "a", F.explode("vs").alias("b")).filter("a < b").join(g.oriented, ["a", "b"]).select("c", "sid").distinct()
    share = leaves.join(pairs.withColumn("bad", F.lit(1)), ["c", "sid"], "left").groupBy("c").agg(F.avg(F.col("bad").isNull().cast("double")).alias("good"))
    p = factorial(k + 1) / (k + 1) ** (k + 1)
    # every star is seen from its one centre
    return total.join(share, "c").agg((F.coalesce(F.sum(F.col("t") * F.col("good")), F.lit(0.0)) / p / colourings).alias("estimate")).select(F.lit(k).alias("k"), "estimate")


class Counter(ABC):
    """A way to count the graphlets of k vertices: ``(ds, n, exact)``."""

    @abstractmethod
    def count(self, g: Graph, k: int) -> DataFrame: ...


class ExactCounter(Counter):
    """Enumeration; a graph above the degree guard raises."""

    def __init__(self, max_degree: int = 50):
        self.max_degree = max_degree

    def count(self, g: Graph, k: int) -> DataFrame:
        return graphlets(g, k, self.max_degree).select("ds", F.col("n").cast("double").alias("n"), F.lit(True).alias("exact"))


class SampledCounter(Counter):
    """Colour coding; with ``adaptive`` the number of draws follows the graph's size."""

    def __init__(self, samples: int = 100_000, colourings: int = 16, seed: int = 0, adaptive: bool = False):
        self.samples, self.colourings, self.seed, self.adaptive = samples, colourings, seed, adaptive

    def count(self, g: Graph, k: int) -> DataFrame:
        samples = adaptive_samples(self.samples, g.ranked.count()) if self.adaptive else self.samples
        x = colour_coding(g, k, samples, self.colourings, self.seed)
        return x.select("ds", F.round("estimate").alias("n"), F.lit(False).alias("exact")).filter("n > 0")


class HybridCounter(Counter):
    """Enumeration up to ``exact_up_to`` vertices under the guard, colour coding else."""

    def __init__(self, max_degree: int = 50, exact_up_to: int = 6, sampled: SampledCounter | None = None):
        self.exact, self.exact_up_to, self.sampled = ExactCounter(max_degree), exact_up_to, sampled or SampledCounter()

    def count(self, g: Graph, k: int) -> DataFrame:
        top = g.degrees.agg(F.max("d")).first()[0] or 0
        return self.exact.count(g, k) if k <= self.exact_up_to and top <= self.exact.max_degree else self.sampled.count(g, k)


def adaptive_samples(base: int, vertices: int) -> int:
    """Number of draws for a graph: twenty per vertex, at least 500, at most five times the base."""
    return max(500, min(20 * vertices, 5 * base))


def template_stats(histogram: DataFrame, count: str = "n") -> DataFrame:
    """``(zipf, entropy)`` of the counts of types."""
    x = histogram.select(F.col(count).cast("double").alias("n"))
    x = x.join(F.broadcast(x.agg(F.sum("n").alias("all"))), F.lit(True)).withColumn("share", F.col("n") / F.col("all"))
    return x.agg(fits.zipf_mle(F.col("n")).alias("zipf"), fits.entropy(F.col("share")).alias("entropy"))
