"""The canonical edge table and its views.

A graph is one DataFrame of distinct triples with the columns ``s``, ``p``, ``o``
and ``o_is_literal``.  A vertex is its plain name: literals with the same text
are one vertex whatever their datatype or language.  All views are lazy plans
over that table, so a measurement reads the columns it needs and no more.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
#: Kinds of vertices by name.
KINDS = 256


class Graph:
    """Distinct triples and the views derived from them."""

    def __init__(self, edges: DataFrame, distinct: bool = False):
        columns = set(edges.columns)
        edges = edges if "o_is_literal" in columns else edges.withColumn("o_is_literal", F.lit(False))
        edges = edges.select("s", "p", "o", "o_is_literal")
        # a name that is a literal in one triple and not in another is one vertex; the first attributes in order stay
        self.edges = edges if distinct else edges.groupBy("s", "p", "o").agg(F.min("o_is_literal").alias("o_is_literal"))

    def persist(self) -> Graph:
        """Keep the edge table for the measurements that follow (spilling to disk)."""
        self.edges = self.edges.persist()
        return self

    def unpersist(self) -> None:
        self.edges.unpersist()

    @cached_property
    def names(self) -> DataFrame:
        """``(name, is_literal)`` of every vertex."""
        subjects = self.edges.select(F.col("s").alias("name"), F.lit(False).alias("is_literal"))
        objects = self.edges.select(F.col("o").alias("name"), F.col("o_is_literal").alias("is_literal"))
        return subjects.union(objects).groupBy("name").agg(F.min("is_literal").alias("is_literal"))

    @cached_property
    def classes(self) -> DataFrame:
        """Targets of rdf:type."""
        return self.edges.filter(F.col("p") == RDF_TYPE).select(F.col("o").alias("name")).distinct()

    @cached_property
    def entities(self) -> DataFrame:
        """Vertices that are neither literals nor classes."""
        return self.names.filter(~F.col("is_literal")).join(self.classes, "name", "left_anti").select("name")

    @cached_property
    def content(self) -> DataFrame:
        """Edges between two different non-literals that don't state a type."""
        return self.edges.filter((F.col("p") != RDF_TYPE) & (F.col("s") != F.col("o")) & ~F.col("o_is_literal")).select("s", "p", "o")

    @cached_property
    def undirected(self) -> DataFrame:
        """``(u, v)`` with u < v: the whole graph without directions, loops and parallels."""
        return self.edges.filter("s <> o").select(F.least("s", "o").alias("u"), F.greatest("s", "o").alias("v")).distinct()

    @cached_property
    def both_ways(self) -> DataFrame:
        """The undirected graph with each edge in both directions."""
        e = self.undirected
        return e.union(e.select("v", "u"))

    @cached_property
    def degrees(self) -> DataFrame:
        """``(name, d)`` in the undirected graph; vertices without edges are absent."""
        return self.both_ways.groupBy(F.col("u").alias("name")).agg(F.count(F.lit(1)).alias("d"))

    @cached_property
    def _simple(self) -> DataFrame:
        """:attr:`undirected`, written down: both the degrees and the numbering read it.

        Names are reversed, for they mostly differ at their ends and sorts compare the first eight bytes by themselves.
        """
        from ..operators.components import checkpointed

        return checkpointed(self.undirected.select(F.reverse("u").alias("u"), F.reverse("v").alias("v")), tidy=True)

    @cached_property
    def ranked(self) -> DataFrame:
        """``(name, d, r)``: vertices numbered from 0 in the order of (degree, name), once for all uses.

        After a global sort the numbers that rise with partition and row are in sort order; they are written down
        because another run could number anew, and closed up (small numbers shuffle in few bytes).
        """
        from ..operators.components import checkpointed

        e = self._simple
        d = e.select(F.col("u").alias("name")).union(e.select("v")).groupBy("name").agg(F.count(F.lit(1)).alias("d")).withColumn("name", F.reverse("name"))
        x = checkpointed(d.orderBy("d", "name").withColumn("r", F.monotonically_increasing_id()), tidy=True)
        sizes = x.groupBy(F.shiftright("r", 33).alias("i")).agg(F.count(F.lit(1)).alias("n")).orderBy("i").collect()  # a row per partition
        ahead, at = [0] * (sizes[-1].i + 1 if sizes else 1), 0
        for row in sizes:
            ahead[row.i], at = at, at + row.n
        self._order = at
        start = F.element_at(F.lit(ahead).cast("array<bigint>"), (F.shiftright("r", 33) + 1).cast("int"))
        return x.withColumn("r", start + F.col("r").bitwiseAND(F.lit((1 << 33) - 1)))

    @property
    def order(self) -> int:
        """Number of vertices with an edge."""
        _ = self.ranked
        return self._order

    @cached_property
    def kinded(self) -> DataFrame:
        """``(a, b, ka, kb)``: :attr:`oriented` with a kind for either end, a number below ``KINDS`` made from the name without its digits.

        Any function of the vertex would do: kinds only rule out what the kinds' own graph (:attr:`kind_pairs`) does not hold.
        """
        from ..operators.components import checkpointed

        r = self.ranked.select(F.reverse("name"), "r")
        kind = lambda c: F.pmod(F.xxhash64(F.translate(c, "0123456789", "")), F.lit(KINDS)).cast("int")
        end = lambda c: F.struct(F.col(f"r{c}").alias("r"), F.col(f"k{c}").alias("k"))
        e = self._simple.join(r.toDF("u", "ru"), "u").withColumn("ku", kind("u")).drop("u").join(r.toDF("v", "rv"), "v").withColumn("kv", kind("v"))
        e = e.select(F.least(end("u"), end("v")).alias("a"), F.greatest(end("u"), end("v")).alias("b"))
        return checkpointed(e.select(F.col("a.r").alias("a"), F.col("b.r").alias("b"), F.col("a.k").alias("ka"), F.col("b.k").alias("kb")), tidy=True)

    @cached_property
    def kind_pairs(self) -> list[tuple[int, int]]:
        """Kinds that an oriented edge joins; at most the square of their number."""
        return [tuple(x) for x in self.kinded.select("ka", "kb").distinct().collect()]

    @cached_property
    def oriented(self) -> DataFrame:
        """``(a, b)``: undirected edges by number, from the lower to the higher end.

        No vertex then has more than about the square root of twice the edges going out, which bounds every wedge join.
        """
        return self.kinded.select("a", "b")

    @cached_property
    def numbered(self) -> DataFrame:
        """``(u, v)``: :attr:`oriented` in both directions."""
        return self.oriented.select(F.col("a").alias("u"), F.col("b").alias("v")).union(self.oriented.select("b", "a"))

    @cached_property
    def content_degrees(self) -> DataFrame:
        """``(name, dout, din)`` of every entity over edges other than rdf:type, zeros included."""
        x = self.edges.filter(F.col("p") != RDF_TYPE)
        ends = x.select(F.col("s").alias("name"), F.lit(1).alias("o_"), F.lit(0).alias("i_")).union(x.select("o", F.lit(0), F.lit(1)))
        n = ends.groupBy("name").agg(F.sum("o_").alias("dout"), F.sum("i_").alias("din"))
        return self.entities.join(n, "name", "left").select("name", F.coalesce("dout", F.lit(0)).alias("dout"), F.coalesce("din", F.lit(0)).alias("din"))

    @cached_property
    def characteristic_sets(self) -> DataFrame:
        """``(name, cs)``: the sorted predicates of each subject."""
        return self.edges.groupBy(F.col("s").alias("name")).agg(F.array_sort(F.collect_set("p")).alias("cs"))

    @cached_property
    def inverse_sets(self) -> DataFrame:
        """``(name, cs)``: the sorted predicates that lead to each non-literal."""
        return self.edges.filter(~F.col("o_is_literal")).groupBy(F.col("o").alias("name")).agg(F.array_sort(F.collect_set("p")).alias("cs"))
