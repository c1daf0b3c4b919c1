"""Connected components by contraction.

Each round every vertex points to the neighbour (or itself) that comes first in a
pseudo-random order of the vertices, and the graph shrinks to what is pointed at.
The random order makes the number of vertices fall by a constant factor whatever
the shape, so long paths take a logarithmic number of rounds; edges inside one
image vanish.  Every aggregate combines before its shuffle, and the joins are
plain equi-joins that AQE can split where a hub makes them uneven.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Cut the lineage through a table in the folder that the session names.

    ``checkpoint()`` would compute the rows twice, once to count and once to write;
    a Parquet table is written in one pass and read back by column.  With ``tidy`` the
    shuffle files behind it are deleted once it is written, not when the driver collects its garbage.
    """
    from ..plans.session import scratch

    path, conf, name = scratch(df.sparkSession), df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true" if tidy else before)
    try:
        df.write.parquet(path)
    finally:
        conf.set(name, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """``(id, component)`` for each vertex of ``edges(u, v)``; the component is its smallest id.

    Self-loops, repeated and reversed edges are harmless; null ends are dropped.
    """
    edges = edges.select("u", "v").dropna()
    seen = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    edges = cut(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
        first = both.groupBy("u").agg(F.min(order("v")).alias("n")).select(F.col("u").alias("at"), F.least("n", order("u")).alias("n"))
        first = cut(first.select("at", F.col("n.to").alias("to")))
        if found is None:
            found = first.select(F.col("at").alias("id"), F.col("to").alias("rep"))
        else:
            found = found.join(first, found.rep == first["at"], "left").select("id", F.coalesce("to", "rep").alias("rep"))
        a, b = first.select(F.col("at").alias("u"), F.col("to").alias("x")), first.select(F.col("at").alias("v"), F.col("to").alias("y"))
        edges = cut(edges.join(a, "u").join(b, "v").filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
    if found is None:
        return seen.select("id", F.col("id").alias("component"))
    found = cut(found)
    least = found.groupBy("rep").agg(F.min("id").alias("component"))
    found = found.join(least, "rep").select("id", "component")
    return seen.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
