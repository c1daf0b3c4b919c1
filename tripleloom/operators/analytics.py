"""Studies over graphs and logs: overlap, reciprocity, swap logs, sweeps, principal components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from . import measures
from .ranks import numbered


def overlap(g: Graph) -> DataFrame:
    """Content edges, their directed and undirected pairs, shares of parallel and mutual pairs, and rho, edges per undirected pair."""
    d = g.content.groupBy("s", "o").agg(F.count(F.lit(1)).alias("n"))
    u = d.groupBy(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.sum((F.col("n") > 1).cast("long")).alias("parallel"))
    x = u.agg(F.sum("n").alias("n_edges"), F.sum("d").alias("n_directed"), F.count(F.lit(1)).alias("n_undirected"), F.sum("parallel").alias("n_parallel"), F.sum((F.col("d") > 1).cast("long")).alias("n_mutual"))
    return x.select("n_edges", "n_directed", "n_undirected", (F.col("n_parallel") / F.col("n_directed")).alias("parallel_frac"), (F.col("n_mutual") / F.col("n_undirected")).alias("mutual_frac"), (F.col("n_edges") / F.col("n_undirected")).alias("rho"))


def set_symmetry(g: Graph) -> DataFrame:
    """Per relation: how alike its subjects and objects are as sets (Jaccard), beside its reciprocity."""
    c = g.content
    ends = c.select("p", F.col("s").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(c.select("p", "o", F.lit(0), F.lit(1)))
    per = ends.groupBy("p", "x").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    j = per.groupBy("p").agg(F.sum(F.col("a") * F.col("b")).alias("n_both"), F.count(F.lit(1)).alias("n_any"))
    return j.join(measures.reciprocity(g), "p").select("p", "n_both", "n_any", (F.col("n_both") / F.col("n_any")).alias("jaccard"), "reciprocity")


def symmetry_summary(g: Graph) -> DataFrame:
    """Mean and median of :func:`set_symmetry` over the relations."""
    x = set_symmetry(g)
    return x.agg(F.count(F.lit(1)).alias("n_relations"), *(f(c).alias(f"{n}_{c}") for c in ("jaccard", "reciprocity") for n, f in (("mean", F.avg), ("median", lambda c: F.percentile(c, 0.5)))))


def relation_cooverlap(g: Graph) -> DataFrame:
    """``(p, q, jaccard)``: overlap of the pair sets of two relations, for those that share a pair."""
    c = g.content
    n = c.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    both = c.join(c.select(F.col("p").alias("q"), "s", "o"), ["s", "o"]).filter("p < q").groupBy("p", "q").agg(F.count(F.lit(1)).alias("k"))
    return both.join(n.toDF("p", "np"), "p").join(n.toDF("q", "nq"), "q").select("p", "q", (F.col("k") / (F.col("np") + F.col("nq") - F.col("k"))).alias("jaccard"))


def swap_metrics(log: DataFrame, value: str, by: list[str], accepted: str | None = None) -> DataFrame:
    """Per group of a log of changes: rows, share of zeros, mean, median, 90th percentile and largest magnitude, and what share of all change the largest 1 % and 10 % make.

    With ``accepted``, the name of a boolean column, also the share of rows that it holds for.
    """
    x = log.select(*by, F.abs(F.col(value)).cast("double").alias("m"), *([F.col(accepted).cast("double").alias("ok")] if accepted else []))
    x = numbered(x, [F.desc("m")], by).join(x.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    top = lambda q: F.sum(F.when(F.col("rank") <= F.ceil(F.col("n") * q), F.col("m")))
    at = lambda r: F.max(F.when(F.col("n") - F.col("rank") == r, F.col("m")))

    def quantile(q: float) -> F.Column:  # between the two places from below
        place = (F.col("n") - 1) * F.lit(q)
        low = F.floor(place)
        return at(low) + (at(F.least(low + 1, F.col("n") - 1)) - at(low)) * F.max(place - low)

    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg((F.col("m") == 0).cast("double")).alias("zero_share"), F.avg("m").alias("mean_abs"), quantile(0.5).alias("median_abs"), quantile(0.9).alias("p90_abs"),
        F.max("m").alias("max_abs"), (top(0.01) / F.sum("m")).alias("top1_share"), (top(0.1) / F.sum("m")).alias("top10_share"), *([F.avg("ok").alias("accept_rate")] if accepted else []),
    )


def signed_log_bins(df: DataFrame, value: str, per_decade: int = 4) -> DataFrame:
    """``(bin, n)``: counts by sign and logarithmic size; zero has a bin of its own."""
    v = F.col(value)
    b = F.when(v == 0, 0).otherwise(F.signum(v) * (F.floor(F.log10(F.abs(v)) * per_decade) + 1000)).cast("long")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histograms(table: DataFrame) -> DataFrame:
    """``(feature, bin, n, missing)`` of a feature table, with as many bins as Sturges' rule gives for each feature."""
    v = F.when(~F.isnan("value"), F.col("value"))
    lim = table.groupBy("feature").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("k"), F.sum(F.when(v.isNull(), 1).otherwise(0)).alias("missing"))
    bins = F.ceil(F.log2("k") + 1)
    x = table.filter(v.isNotNull()).join(F.broadcast(lim), "feature")
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), bins - 1)).otherwise(0).cast("long")
    return x.groupBy("feature", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("missing").alias("missing"))


def sweep_summary(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean and (population) spread over seeds."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"))


def principal_components(df: DataFrame, vector: str, key: str, k: int = 2) -> DataFrame:
    """``(key, pc1, .., pck)``: mean-filled, standardised vectors projected on their first components.

    Each task sums its products into one matrix; only a matrix of the vectors' width
    reaches the driver.  Signs are fixed by the largest loading.
    """
    n_dim = df.select(F.max(F.size(vector))).first()[0] or 0
    cols = [F.element_at(F.col(vector), i + 1).cast("double") for i in range(n_dim)]
    stat = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols))).first()
    z = [(F.coalesce(c, F.lit(stat[f"m{i}"])) - float(stat[f"m{i}"] or 0)) / float(stat[f"s{i}"] or 1.0) for i, c in enumerate(cols)]
    x = df.select(key, F.array(*z).alias("z"))
    from ..plans.session import ship

    ship(df.sparkSession)

    def products(batches):  # one matrix a task
        import pyarrow as pa

        total, n = np.zeros((n_dim, n_dim)), 0
        for b in batches:
            m = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_dim)
            total += m.T @ m
            n += len(m)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "c"])

    sums = x.select("z").mapInArrow(products, "n long, c array<double>").filter("n > 0")
    rows = sums.select("n", F.posexplode("c").alias("at", "v")).groupBy("at").agg((F.sum("v") / F.sum("n")).alias("v")).collect() if n_dim else []
    cov = np.zeros(n_dim * n_dim)
    for r in rows:
        cov[r["at"]] = r["v"]
    _, vec = np.linalg.eigh(cov.reshape(n_dim, n_dim))
    top = vec[:, ::-1][:, :k]
    top = top * np.sign(top[np.abs(top).argmax(0), range(top.shape[1])])
    dot = lambda j: F.aggregate(F.zip_with("z", F.array(*(F.lit(float(t)) for t in top[:, j])), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return x.select(key, *(dot(j).alias(f"pc{j + 1}") for j in range(k)))


def inflation(original: Graph, synthetic: Graph) -> DataFrame:
    """Edges per undirected pair of a graph and of its synthetic twin, their ratio, and the gap relative to the original."""
    a, b = (overlap(g).select(F.col("rho").alias(name), F.col("mutual_frac").alias(f"mutual_{name}"), F.col("parallel_frac").alias(f"parallel_{name}")) for g, name in ((original, "original"), (synthetic, "synthetic")))
    x = a.join(b, F.lit(True))  # a row each
    return x.withColumn("inflation", F.col("synthetic") / F.col("original")).withColumn("rho_gap", (F.col("synthetic") - F.col("original")) / F.col("original"))


def degree_summary(g: Graph, k: int = 10) -> DataFrame:
    """``(side, max_degree, p90, top)`` of the content degrees; ``top`` has the k largest, in order."""
    x = g.content_degrees.select(F.explode(F.array(F.struct(F.lit("out").alias("side"), F.col("dout").alias("d")), F.struct(F.lit("in").alias("side"), F.col("din").alias("d")))).alias("x")).select("x.*")
    by = x.groupBy("side", "d").agg(F.count(F.lit(1)).alias("n"))
    best = numbered(by, [F.desc("d")], ["side"]).filter(F.col("rank") <= k).withColumn("d", F.array_repeat("d", F.least("n", F.lit(k)).cast("int")))
    top = best.groupBy("side").agg(F.slice(F.sort_array(F.flatten(F.collect_list("d")), asc=False), 1, k).alias("top"))
    return x.groupBy("side").agg(F.max("d").alias("max_degree"), F.percentile("d", 0.9).alias("p90")).join(top, "side")


def power_law_trend(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """``(exponent, factor, n)`` of y = factor * x ** exponent over the positive pairs, by least squares of logarithms: noise against degree, say."""
    ok = rows.filter((F.col(x) > 0) & (F.col(y) > 0)).select(*(by or []), F.log(F.col(x).cast("double")).alias("lx"), F.log(F.col(y).cast("double")).alias("ly"))
    return ok.groupBy(*(by or [])).agg(F.regr_slope("ly", "lx").alias("exponent"), F.exp(F.regr_intercept("ly", "lx")).alias("factor"), F.count(F.lit(1)).alias("n"))
