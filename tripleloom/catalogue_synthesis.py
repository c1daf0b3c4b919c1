"""Queries for comparison, transformation, synthesis, studies and streams.

Their inputs are derived from the star tables: a corpus with a "graph" for each
nation, whose features are statistics of its customers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import ORACLES, VIEWS_SQL, add, category, star
from .functions import fits
from .functions.uniform import uniform, uniform_sql
from .generator import allocation, rewire, schema, wiring
from .operators import analytics, compare, signature, transform
from .sources.tables import CATEGORY_SQL, STAR_SQL, category_graph, star_graph

_CS = [f"cs_size_{s}" for s in fits.SUFFIXES]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(graph, feature, value)``: eleven features for each nation."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    x = F.abs("c_acctbal") / 1000
    q = F.percentile(x + 1, F.array(*map(F.lit, fits.LEVELS)))
    a = c.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).cast("double").alias("num_entities"), (F.avg(x) + 1).alias("mean_degree"), F.avg((F.col("c_mktsegment") == "BUILDING").cast("double")).alias("type_edge_frac"),
        (F.avg((F.col("c_acctbal") > 0).cast("double")) * 2 - 1).alias("degree_assortativity"), *(F.element_at(q, i + 1).alias(n) for i, n in enumerate(_CS)),
    )
    names = [n for n in a.columns if n != "c_nationkey"]
    return a.select(F.concat(F.lit("nation/"), "c_nationkey").alias("graph"), F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.round(n, 4).alias("value")) for n in names))).alias("x")).select("graph", "x.*")


_Q = "c_acctbal"
_PER = ", ".join(
    ["count(*)::DOUBLE AS num_entities", "avg(abs(c_acctbal) / 1000) + 1 AS mean_degree", "avg((c_mktsegment = 'BUILDING')::INT::DOUBLE) AS type_edge_frac", "avg((c_acctbal > 0)::INT::DOUBLE) * 2 - 1 AS degree_assortativity"]
    + [f"quantile_cont((abs(c_acctbal) / 1000 + 1)::DOUBLE, {level}) AS {n}" for level, n in zip(fits.LEVELS, _CS, strict=True)])
_NAMES = ["num_entities", "mean_degree", "type_edge_frac", "degree_assortativity", *_CS]
CORPUS_SQL = f"per AS (SELECT 'nation/' || c_nationkey AS graph, {_PER} FROM customer GROUP BY c_nationkey),\ncorpus AS (" + " UNION ALL ".join(f"SELECT graph, '{n}' AS feature, round({n}, 4) AS value FROM per" for n in _NAMES) + ")"

# --- Transforms --------------------------------------------------------------

SPECS = {"mean_degree": transform.Spec(levels=(0.5, 2.0)), "type_edge_frac": transform.Spec("normal", 0.1, levels=(-0.3, 0.9)), "cs_size_q50": transform.Spec(levels=(0.1, 1.5)), "cs_size_q90": transform.Spec(levels=(9.0,))}
_DOMAIN = "CASE feature WHEN 'num_entities' THEN greatest(1.0, round_even(raw, 0)) WHEN 'degree_assortativity' THEN least(1.0, greatest(-1.0, raw)) ELSE greatest(0.0, raw) END"
_LEVELS_SQL = f"""WITH {CORPUS_SQL},
plan(unit, name, level) AS (VALUES (0, NULL, NULL), (1, 'mean_degree', 0.5), (2, 'mean_degree', 2.0), (3, 'type_edge_frac', -0.3), (4, 'type_edge_frac', 0.9), (5, 'cs_size_q50', 0.1), (6, 'cs_size_q50', 1.5)),
hit AS (SELECT graph, feature, value, unit, level, name,
  name IS NOT NULL AND (feature = name OR (name = 'cs_size_q50' AND feature LIKE 'cs_size_q%')) AS moved FROM corpus CROSS JOIN plan),
made AS (SELECT graph, unit, feature, value, moved, CASE WHEN moved AND name = 'type_edge_frac' THEN value + level WHEN moved THEN value * level END AS raw FROM hit)"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.perturb_levels(corpus(spark, sf_dir), SPECS)


add("t_perturb_levels", lambda s, d: _levels(s, d).select("graph", "unit", "feature", "value", "moved", "clamped"), f"""{_LEVELS_SQL}
SELECT graph, unit::BIGINT AS unit, feature, round(CASE WHEN moved THEN {_DOMAIN} ELSE value END, 6) + 0.0 AS value, moved, coalesce(moved AND raw <> {_DOMAIN} AND feature <> 'num_entities', FALSE) AS clamped FROM made""")
add("t_clamp_report", lambda s, d: transform.clamp_report(_levels(s, d), ["graph", "unit"]), f"""{_LEVELS_SQL}
SELECT graph, unit::BIGINT AS unit, CASE WHEN feature LIKE 'cs_size_q%' THEN 'cs_size_q00' ELSE feature END AS grp, count(*) AS members,
  round(avg((raw <> {_DOMAIN})::INT::DOUBLE), 6) AS absorbed, avg((raw <> {_DOMAIN})::INT::DOUBLE) > 0.5 AS saturated FROM made WHERE moved GROUP BY 1, 2, 3""")
add("t_ofat_plan", lambda s, d: transform.ofat_plan(s, SPECS), """
SELECT * FROM (VALUES (0::BIGINT, NULL, NULL::DOUBLE, 'baseline'), (1, 'mean_degree', 0.5, 'mean_degree*0.5'), (2, 'mean_degree', 2.0, 'mean_degree*2'), (3, 'type_edge_frac', -0.3, 'type_edge_frac+-0.3'),
(4, 'type_edge_frac', 0.9, 'type_edge_frac+0.9'), (5, 'cs_size_q50', 0.1, 'cs_size_q50*0.1'), (6, 'cs_size_q50', 1.5, 'cs_size_q50*1.5')) t(unit, name, level, label)""")
_KNOB = "graph || '#' || copy || ':' || CASE WHEN feature LIKE 'cs_size_q%' THEN 'cs_size_q50' ELSE feature END"
_Z = f"sqrt(-2 * ln({uniform_sql(1, _KNOB + " || ':a'")})) * cos(2 * pi() * {uniform_sql(1, _KNOB + " || ':b'")})"
add("t_perturb_joint", lambda s, d: transform.perturb(corpus(s, d), SPECS, 2, seed=1).select("graph", "copy", "feature", "value", "clamped"), f"""WITH {CORPUS_SQL},
made AS (SELECT graph, copy, feature, value, feature IN ('mean_degree', 'type_edge_frac') OR feature LIKE 'cs_size_q%' AS moved,
  CASE WHEN feature = 'type_edge_frac' THEN value + 0.1 * {_Z} ELSE value * exp(0.1 * {_Z}) END AS raw FROM corpus CROSS JOIN (VALUES (0), (1)) c(copy))
SELECT graph, copy::BIGINT AS copy, feature, round(CASE WHEN moved THEN {_DOMAIN} ELSE value END, 6) + 0.0 AS value, moved AND raw < 0 AS clamped FROM made""")


def _unrealisable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose sets are made more than their entities, whose degree vanishes or whose quantiles are turned round."""
    c = corpus(spark, sf_dir)
    more = c.filter("feature = 'num_entities'").select("graph", F.lit("num_distinct_cs").alias("feature"), (F.lit(2.0) * F.col("value") - 60).alias("value"))
    x = c.withColumn("value", F.when((F.col("feature") == "mean_degree") & F.col("graph").endswith("1"), F.lit(0.0)).when((F.col("feature") == "cs_size_q25") & F.col("graph").endswith("2"), F.col("value") + 20).otherwise(F.col("value")))
    return transform.realisable(x.unionByName(more))


add("t_realisable", _unrealisable, f"""WITH {CORPUS_SQL}
SELECT graph, 'num_distinct_cs' AS reason FROM corpus WHERE feature = 'num_entities' AND 2 * value - 60 > value
UNION ALL SELECT graph, 'mean_degree' FROM corpus WHERE feature = 'num_entities' AND graph LIKE '%1'
UNION ALL SELECT a.graph, 'cs_size' FROM corpus a JOIN corpus b USING (graph) WHERE a.feature = 'cs_size_q25' AND b.feature = 'cs_size_q50' AND graph LIKE '%2' AND a.value + 20 > b.value""")
_DRAW = uniform_sql(7, "copy || ':' || feature")
add("s_uniform_range_sampler", lambda s, d: transform.uniform_range(corpus(s, d), 3, seed=7).filter(F.col("value").isNotNull() & (F.col("feature") != "num_classes")), f"""WITH {CORPUS_SQL},
lim AS (SELECT feature, min(value) AS a, max(value) AS b FROM corpus GROUP BY feature),
v AS (SELECT copy, feature, a - 0.1 * (b - a) + {_DRAW} * (b - a + 0.2 * (b - a)) AS raw FROM lim CROSS JOIN (VALUES (0), (1), (2)) c(copy))
SELECT copy::BIGINT AS copy, feature, round({_DOMAIN}, 6) + 0.0 AS value FROM v""")

# --- Distances -----------------------------------------------------------------


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation against the mean of all."""
    c = corpus(spark, sf_dir)
    mean = c.groupBy("feature").agg(F.avg("value").alias("target"))
    x = c.join(mean, "feature").withColumnRenamed("value", "achieved")
    return x.withColumn("relative_error", F.abs(F.col("target") - F.col("achieved")) / F.greatest(F.abs("target"), F.lit(1e-9))).withColumn("block", F.when(F.col("feature").startswith("cs_"), F.lit("d")).when(F.col("feature") == "degree_assortativity", F.lit("f")).otherwise(F.lit("a")))


_ERR_SQL = f"""WITH {CORPUS_SQL}, m AS (SELECT feature, avg(value) AS target FROM corpus GROUP BY feature),
e AS (SELECT graph, feature, abs(target - value) / greatest(abs(target), 1e-9) AS relative_error, CASE WHEN feature LIKE 'cs_%' THEN 'd' WHEN feature = 'degree_assortativity' THEN 'f' ELSE 'a' END AS block FROM corpus JOIN m USING (feature))"""
add("x_error_pool", lambda s, d: compare.error_pool(_errors(s, d)), f"""{_ERR_SQL}
SELECT block, {", ".join(f"round(quantile_cont(relative_error, {q}), 6) + 0.0 AS {n}" for n, q in (("low", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1.0)))}, count(*) AS n FROM e GROUP BY block""")
add("x_error_summary", lambda s, d: compare.summary(_errors(s, d), ["graph"]), f"""{_ERR_SQL}
SELECT graph, count(relative_error) AS n, round(avg(relative_error), 6) AS mean_error, round(quantile_cont(relative_error, 0.5), 6) AS median_error, round(max(relative_error), 6) AS max_error FROM e GROUP BY graph""")


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = corpus(spark, sf_dir)
    return c.filter("graph = 'nation/0'").select("feature", "value"), c.filter("graph = 'nation/1'").select("feature", "value")


add("x_relative_error", lambda s, d: compare.relative_errors(*_two(s, d)), f"""WITH {CORPUS_SQL}
SELECT feature, round(a.value, 6) AS target, round(b.value, 6) AS achieved, round(abs(a.value - b.value) / greatest(abs(a.value), 1e-9), 6) AS relative_error
FROM (SELECT * FROM corpus WHERE graph = 'nation/0') a FULL JOIN (SELECT * FROM corpus WHERE graph = 'nation/1') b USING (feature)""")


def _quantile_fits(spark: SparkSession, sf_dir: str, nation: str) -> DataFrame:
    c = corpus(spark, sf_dir).filter((F.col("graph") == nation) & F.col("feature").startswith("cs_size_"))
    return c.groupBy().pivot("feature", _CS).agg(F.first("value")).select(F.lit("cs_size").alias("name"), *(F.col(n).alias(s) for n, s in zip(_CS, fits.SUFFIXES, strict=True)))


def _interp_sql(g: str) -> str:
    cases = " ".join(f"WHEN u <= {b} THEN {p} + (u - {a}) / {b - a} * ({q} - {p})" for a, b, p, q in zip(fits.LEVELS, fits.LEVELS[1:], _CS, _CS[1:], strict=False))
    return f"SELECT x, row_number() OVER (ORDER BY x) AS r FROM (SELECT CASE {cases} END AS x FROM u CROSS JOIN (SELECT {', '.join(f'round({c}, 4) AS {c}' for c in _CS)} FROM per WHERE graph = '{g}'))"


add("x_wasserstein1", lambda s, d: compare.normalised_wasserstein(_quantile_fits(s, d, "nation/0"), _quantile_fits(s, d, "nation/1"), "quantile"), f"""WITH {CORPUS_SQL},
u AS (SELECT {uniform_sql(0, "i")} AS u FROM range(4000) t(i)), a AS ({_interp_sql('nation/0')}), b AS ({_interp_sql('nation/1')}),
d AS (SELECT avg(abs(a.x - b.x)) AS w1 FROM a JOIN b USING (r)), s AS (SELECT quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM a)
SELECT 'cs_size' AS name, round(w1, 6) AS w1, round(iqr, 6) AS iqr, round(w1 / iqr, 6) AS w1_iqr FROM d, s""")

# --- Generator -------------------------------------------------------------------

add("g_truncated_powerlaw_sample", lambda s, d: s.range(1000).select(F.col("id").alias("i"), schema.power_sample(uniform(3, "id"), 2.2, 1.0, 500.0).alias("x")),
    f"SELECT i, round(pow(1 + {uniform_sql(3, 'i')} * (pow(500.0, -1.2) - 1), 1 / -1.2), 6) AS x FROM range(1000) t(i)")
add("g_relation_weights", lambda s, d: s.createDataFrame([(i, float(w)) for i, w in enumerate(np.sort(schema.relation_weights(12, [-6.0, -5.0, -4.0, -3.0, -2.0, -1.5, -1.0]))[::-1])], "rank int, w double"),
    """WITH l AS (SELECT i, i / 11.0 AS u FROM range(12) t(i)),
w AS (SELECT exp(CASE WHEN u <= 0.1 THEN -6 + u / 0.1 WHEN u <= 0.25 THEN -5 + (u - 0.1) / 0.15 WHEN u <= 0.5 THEN -4 + (u - 0.25) / 0.25 WHEN u <= 0.75 THEN -3 + (u - 0.5) / 0.25 WHEN u <= 0.9 THEN -2 + 0.5 * (u - 0.75) / 0.15 ELSE -1.5 + 0.5 * (u - 0.9) / 0.1 END) AS w FROM l)
SELECT (row_number() OVER (ORDER BY w DESC) - 1)::BIGINT AS rank, round(w / sum(w) OVER (), 6) AS w FROM w""")


def _quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("g"), (F.abs("s_acctbal") + 1).alias("w"))
    return schema.largest_remainder(c, "w", 100, ["g"], "k").select("k", "g", "quota")


add("g_largest_remainder", _quotas, """
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS g, (abs(s_acctbal) + 1) / sum(abs(s_acctbal) + 1) OVER (PARTITION BY s_nationkey) * 100 AS x FROM supplier),
f AS (SELECT *, floor(round(x, 9)) AS fl FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(x - fl, 9) DESC, k) AS rn, 100 - sum(fl) OVER (PARTITION BY g) AS need FROM f)
SELECT k, g::BIGINT AS g, (fl + (rn <= need)::INT)::BIGINT AS quota FROM r""")


def _margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nations-by-segments table scaled to new margins."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("row"), F.col("c_mktsegment").alias("col")).agg(F.count(F.lit(1)).alias("w"))
    rows = c.groupBy("row").agg(F.sum("w").cast("double").alias("rt"))
    cols = c.groupBy("col").agg((F.lit(1.0)).alias("ct"))
    total, k = rows.agg(F.sum("rt")).first()[0], cols.count()
    x = allocation.ipf(c, rows, cols.withColumn("ct", F.lit(total / k)), sweeps=6)
    return x.select("row", "col", F.round("x", 4).alias("x"))


_SWEEPS = "x0 AS (SELECT c_nationkey AS row, c_mktsegment AS col, count(*)::DOUBLE AS x, count(*)::DOUBLE AS w FROM customer GROUP BY 1, 2)" + "".join(
    f""", y{i} AS (SELECT row, col, w, x / sum(x) OVER (PARTITION BY col) * (SELECT sum(w) / count(DISTINCT col) FROM x0) AS x FROM x{i})
, x{i + 1} AS (SELECT row, col, w, x / sum(x) OVER (PARTITION BY row) * sum(w) OVER (PARTITION BY row) AS x FROM y{i})""" for i in range(6))
add("g_ipf_margins", _margins, f"WITH {_SWEEPS}\nSELECT row::BIGINT AS row, col, round(x, 4) AS x FROM x6")


def _class_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class whose relations make each subject's set most likely, over the category graph and three made-up classes."""
    g = category_graph(spark, sf_dir)
    rel = [r.p for r in g.edges.select("p").distinct().orderBy("p").collect()]
    probs = np.array([[1.0 + (i * 7 + t * 5) % 11 for i in range(len(rel))] for t in range(3)])
    probs /= probs.sum(1, keepdims=True)
    at = spark.createDataFrame([(r, i) for i, r in enumerate(rel)], "p string, r int")
    sets = g.edges.select(F.col("s").alias("i"), "p").distinct().join(F.broadcast(at), "p").groupBy("i").agg(F.array_sort(F.collect_list("r")).alias("cs"))
    sch = schema.Schema({}, 0, 0, 10**9, rel, np.ones(len(rel)), probs, np.zeros(len(rel)), 0)
    return wiring.assign_classes(sets, sch).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


add("g_cs_type_assignment", _class_choice, f"""WITH {CATEGORY_SQL},
rel AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS r FROM (SELECT DISTINCT p FROM edges)),
w AS (SELECT t, r, p, 1.0 + (r * 7 + t * 5) % 11 AS w FROM rel CROSS JOIN (VALUES (0), (1), (2)) c(t)),
lp AS (SELECT t, p, ln(w / sum(w) OVER (PARTITION BY t)) AS lp FROM w),
fit AS (SELECT s, t, sum(lp) AS lp FROM (SELECT DISTINCT s, p FROM edges) JOIN lp USING (p) GROUP BY s, t),
best AS (SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY round(lp, 9) DESC, t) AS k FROM fit)
SELECT t::BIGINT AS class, count(*) AS n FROM best WHERE k = 1 GROUP BY t""")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as components, sized by their orders."""
    sizes = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("component")).agg(F.count(F.lit(1)).alias("size"))
    return wiring.connect_plan(sizes, 1000, 40, 0.9)


add("g_connect_components_plan", _plan, """
WITH s AS (SELECT o_custkey AS component, count(*) AS size FROM orders GROUP BY 1),
b AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) = 1 AS big FROM s),
c AS (SELECT component, size, row_number() OVER w AS j, sum(size) OVER w AS total FROM b WHERE NOT big WINDOW w AS (ORDER BY size, component ROWS UNBOUNDED PRECEDING)),
k AS (SELECT j FROM (SELECT j, abs(total - 100.0) AS miss FROM c WHERE j <= 39 UNION ALL SELECT 0, 100.0) ORDER BY round(miss, 9), j LIMIT 1)
SELECT component, size, CASE WHEN j <= (SELECT j FROM k) THEN 'apart' ELSE 'bridge' END AS action FROM c
UNION ALL SELECT component, size, 'largest' FROM b WHERE big""")


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' order counts brought to three a head by changing the lower ones."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("i"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("i")).agg(F.count(F.lit(1)).alias("d"))
    x = c.join(o, "i", "left").select("i", F.coalesce("d", F.lit(1)).alias("d")).withColumn("body", F.col("d") <= 30)
    return schema.repair_sum(x, 25 * c.count(), 5, "fix")


add("g_degree_sequence", _degrees, f"""
WITH x AS (SELECT c_custkey AS i, coalesce(n, 1) AS d FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey),
y AS (SELECT *, d <= 30 AS body FROM x), t AS (SELECT 25 * count(*) - sum(d) AS miss, count(*) FILTER (body) AS n, sum(d - 1) FILTER (body) AS room FROM y),
s AS (SELECT y.*, miss, CASE WHEN NOT body THEN 0.0 WHEN miss > 0 THEN miss::DOUBLE / n ELSE (d - 1) * least(-miss, room)::DOUBLE / greatest(1, room) END AS share FROM y, t),
f AS (SELECT *, floor(share) AS base, body AND (miss > 0 OR d - 1 > floor(share)) AS able FROM s),
r AS (SELECT *, CASE WHEN able THEN row_number() OVER (PARTITION BY able ORDER BY share - base DESC, {uniform_sql(5, "'fix:' || i || ':fix'")}, i) END AS rn, abs(miss) - sum(base) OVER () AS rest FROM f)
SELECT i, (d + sign(miss) * (base + coalesce((rn <= rest)::INT, 0)))::BIGINT AS d FROM r""")

TARGET = {
    "num_entities": 300, "num_relations": 6, "mean_degree": 4.0, "type_edge_frac": 0.1, "num_classes": 3, "num_distinct_cs": 20, "inv_num_distinct_cs": 15, "num_components": 3, "largest_component_fraction": 0.97,
    "out_degree_alpha": 2.2, "out_degree_p90": 8, "out_degree_max": 30, "in_degree_alpha": 2.2, "in_degree_p90": 8, "in_degree_max": 30, "subject_frac": 0.9, "object_frac": 0.8, "cs_freq_alpha": 1.5, "cs_freq_vmin": 1, "cs_freq_vmax": 40,
    **{f"{p}_{s}": float(v) for p in ("cs_size", "inv_cs_size") for s, v in zip(fits.SUFFIXES, (1, 1, 2, 2, 3, 4, 5), strict=True)},
    **{f"rel_freq_logq_{s}": float(v) for s, v in zip(fits.SUFFIXES, (-3, -2.5, -2.2, -1.8, -1.5, -1.2, -1), strict=True)}, "triangle_count": 60.0, "four_cycle_count": 80.0,
}


def _twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation 0 against nation 1: distances of the set sizes, relative errors of the rest."""
    rows = corpus(spark, sf_dir).filter(F.col("graph").isin("nation/0", "nation/1")).collect()  # eleven values each
    values = {g: {r.feature: r.value for r in rows if r.graph == g} for g in ("nation/0", "nation/1")}
    return compare.report(spark, values["nation/0"], values["nation/1"]).filter(F.col("error").isNotNull())


add("x_distance_report", _twin, f"""WITH {CORPUS_SQL},
u AS (SELECT {uniform_sql(0, "i")} AS u FROM range(4000) t(i)), a AS ({_interp_sql('nation/0')}), b AS ({_interp_sql('nation/1')}),
d AS (SELECT avg(abs(a.x - b.x)) AS w1 FROM a JOIN b USING (r)), s AS (SELECT quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM a)
SELECT 'd' AS block, 'cs_size' AS name, 'w1_iqr' AS kind, round(w1 / iqr, 6) AS error FROM d, s
UNION ALL SELECT CASE feature WHEN 'degree_assortativity' THEN 'f' ELSE 'a' END, feature, 'scalar', round(abs(x.value - y.value) / greatest(abs(x.value), 1e-9), 6)
FROM (SELECT * FROM corpus WHERE graph = 'nation/0') x JOIN (SELECT * FROM corpus WHERE graph = 'nation/1') y USING (feature) WHERE feature NOT LIKE 'cs_size%'""")


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a graph made for a fixed target."""
    g = rewire.generate(spark, TARGET, seed=1, budget=200)
    return g.edges.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))


add("g_generate", _generated)

# --- Studies -----------------------------------------------------------------------

star("x_overlap_stats", analytics.overlap, """
, d AS (SELECT s, o, count(*) AS n FROM content GROUP BY s, o), u AS (SELECT least(s, o) AS a, greatest(s, o) AS b, sum(n) AS n, count(*) AS k, sum((n > 1)::INT) AS par FROM d GROUP BY 1, 2)
SELECT sum(n)::BIGINT AS n_edges, sum(k)::BIGINT AS n_directed, count(*) AS n_undirected, round(sum(par)::DOUBLE / sum(k), 6) AS parallel_frac, round(avg((k > 1)::INT::DOUBLE), 6) AS mutual_frac, round(sum(n)::DOUBLE / count(*), 6) AS rho FROM u""".lstrip("\n"))
ORACLES["x_overlap_stats"] = ORACLES["x_overlap_stats"].replace("\n, d AS", ", d AS")
star("x_cs_symmetry", analytics.set_symmetry)
ORACLES["x_cs_symmetry"] = f"""WITH {STAR_SQL},{VIEWS_SQL},
e AS (SELECT p, x, max(a) AS a, max(b) AS b FROM (SELECT p, s AS x, 1 AS a, 0 AS b FROM content UNION ALL SELECT p, o, 0, 1 FROM content) GROUP BY p, x),
j AS (SELECT p, sum(a * b)::BIGINT AS n_both, count(*) AS n_any FROM e GROUP BY p),
r AS (SELECT a.p, count(b.p)::DOUBLE / count(*) AS reciprocity FROM content a LEFT JOIN content b ON a.p = b.p AND a.s = b.o AND a.o = b.s GROUP BY a.p)
SELECT p, n_both, n_any, round(n_both::DOUBLE / n_any, 6) AS jaccard, round(reciprocity, 6) AS reciprocity FROM j JOIN r USING (p)"""
category("x_relation_overlap", analytics.relation_cooverlap, """
SELECT p, q, round(k::DOUBLE / (np + nq - k), 6) AS jaccard FROM (SELECT a.p, b.p AS q, count(*) AS k FROM content a JOIN content b ON a.s = b.s AND a.o = b.o AND a.p < b.p GROUP BY a.p, b.p)
JOIN (SELECT p, count(*) AS np FROM content GROUP BY p) USING (p) JOIN (SELECT p AS q, count(*) AS nq FROM content GROUP BY p) USING (q)""")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


add("x_swaplog_metrics", lambda s, d: analytics.swap_metrics(_events(s, d).select("event_type", (F.col("value") - 1).alias("delta")), "delta", ["event_type"]), """
WITH e AS (SELECT event_type, abs(value - 1) AS m FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY m DESC) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM e)
SELECT event_type, count(*) AS n_rows, round(avg((m = 0)::INT::DOUBLE), 6) AS zero_share, round(avg(m), 6) AS mean_abs, round(quantile_cont(m, 0.5), 6) AS median_abs, round(quantile_cont(m, 0.9), 6) AS p90_abs, round(max(m), 6) AS max_abs,
  round(sum(m) FILTER (rn <= ceil(n * 0.01)) / sum(m), 6) AS top1_share, round(sum(m) FILTER (rn <= ceil(n * 0.1)) / sum(m), 6) AS top10_share FROM r GROUP BY event_type""")
add("x_signed_log_bins", lambda s, d: analytics.signed_log_bins(_events(s, d).select((F.col("value") - 1).alias("delta")), "delta"), """
SELECT (CASE WHEN d = 0 THEN 0 ELSE sign(d) * (floor(log10(abs(d)) * 4) + 1000) END)::BIGINT AS bin, count(*) AS n FROM (SELECT value - 1 AS d FROM events) GROUP BY 1""")
add("x_feature_histograms", lambda s, d: analytics.histograms(corpus(s, d)), f"""WITH {CORPUS_SQL},
lim AS (SELECT feature, min(value) AS lo, max(value) AS hi, ceil(log2(count(*)) + 1) AS bins FROM corpus GROUP BY feature)
SELECT feature, (CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * bins), bins - 1) ELSE 0 END)::BIGINT AS bin, count(*) AS n, 0::BIGINT AS missing FROM corpus JOIN lim USING (feature) GROUP BY 1, 2""")
add("x_sweep_summary", lambda s, d: analytics.sweep_summary(_events(s, d), ["event_type"]), "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM events GROUP BY event_type")
add("x_pca", lambda s, d: analytics.principal_components(s.read.parquet(f"{d}/embeddings.parquet"), "embedding", "vec_id"))

# --- Stream --------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of events, computed by Structured Streaming over the file."""
    from .streaming import counts

    schema_ = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema_).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    x = stream.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    counts.run_once(x, "streamed_events")
    return spark.table("streamed_events")


add("stream_daily_events", _streamed, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")


category("x_degree_summary", lambda g: analytics.degree_summary(g).select("side", "max_degree", "p90", F.array_join(F.col("top").cast("array<string>"), ",").alias("top")), """
, d AS (SELECT 'out' AS side, dout AS d FROM cdeg UNION ALL SELECT 'in', din FROM cdeg)
SELECT side, max(d)::BIGINT AS max_degree, round(quantile_cont(d::DOUBLE, 0.9), 6) AS p90, array_to_string(list_slice(list_reverse_sort(list(d)), 1, 10), ',') AS top FROM d GROUP BY side""".lstrip("\n"))
ORACLES["x_degree_summary"] = ORACLES["x_degree_summary"].replace("\n, d AS", ", d AS")
add("x_power_trend", lambda s, d: analytics.power_law_trend(s.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", "l_extendedprice", ["l_returnflag"]), """
SELECT l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS exponent, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 6) AS factor, count(*) AS n
FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY l_returnflag""")
add("x_inflation", lambda s, d: analytics.inflation(category_graph(s, d), star_graph(s, d)), f"""WITH {CATEGORY_SQL},{VIEWS_SQL},
k AS (SELECT sum(n) / count(*) AS rho, avg((d > 1)::INT::DOUBLE) AS mut, sum(par)::DOUBLE / sum(d) AS par FROM (SELECT least(s, o), greatest(s, o), sum(n) AS n, count(*) AS d, sum((n > 1)::INT) AS par FROM (SELECT s, o, count(*) AS n FROM content GROUP BY s, o) GROUP BY 1, 2)),
z AS (WITH {STAR_SQL},{VIEWS_SQL} SELECT sum(n) / count(*) AS rho, avg((d > 1)::INT::DOUBLE) AS mut, sum(par)::DOUBLE / sum(d) AS par FROM (SELECT least(s, o), greatest(s, o), sum(n) AS n, count(*) AS d, sum((n > 1)::INT) AS par FROM (SELECT s, o, count(*) AS n FROM content GROUP BY s, o) GROUP BY 1, 2))
SELECT round(k.rho, 6) AS original, round(k.mut, 6) AS mutual_original, round(k.par, 6) AS parallel_original, round(z.rho, 6) AS synthetic, round(z.mut, 6) AS mutual_synthetic, round(z.par, 6) AS parallel_synthetic,
  round(z.rho / k.rho, 6) AS inflation, round((z.rho - k.rho) / k.rho, 6) AS rho_gap FROM k, z""")


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks A to D of the category graph's signature as a feature table."""
    return signature.measure(category_graph(spark, sf_dir), ["a", "b", "c", "d"]).table(spark, "categories").filter(F.col("value").isNotNull()).drop("graph")


add("signature_categories", _whole)
