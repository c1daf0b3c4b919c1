"""Every query of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fits
from .operators import measures as m
from .operators import motifs, paths
from .plans.graph import RDF_TYPE, Graph
from .sources.tables import CATEGORY_SQL, GEOGRAPHY_SQL, STAR_SQL, VIEWS_SQL, category_graph, geography_graph, star_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show; ints as longs."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        out.append((F.round(c, digits) + F.lit(0.0) if t == "double" else c.cast("long") if t in ("integer", "short", "byte") else c).alias(f.name))
    return df.select(*out)


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir, q=query: rounded(q(spark, sf_dir))
    if sql:
        ORACLES[name] = sql


def star(name: str, measure: Callable[[Graph], DataFrame], body: str | None = None) -> None:
    """A measurement of the star graph."""
    add(name, lambda spark, d: measure(star_graph(spark, d)), body and f"WITH {STAR_SQL},{VIEWS_SQL}\n{body}")


def category(name: str, measure: Callable[[Graph], DataFrame], body: str | None = None) -> None:
    """A measurement of the category graph."""
    add(name, lambda spark, d: measure(category_graph(spark, d)), body and f"WITH {CATEGORY_SQL},{VIEWS_SQL}\n{body}")


def _quantiles_sql(value: str, source: str, head: str = "", least: int = fits.MIN_SAMPLES, ends: tuple[float, float] | None = None) -> str:
    q = [f"quantile_cont({value}::DOUBLE, {level})" for level in fits.LEVELS]
    if ends:
        q[0], q[-1] = f"{ends[0]}::DOUBLE", f"{ends[1]}::DOUBLE"
    cols = ", ".join(f"round(CASE WHEN count({value}) >= {least} THEN greatest({', '.join(q[: i + 1])}) END, {DIGITS}) + 0.0 AS {s}" for i, s in enumerate(fits.SUFFIXES))
    return f"SELECT {head}{cols} FROM {source}"


def power_sql(values: str, value: str, by: str, pin_low: bool = True) -> str:
    """The most likely exponent of a discrete power law on [lo, hi] for each group, by 44 halvings; ``values`` is a query, ``by`` a column of it.

    Sums have 100,000 terms and beyond these the integral with two corrections (Euler-Maclaurin).
    """
    terms = lambda f: f"list_sum(list_transform(range(lo, top + 1), lambda k: {f}pow(k, -m)))"
    rest = lambda whole, f, d: f"CASE WHEN hi > top THEN {whole} + ({f('hi')} - {f('top')}) / 2 + ({d('hi')} - {d('top')}) / 12 ELSE 0 END"
    c = "(1 - m)"
    s = f"({terms('')} + {rest(f'(pow(hi, {c}) - pow(top, {c})) / {c}', lambda x: f'pow({x}, -m)', lambda x: f'-m * pow({x}, -m - 1)')})"
    first = lambda x: f"pow({x}, {c}) * ({c} * ln({x}) - 1)"
    t = f"({terms('ln(k) * ')} + {rest(f'({first('hi')} - {first('top')}) / ({c} * {c})', lambda x: f'ln({x}) * pow({x}, -m)', lambda x: f'pow({x}, -m - 1) * (1 - m * ln({x}))')})"
    return f"""
, vals AS ({values})
, st AS (SELECT {by} AS grp, count(*) AS n, sum(ln({value})) AS sum_log, {"1::BIGINT" if pin_low else f"min({value})::BIGINT"} AS lo, max({value})::BIGINT AS hi FROM vals WHERE {value} > 0 GROUP BY 1)
, halves(grp, mean, lo, top, hi, a, b, i) AS (
  SELECT grp, sum_log / n, lo, least(hi, lo + 100000), hi, 1.000000001::DOUBLE, 3.0::DOUBLE, 0 FROM st WHERE n >= 10 AND lo < hi
  UNION ALL SELECT grp, mean, lo, top, hi, CASE WHEN f > 0 THEN m ELSE a END, CASE WHEN f > 0 THEN b ELSE m END, i + 1
  FROM (SELECT *, {t} / {s} - mean AS f FROM (SELECT *, (a + b) / 2 AS m FROM halves WHERE i < 44)))
, alphas AS (SELECT st.grp, st.n, st.sum_log, st.lo, st.hi, round((a + b) / 2, 6) AS alpha FROM st LEFT JOIN (SELECT * FROM halves WHERE i = 44) h ON h.grp IS NOT DISTINCT FROM st.grp)"""


# --- Block A ---------------------------------------------------------------

_SIZE_SQL = f"""
SELECT (SELECT count(*) FROM names WHERE NOT lit) AS num_entities, count(DISTINCT p) AS num_relations,
       round(count(*)::DOUBLE / (SELECT count(*) FROM names WHERE NOT lit), 6) AS mean_degree,
       round(avg((p = '{RDF_TYPE}')::INT::DOUBLE), 6) AS type_edge_frac FROM edges"""
star("a_size_vocabulary", m.size_vocabulary, _SIZE_SQL)
category("a_size_vocabulary_categories", m.size_vocabulary, _SIZE_SQL)
_USAGE_SQL = """
SELECT p, n_edges, round(n_edges::DOUBLE / sum(n_edges) OVER (), 6) AS share, round(ln(n_edges::DOUBLE / sum(n_edges) OVER ()), 6) AS log_share,
       row_number() OVER (ORDER BY n_edges DESC, p) AS rank
FROM (SELECT p, count(*) AS n_edges FROM edges GROUP BY p)"""
star("a_relation_usage", m.relation_usage, _USAGE_SQL)
category("a_relation_usage_categories", m.relation_usage, _USAGE_SQL)


def _flagship(g: Graph) -> DataFrame:
    """Size block, relation usage and characteristic sets in one result: (part, key, n, value)."""
    a = m.size_vocabulary(g)
    a = a.select(F.explode(F.array(*(F.struct(F.lit("size").alias("part"), F.lit(c).alias("key"), F.lit(None).cast("long").alias("n"), F.col(c).cast("double").alias("value")) for c in a.columns))).alias("x")).select("x.*")
    r = m.relation_usage(g).select(F.lit("relation").alias("part"), F.col("p").alias("key"), F.col("n_edges").alias("n"), F.col("share").alias("value"))
    c = m.set_frequencies(g).select(F.lit("set").alias("part"), F.col("cs").alias("key"), "n", F.col("size").cast("double").alias("value"))
    return a.union(r).union(c)


star("flagship", _flagship, f"""
, a AS (SELECT (SELECT count(*) FROM names WHERE NOT lit)::DOUBLE AS v, count(*) AS e, count(DISTINCT p) AS r, count(*) FILTER (p = '{RDF_TYPE}') AS t FROM edges)
SELECT 'size' AS part, 'num_entities' AS key, NULL::BIGINT AS n, v AS value FROM a
UNION ALL SELECT 'size', 'num_relations', NULL, r::DOUBLE FROM a
UNION ALL SELECT 'size', 'mean_degree', NULL, round(e / v, 6) FROM a
UNION ALL SELECT 'size', 'type_edge_frac', NULL, round(t::DOUBLE / e, 6) FROM a
UNION ALL SELECT 'relation', p, count(*), round(count(*)::DOUBLE / (SELECT e FROM a), 6) FROM edges GROUP BY p
UNION ALL SELECT 'set', cs, count(*), max(n)::DOUBLE FROM cs GROUP BY cs""".lstrip("\n"))
ORACLES["flagship"] = ORACLES["flagship"].replace("\n, a AS", ", a AS")

# --- Block B ---------------------------------------------------------------

for _side, _c in (("out", "dout"), ("in", "din")):
    _sql = f"""
SELECT max({_c})::BIGINT AS max_degree, round(quantile_cont({_c}::DOUBLE, 0.9), 6) AS p90, round(avg({_c}), 6) AS mean_degree,
       round(avg(({_c} > 0)::INT::DOUBLE), 6) AS active_frac, count(*) AS n_entities FROM cdeg"""
    star(f"b_{_side}_degree_stats", lambda g, c=_c: m.degree_stats(g, c), _sql)
    category(f"b_{_side}_degree_stats_categories", lambda g, c=_c: m.degree_stats(g, c), _sql)
star("b_degree_histogram", m.degree_histogram, """
, h AS (SELECT 'out' AS side, dout AS degree, count(*) AS n FROM cdeg GROUP BY dout UNION ALL SELECT 'in', din, count(*) FROM cdeg GROUP BY din)
SELECT side, degree::BIGINT AS degree, n, round((sum(n) OVER (PARTITION BY side ORDER BY degree DESC ROWS UNBOUNDED PRECEDING))::DOUBLE / sum(n) OVER (PARTITION BY side), 6) AS ccdf FROM h""".lstrip("\n"))
ORACLES["b_degree_histogram"] = ORACLES["b_degree_histogram"].replace("\n, h AS", ", h AS")
_MULT = {"obj": "SELECT p, s AS name, count(*) AS m FROM edges GROUP BY p, s", "subj": "SELECT p, o AS name, count(*) AS m FROM edges WHERE NOT lit GROUP BY p, o"}
for _side, _sub in _MULT.items():
    _sql = f"SELECT p, count(*) AS n_groups, round(avg(m), 6) AS mean_mult, max(m) AS max_mult, round(sum(ln(m)), 6) AS sum_log FROM ({_sub}) GROUP BY p"
    star(f"b_{_side}_multiplicity", lambda g, s=_side: m.multiplicity_stats(g, s), _sql)
    category(f"b_{_side}_multiplicity_categories", lambda g, s=_side: m.multiplicity_stats(g, s), _sql)
_offset = " UNION ALL ".join(
    f"""SELECT 'a_{s}' AS side, CASE WHEN count(*) >= 10 AND min(n) < max(n) THEN round(regr_slope(ln(m), ln(n)), 6) END AS slope, count(*) AS n_pairs
FROM (SELECT m, count(*) OVER (PARTITION BY name) AS n FROM ({sub}))""" for s, sub in _MULT.items())
category("b_cs_size_offset", m.size_offset, _offset)
_RECIP = """
, r AS (SELECT a.p, count(*) AS n_pairs, count(b.p) AS n_mutual FROM content a LEFT JOIN content b ON a.p = b.p AND a.s = b.o AND a.o = b.s GROUP BY a.p)"""
star("b_reciprocity", m.reciprocity, "SELECT 1")
ORACLES["b_reciprocity"] = f"WITH {STAR_SQL},{VIEWS_SQL}{_RECIP}\nSELECT p, n_pairs, n_mutual, round(n_mutual::DOUBLE / n_pairs, 6) AS reciprocity FROM r"
star("b_reciprocity_bins", m.reciprocity_bins)
ORACLES["b_reciprocity_bins"] = f"""WITH {STAR_SQL},{VIEWS_SQL}{_RECIP}
, t AS (SELECT p, count(*) AS n FROM edges GROUP BY p)
, c AS (SELECT n_mutual::DOUBLE / n_pairs AS rec, round((sum(n) OVER (ORDER BY n DESC, r.p))::DOUBLE / sum(n) OVER (), 12) AS cum FROM r JOIN t USING (p))
SELECT (CASE WHEN cum <= 0.1 THEN 0 WHEN cum <= 0.25 THEN 1 WHEN cum <= 0.5 THEN 2 WHEN cum <= 0.75 THEN 3 WHEN cum <= 0.9 THEN 4 ELSE 5 END)::BIGINT AS bin,
       count(*) AS n_relations, round(avg((rec > 0.5)::INT::DOUBLE), 6) AS frac_symmetric FROM c GROUP BY 1"""
star("b_symmetric_value", m.symmetric_value)
ORACLES["b_symmetric_value"] = f"WITH {STAR_SQL},{VIEWS_SQL}{_RECIP}\nSELECT round(avg(n_mutual::DOUBLE / n_pairs) FILTER (n_mutual::DOUBLE / n_pairs > 0.5), 6) AS recip_symmetric_value FROM r"
_logs = "(SELECT ln(count(*)::DOUBLE / (SELECT count(*) FROM edges)) AS x FROM edges GROUP BY p)"
star("b_rel_freq_quantiles", m.relation_quantiles, _quantiles_sql("x", _logs, least=2))
category("b_rel_freq_quantiles_categories", m.relation_quantiles, _quantiles_sql("x", _logs, least=2))
category("b_degree_powerlaw", m.degree_powerlaw)
ORACLES["b_degree_powerlaw"] = f"WITH RECURSIVE {CATEGORY_SQL},{VIEWS_SQL}{power_sql("SELECT 'out' AS side, dout AS d FROM cdeg UNION ALL SELECT 'in', din FROM cdeg", 'd', 'side')}\nSELECT grp AS side, n, lo, hi, alpha FROM alphas"
category("b_degree_powerlaw_distance", lambda g: fits.power_distance(g.content_degrees.select(F.col("dout").alias("d"), F.lit("out").alias("side")), "d", ["side"]))
ORACLES["b_degree_powerlaw_distance"] = f"""WITH RECURSIVE {CATEGORY_SQL},{VIEWS_SQL}{power_sql("SELECT 'out' AS side, dout AS d FROM cdeg", 'd', 'side')}
, seen AS (SELECT dout AS k, count(*) AS m FROM cdeg WHERE dout > 0 GROUP BY 1)
, pts AS (SELECT k, sum(m) OVER (ORDER BY k) AS upto, m, n, hi, (a + b) / 2 AS x FROM seen, st JOIN (SELECT grp AS g, a, b FROM halves WHERE i = 44) h ON h.g = st.grp)
, law AS (SELECT *, list_sum(list_transform(range(1, k + 1), lambda j: pow(j, -x))) / list_sum(list_transform(range(1, hi + 1), lambda j: pow(j, -x))) AS l,
  coalesce(list_sum(list_transform(range(1, k), lambda j: pow(j, -x))), 0) / list_sum(list_transform(range(1, hi + 1), lambda j: pow(j, -x))) AS l0 FROM pts)
SELECT 'out' AS side, round(max(x), 6) AS alpha, round(max(greatest(abs(upto / n - l), abs((upto - m) / n - l0))), 6) AS distance FROM law"""
category("b_obj_mult_alphas", lambda g: m.multiplicity_alphas(g, "obj"))
ORACLES["b_obj_mult_alphas"] = f"WITH RECURSIVE {CATEGORY_SQL},{VIEWS_SQL}{power_sql(_MULT['obj'], 'm', 'p')}\nSELECT grp AS p, n, round(sum_log, 6) AS sum_log, lo, hi, alpha FROM alphas"
category("b_mult_alpha_quantiles", m.multiplicity_alpha_quantiles)
_MULTS = "SELECT 'obj ' || p AS grp, m FROM ({obj}) UNION ALL SELECT 'subj ' || p, m FROM ({subj})".format(**_MULT)
ORACLES["b_mult_alpha_quantiles"] = f"WITH RECURSIVE {CATEGORY_SQL},{VIEWS_SQL}{power_sql(_MULTS, 'm', 'grp')}\n" + " UNION ALL ".join(
    _quantiles_sql("alpha", f"(SELECT alpha FROM alphas WHERE grp LIKE '{s} %')", head=f"'{s}' AS side, ", ends=fits.ALPHA_ENDS) for s in ("obj", "subj"))

# --- Block C ---------------------------------------------------------------

_COOC = "SELECT a.p, b.p AS q, count(*) AS n FROM (SELECT DISTINCT {v} AS v, p FROM edges) a JOIN (SELECT DISTINCT {v} AS v, p FROM edges) b ON a.v = b.v GROUP BY a.p, b.p"
for _side, _v in (("subj", "s"), ("obj", "o")):
    star(f"c_cooc_{_side}ect", lambda g, s=_side: m.cooccurrence(g, s), _COOC.format(v=_v))
    category(f"c_cooc_{_side}ect_categories", lambda g, s=_side: m.cooccurrence(g, s), _COOC.format(v=_v))
star("c_cooc_density", m.cooccurrence_density, " UNION ALL ".join(
    f"SELECT '{s}' AS side, count(*) AS nnz, round(count(*)::DOUBLE / (SELECT count(DISTINCT p) * count(DISTINCT p) FROM edges), 6) AS density FROM ({_COOC.format(v=v)})" for s, v in (("subj", "s"), ("obj", "o"))))
_row_h = "(SELECT coalesce(h, 0.0) AS h FROM (SELECT DISTINCT p FROM edges) LEFT JOIN (SELECT p, -sum(x * ln(x)) AS h FROM (SELECT p, n::DOUBLE / sum(n) OVER (PARTITION BY p) AS x FROM ({c})) GROUP BY p) USING (p))"
category("c_row_entropy_quantiles", m.row_entropy_quantiles, " UNION ALL ".join(_quantiles_sql("h", _row_h.format(c=_COOC.format(v=v)), head=f"'{s}' AS side, ") for s, v in (("subj", "s"), ("obj", "o"))))
star("c_class_sizes", m.class_sizes, f"SELECT o AS class, count(DISTINCT s) AS n_instances FROM edges WHERE p = '{RDF_TYPE}' GROUP BY o")
_TYPED = f"""SELECT class, p, n, n::DOUBLE / sum(n) OVER (PARTITION BY class) AS prob FROM (
  SELECT t.o AS class, e.p, count(*) AS n FROM edges t JOIN edges e ON e.s = t.s WHERE t.p = '{RDF_TYPE}' GROUP BY t.o, e.p)"""
star("c_type_relation_probs", m.type_relations, f"SELECT class, p, n, round(prob, 6) AS prob FROM ({_TYPED})")
star("c_per_type_entropy", m.per_type_entropy, f"SELECT class, round(-sum(prob * ln(prob)), 6) + 0.0 AS entropy, count(*) AS n_relations FROM ({_TYPED}) GROUP BY class")
star("c_per_type_entropy_decay", m.per_type_entropy_decay, f"""
SELECT CASE WHEN count(*) >= 3 THEN round(-regr_slope(y, k), 6) END AS rate, CASE WHEN count(*) >= 3 THEN round(exp(regr_intercept(y, k)), 6) END AS scale
FROM (SELECT ln(h) AS y, (row_number() OVER (ORDER BY h DESC) - 1)::DOUBLE AS k FROM (SELECT -sum(prob * ln(prob)) AS h FROM ({_TYPED}) GROUP BY class) WHERE h > 0)""")
_PAIR_SQL = """
SELECT (SELECT count(*) FROM content) AS n_content, d AS n_directed, u AS n_undirected, round((SELECT count(*) FROM content)::DOUBLE / d, 6) AS edge_multiplicity, round(d::DOUBLE / u, 6) AS bidirectional_ratio
FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT s, o FROM content)) AS d, (SELECT count(*) FROM (SELECT DISTINCT least(s, o), greatest(s, o) FROM content)) AS u)"""
star("c_pair_ratios", m.pair_ratios, _PAIR_SQL)
category("c_pair_ratios_categories", m.pair_ratios, _PAIR_SQL)
star("c_cooc_spectrum", lambda g: m.cooccurrence_spectrum(g, "subj"))
star("c_type_rel_spectrum", m.type_spectrum)
star("c_class_size_powerlaw", m.class_size_powerlaw)
ORACLES["c_class_size_powerlaw"] = f"WITH RECURSIVE {STAR_SQL},{VIEWS_SQL}{power_sql(f"SELECT 1 AS one, count(DISTINCT s) AS n FROM edges WHERE p = '{RDF_TYPE}' GROUP BY o", 'n', 'one')}\nSELECT n, lo, hi, alpha FROM alphas"

# --- Block D ---------------------------------------------------------------

for _inv, _name, _view in ((False, "d_characteristic_sets", "cs"), (True, "d_inverse_characteristic_sets", "inv")):
    _sql = f"SELECT cs, max(n)::BIGINT AS size, count(*) AS n FROM {_view} GROUP BY cs"
    star(_name, lambda g, i=_inv: m.set_frequencies(g, i), _sql)
    category(f"{_name}_categories", lambda g, i=_inv: m.set_frequencies(g, i), _sql)
category("d_cs_size_quantiles", m.set_size_quantiles, _quantiles_sql("n", "cs"))
category("d_inv_cs_size_quantiles", lambda g: m.set_size_quantiles(g, True), _quantiles_sql("n", "inv"))
_TWO = """SELECT a.q, b.p, sum(ci * co)::BIGINT AS n FROM (SELECT o AS x, p AS q, count(*) AS ci FROM edges WHERE NOT lit GROUP BY o, p) a
JOIN (SELECT s AS x, p, count(*) AS co FROM edges GROUP BY s, p) b ON a.x = b.x GROUP BY a.q, b.p"""
star("d_two_step_pairs", m.two_step_pairs, _TWO)
category("d_two_step_pairs_categories", m.two_step_pairs, _TWO)
star("d_two_step_top20", m.two_step_top, f"SELECT * FROM ({_TWO}) ORDER BY n DESC, q, p LIMIT 20")
category("d_cs_freq_powerlaw", m.set_frequency_powerlaw)
category("d_inv_cs_freq_powerlaw", lambda g: m.set_frequency_powerlaw(g, True))
star("d_two_step_powerlaw", m.two_step_powerlaw)
for _name, _head, _vals in (("d_cs_freq_powerlaw", CATEGORY_SQL, "SELECT 1 AS one, count(*) AS n FROM cs GROUP BY cs"), ("d_inv_cs_freq_powerlaw", CATEGORY_SQL, "SELECT 1 AS one, count(*) AS n FROM inv GROUP BY cs"), ("d_two_step_powerlaw", STAR_SQL, f"SELECT 1 AS one, n FROM ({_TWO})")):
    ORACLES[_name] = f"WITH RECURSIVE {_head},{VIEWS_SQL}{power_sql(_vals, 'n', 'one', pin_low=False)}\nSELECT n, lo, hi, alpha FROM alphas"

# --- Block E ---------------------------------------------------------------

#: Edges from the lower to the higher end by (degree, name), numbered as text-free ranks.
_ORIENTED = """
, rk AS (SELECT name, d, row_number() OVER (ORDER BY d, name) AS r FROM deg)
, ori AS (SELECT least(a.r, b.r) AS a, greatest(a.r, b.r) AS b FROM und JOIN rk a ON a.name = u JOIN rk b ON b.name = v)
, num AS (SELECT a AS u, b AS v FROM ori UNION ALL SELECT b, a FROM ori)
, tri AS (SELECT p.a AS x, p.b AS y, q.b AS z FROM ori p JOIN ori q ON p.a = q.a AND p.b < q.b JOIN ori r ON r.a = p.b AND r.b = q.b)"""


def oriented(name: str, measure: Callable[[Graph], DataFrame], body: str, source: Callable = star) -> None:
    source(name, measure)
    ORACLES[name] = f"WITH {STAR_SQL if source is star else CATEGORY_SQL},{VIEWS_SQL}{_ORIENTED}\n{body}"


oriented("e_triangles", motifs.triangle_count, "SELECT count(*) AS triangles FROM tri")
oriented("e_triangles_per_vertex", motifs.triangles_per_vertex, "SELECT name, count(*) AS triangles FROM (SELECT x AS r FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri) JOIN rk USING (r) GROUP BY name")
_M3 = "SELECT (SELECT count(*) FROM und) AS edges, (SELECT count(*) FROM tri) AS triangles, (SELECT sum(d * (d - 1) / 2)::BIGINT FROM deg) - 3 * (SELECT count(*) FROM tri) AS wedges"
oriented("e_motifs3", motifs.motifs3, _M3.replace("d * (d - 1) / 2", "d * (d - 1) // 2"))
_M4 = """
, te AS (SELECT a, b, count(*) AS n FROM (SELECT x AS a, y AS b FROM tri UNION ALL SELECT x, z FROM tri UNION ALL SELECT y, z FROM tri) GROUP BY a, b)
, k4 AS (SELECT count(*) AS n FROM tri s JOIN tri t ON s.x = t.x AND s.y = t.y AND s.z < t.z JOIN ori ON ori.a = s.z AND ori.b = t.z)
, sq AS (SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS n FROM (SELECT o.b AS top, m.v AS w, count(*) AS n FROM ori o JOIN num m ON m.u = o.a AND m.v < o.b GROUP BY o.b, m.v))
, f AS (SELECT (SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT FROM te) - 6 * (SELECT n FROM k4) AS dia, (SELECT n FROM k4) AS k, (SELECT n FROM sq) AS s,
  (SELECT coalesce(sum(c * d), 0)::BIGINT FROM (SELECT r, count(*) AS c FROM (SELECT x AS r FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri) GROUP BY r) JOIN rk USING (r)) AS ds, (SELECT count(*) FROM tri) AS t)
SELECT s - dia - 3 * k AS four_cycle, dia AS diamond, k AS k4, ds - 6 * t - 4 * dia - 12 * k AS tailed_triangle FROM f"""
oriented("e_motifs4", motifs.motifs4, _M4.lstrip("\n"))
ORACLES["e_motifs4"] = ORACLES["e_motifs4"].replace("\n, te AS", ", te AS")
_choose = lambda k: " * ".join(f"(d - {k - i})::DOUBLE / {i}" for i in range(1, k + 1))
oriented("e_stars_trianglefree", lambda g: motifs.stars_triangle_free(g).select("k", F.log("stars").alias("log_stars")), " UNION ALL ".join(
    f"SELECT {k}::BIGINT AS k, round(ln(nullif(sum(CASE WHEN d >= {k} THEN round({_choose(k)}) ELSE 0 END), 0)), 6) AS log_stars FROM calm" for k in range(2, 11)))
ORACLES["e_stars_trianglefree"] = ORACLES["e_stars_trianglefree"].replace(f"{_ORIENTED}\n", f"{_ORIENTED}\n, calm AS (SELECT * FROM rk WHERE r NOT IN (SELECT x FROM tri UNION SELECT y FROM tri UNION SELECT z FROM tri))\n", 1)


_SETS5 = """
, s2 AS (SELECT a AS v1, b AS v2 FROM ori)
, s3 AS (SELECT DISTINCT list_sort([v1, v2, v])::BIGINT[] AS vs FROM s2 JOIN num ON (u = v1 OR u = v2) AND v <> v1 AND v <> v2)
, s4 AS (SELECT DISTINCT list_sort(list_append(vs, v)) AS vs FROM s3 JOIN num ON list_contains(vs, u) AND NOT list_contains(vs, v))
, s5 AS (SELECT DISTINCT list_sort(list_append(vs, v)) AS vs FROM s4 JOIN num ON list_contains(vs, u) AND NOT list_contains(vs, v))
, dg AS (SELECT vs, u, count(*) AS d FROM s5 JOIN num ON list_contains(vs, u) AND list_contains(vs, v) GROUP BY vs, u)
SELECT ds, count(*) AS n FROM (SELECT vs, string_agg(d::VARCHAR, ',' ORDER BY d) AS ds FROM dg GROUP BY vs) GROUP BY ds"""
add("e_graphlets5", lambda spark, d: motifs.graphlets(geography_graph(spark, d), 5), f"WITH {GEOGRAPHY_SQL},{VIEWS_SQL}{_ORIENTED}{_SETS5}")
#: Nations in a circle, each beside those four and five further.
_CIRCLE_SQL = """
edges AS (SELECT 'nation/' || a.n_nationkey AS s, 'beside' AS p, 'nation/' || b.n_nationkey AS o, FALSE AS lit FROM nation a JOIN nation b
  ON b.n_nationkey IN ((a.n_nationkey + 4) % 25, (a.n_nationkey + 5) % 25))"""
#: Suppliers hang on nations, which have neighbours: dead ends beside rings.
_OUTPOSTS_SQL = GEOGRAPHY_SQL.replace("edges AS (", "around AS (") + """, edges AS (SELECT * FROM around WHERE p <> 'initial'
  UNION ALL SELECT 'supplier/' || s_suppkey, 'inNation', 'nation/' || s_nationkey, FALSE FROM supplier)"""


def _circle(spark: SparkSession, sf_dir: str) -> Graph:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("a"))
    e = n.withColumn("b", F.explode(F.array((F.col("a") + 4) % 25, (F.col("a") + 5) % 25)))
    return Graph(e.select(F.concat(F.lit("nation/"), "a").alias("s"), F.lit("beside").alias("p"), F.concat(F.lit("nation/"), "b").alias("o")), distinct=True)


def _outposts(spark: SparkSession, sf_dir: str) -> Graph:
    x = geography_graph(spark, sf_dir).edges.filter("p <> 'initial'")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("supplier/"), "s_suppkey").alias("s"), F.lit("inNation").alias("p"), F.concat(F.lit("nation/"), "s_nationkey").alias("o"), F.lit(False).alias("o_is_literal"))
    return Graph(x.union(s), distinct=True)


add("e_cycles6", lambda spark, d: motifs.cycles(_circle(spark, d), 6), f"""WITH {_CIRCLE_SQL},{VIEWS_SQL}{_ORIENTED}
, c6 AS (SELECT a.u AS v1, a.v AS v2, b.v AS v3, c.v AS v4, d.v AS v5, e.v AS v6 FROM num a JOIN num b ON b.u = a.v AND b.v <> a.u JOIN num c ON c.u = b.v AND c.v NOT IN (a.u, a.v)
  JOIN num d ON d.u = c.v AND d.v NOT IN (a.u, a.v, b.v) JOIN num e ON e.u = d.v AND e.v NOT IN (a.u, a.v, b.v, c.v) JOIN num f ON f.u = e.v AND f.v = a.u)
SELECT count(*) // 12 AS cycles FROM c6 WHERE NOT EXISTS (SELECT 1 FROM num WHERE (u, v) IN ((v1, v3), (v1, v4), (v1, v5), (v2, v4), (v2, v5), (v2, v6), (v3, v5), (v3, v6), (v4, v6)))""")
add("e_stars_exact", lambda spark, d: motifs.stars(geography_graph(spark, d)), f"""WITH RECURSIVE {GEOGRAPHY_SQL},{VIEWS_SQL}{_ORIENTED}
, near AS (SELECT u, list(v) AS ns FROM num GROUP BY u)
, grow(c, last, k, vs) AS (SELECT u, v, 1, [v] FROM num
  UNION ALL SELECT g.c, n.v, g.k + 1, list_append(g.vs, n.v) FROM grow g JOIN num n ON n.u = g.c AND n.v > g.last JOIN near ON near.u = n.v WHERE g.k < 10 AND len(list_intersect(near.ns, g.vs)) = 0)
SELECT z.k, coalesce(n, 0)::DOUBLE AS stars, TRUE AS exact FROM (SELECT k::BIGINT AS k FROM range(2, 11) t(k)) z LEFT JOIN (SELECT k, count(*) AS n FROM grow GROUP BY k) USING (k)""")
# the whole graph: counted where its degrees allow, estimated where they do not
category("e_stars", lambda g: motifs.stars(g).select("k", F.log("stars").alias("log_stars"), "exact"))
_COLOUR = """
, col AS (SELECT r, (1 << (('0x' || substr(md5('0:0:' || name), 1, 8))::BIGINT % 4))::BIGINT AS bit FROM rk)
, p2 AS (SELECT n.v, a.bit | b.bit AS mask, count(*) AS n FROM num n JOIN col a ON a.r = n.u JOIN col b ON b.r = n.v AND a.bit & b.bit = 0 GROUP BY 1, 2)
, p3 AS (SELECT n.v, mask | b.bit AS mask, sum(p.n) AS n FROM p2 p JOIN num n ON n.u = p.v JOIN col b ON b.r = n.v AND mask & b.bit = 0 GROUP BY 1, 2)
, p4 AS (SELECT n.v, mask | b.bit AS mask, sum(p.n) AS n FROM p3 p JOIN num n ON n.u = p.v JOIN col b ON b.r = n.v AND mask & b.bit = 0 GROUP BY 1, 2)
SELECT 0::BIGINT AS colouring, sum(n)::DOUBLE AS total, round(sum(n)::DOUBLE / (24.0 / 256), 6) AS paths FROM p4"""
oriented("e_color_coding_k4", lambda g: motifs.colourful_total(g, 4), _COLOUR.lstrip("\n"), category)
ORACLES["e_color_coding_k4"] = ORACLES["e_color_coding_k4"].replace("\n, col AS", ", col AS")
category("e_color_coding_sampled", lambda g: motifs.HybridCounter(sampled=motifs.SampledCounter(colourings=4)).count(g, 5))
category("e_template_stats", lambda g: motifs.template_stats(m.set_frequencies(g)), """
SELECT round(least(50.0, greatest(1.01, 1 + count(*) / (sum(ln(n)) - count(*) * ln(min(n))))), 6) AS zipf, round(-sum(x * ln(x)), 6) AS entropy
FROM (SELECT n, n::DOUBLE / sum(n) OVER () AS x FROM (SELECT count(*)::DOUBLE AS n FROM cs GROUP BY cs))""")

# --- Block F ---------------------------------------------------------------



#: Least names spread along edges, as many rounds as any two vertices of these graphs are apart.
_ROUNDS = 14
_LABELS = "l0 AS (SELECT name, name AS c FROM names), " + ", ".join(
    f"l{i} AS (SELECT name, min(c) AS c FROM (SELECT name, c FROM l{i - 1} UNION ALL SELECT v, c FROM l{i - 1} JOIN both_ways ON u = name) GROUP BY name)" for i in range(1, _ROUNDS + 1))
for _source, _sql, _tag in ((category, CATEGORY_SQL, ""), (star, STAR_SQL, "_star")):
    _source(f"f_components{_tag}", paths.components)
    ORACLES[f"f_components{_tag}"] = f"WITH {_sql},{VIEWS_SQL},{_LABELS}\nSELECT name, c AS component FROM l{_ROUNDS}"
    _source(f"f_lcc_fraction{_tag}", paths.largest_fraction)
    ORACLES[f"f_lcc_fraction{_tag}"] = f"WITH {_sql},{VIEWS_SQL},{_LABELS}\nSELECT count(*) AS num_components, round(max(n)::DOUBLE / sum(n), 6) AS largest_component_fraction FROM (SELECT count(*) AS n FROM l{_ROUNDS} GROUP BY c)"
oriented("f_clustering", paths.clustering, "SELECT round(sum(2.0 * t / (d * (d - 1))) / (SELECT count(*) FROM names), 6) AS clustering_coefficient FROM (SELECT r, count(*) AS t FROM (SELECT x AS r FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri) GROUP BY r) JOIN rk USING (r)")
star("f_assortativity", paths.assortativity, "SELECT round(corr(a.d, b.d), 6) AS degree_assortativity FROM both_ways JOIN deg a ON a.name = u JOIN deg b ON b.name = v")
category("f_shortest_paths", lambda g: paths.sampled_distances(g, 100).drop("i"))
ORACLES["f_shortest_paths"] = f"""WITH RECURSIVE {CATEGORY_SQL},{VIEWS_SQL},{_LABELS},
big AS (SELECT c FROM l{_ROUNDS} GROUP BY c ORDER BY count(*) DESC, c LIMIT 1),
inside AS (SELECT name FROM l{_ROUNDS} JOIN big USING (c) JOIN names USING (name) WHERE NOT lit),
a AS (SELECT name AS src, row_number() OVER (ORDER BY md5('42:src:' || name), name) AS i FROM inside),
b AS (SELECT name AS dst, row_number() OVER (ORDER BY md5('42:dst:' || name), name) AS i FROM inside),
pairs AS (SELECT src, dst FROM a JOIN b USING (i) WHERE i <= 100),
walk(src, name, dist) AS (SELECT DISTINCT src, src, 0 FROM pairs UNION SELECT w.src, e.v, w.dist + 1 FROM walk w JOIN both_ways e ON w.name = e.u WHERE w.dist < 12)
SELECT p.src, p.dst, min(w.dist)::BIGINT AS dist FROM pairs p JOIN walk w ON w.src = p.src AND w.name = p.dst GROUP BY p.src, p.dst HAVING min(w.dist) > 0"""
star("f_path_stats", paths.path_stats)
category("f_path_stats_categories", paths.path_stats)
category("f_bridges", paths.bridges)
add("f_bridges_geography", lambda spark, d: paths.bridges(_outposts(spark, d)), f"""WITH RECURSIVE {_OUTPOSTS_SQL},{VIEWS_SQL},
walk(eu, ev, x) AS (SELECT u, v, u FROM und UNION SELECT w.eu, w.ev, e.v FROM walk w JOIN both_ways e ON e.u = w.x AND NOT (e.u = w.eu AND e.v = w.ev) AND NOT (e.u = w.ev AND e.v = w.eu))
SELECT u, v FROM und WHERE (u, v, v) NOT IN (SELECT eu, ev, x FROM walk)""")

from . import catalogue_synthesis  # noqa: E402, F401  registers the remaining queries
