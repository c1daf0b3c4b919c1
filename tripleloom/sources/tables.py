"""Knowledge graphs over the star-schema tables, and the same mapping in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import RDF_TYPE, Graph


def _name(kind: str, key: str) -> F.Column:
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def _edge(df: DataFrame, s: F.Column, p: F.Column | str, o: F.Column, literal: bool = False, distinct: tuple[str, ...] = ()) -> DataFrame:
    """Edges of a table; ``distinct`` names the columns that make an edge, so that keys are made distinct and not names."""
    df = df.select(*distinct).distinct() if distinct else df
    return df.select(s.alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.alias("o"), F.lit(literal).alias("o_is_literal"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The typed star schema with literals: 11 relations, six classes, hubs at the nations."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    nation, customer, supplier, part, orders, line, region = map(t, ("nation", "customer", "supplier", "part", "orders", "lineitem", "region"))
    pair = nation.select("n_nationkey", "n_regionkey").join(nation.select(F.col("n_nationkey").alias("m"), "n_regionkey"), "n_regionkey").filter("n_nationkey <> m")
    kinds = (("Customer", customer, "c_custkey"), ("Supplier", supplier, "s_suppkey"), ("Order", orders, "o_orderkey"), ("Part", part, "p_partkey"), ("Nation", nation, "n_nationkey"), ("Region", region, "r_regionkey"))
    # keys make most mappings duplicate-free; only what comes from line items has to be made distinct
    made = [
        _edge(nation, _name("nation", "n_nationkey"), "inRegion", _name("region", "n_regionkey")),
        _edge(customer, _name("customer", "c_custkey"), "inNation", _name("nation", "c_nationkey")),
        _edge(supplier, _name("supplier", "s_suppkey"), "inNation", _name("nation", "s_nationkey")),
        _edge(orders, _name("order", "o_orderkey"), "placedBy", _name("customer", "o_custkey")),
        _edge(line, _name("order", "l_orderkey"), "hasPart", _name("part", "l_partkey"), distinct=("l_orderkey", "l_partkey")),
        _edge(line, _name("order", "l_orderkey"), "suppliedBy", _name("supplier", "l_suppkey"), distinct=("l_orderkey", "l_suppkey")),
        _edge(line, _name("supplier", "l_suppkey"), "supplies", _name("part", "l_partkey"), distinct=("l_suppkey", "l_partkey")),
        _edge(pair, _name("nation", "n_nationkey"), "peerOf", _name("nation", "m")),
        _edge(customer, _name("customer", "c_custkey"), "segment", F.col("c_mktsegment"), literal=True),
        _edge(orders, _name("order", "o_orderkey"), "priority", F.col("o_orderpriority"), literal=True),
        _edge(part, _name("part", "p_partkey"), "brand", F.col("p_brand"), literal=True),
        *(_edge(df, _name(kind.lower(), key), RDF_TYPE, F.lit(f"class/{kind}")) for kind, df, key in kinds),
    ]
    return Graph(reduce(DataFrame.union, made), distinct=True)


def category_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Predicates made from categories: 31 relations and many characteristic sets."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    line, orders, events, customer = map(t, ("lineitem", "orders", "events", "customer"))
    events = events.select("user_id", "event_type", F.to_date("ts").alias("day"))
    # each table's edges have predicates of their own, so only repeats within a table have to go
    made = [
        _edge(line, _name("order", "l_orderkey"), F.concat(F.lit("hasPart_"), "l_returnflag", "l_linestatus"), _name("part", "l_partkey"), distinct=("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")),
        _edge(orders, _name("order", "o_orderkey"), F.concat(F.lit("placedBy_"), F.substring("o_orderpriority", 1, 1), "o_orderstatus"), _name("customer", "o_custkey")),
        _edge(events, _name("user", "user_id"), F.concat(F.lit("did_"), "event_type"), F.concat(F.lit("day/"), F.date_format("day", "yyyy-MM-dd")), distinct=("user_id", "event_type", "day")),
        _edge(customer, _name("customer", "c_custkey"), F.concat(F.lit("inNation_"), "c_mktsegment"), _name("nation", "c_nationkey")),
    ]
    return Graph(reduce(DataFrame.union, made), distinct=True)


def geography_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations and regions: a small graph whose degrees stay below the guard of exact enumeration."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    pair = nation.select("n_nationkey", "n_regionkey").join(nation.select(F.col("n_nationkey").alias("m"), "n_regionkey"), "n_regionkey").filter("n_nationkey < m and (n_nationkey + m) % 3 <> 0")
    initial = F.concat(F.lit("letter/"), F.substring("n_name", 1, 1))
    made = [_edge(nation, _name("nation", "n_nationkey"), "inRegion", _name("region", "n_regionkey")), _edge(pair, _name("nation", "n_nationkey"), "near", _name("nation", "m")), _edge(nation, _name("nation", "n_nationkey"), "initial", initial)]
    return Graph(reduce(DataFrame.union, made), distinct=True)


_T = RDF_TYPE
GEOGRAPHY_SQL = """
edges AS (
  SELECT 'nation/' || n_nationkey AS s, 'inRegion' AS p, 'region/' || n_regionkey AS o, FALSE AS lit FROM nation
  UNION ALL SELECT 'nation/' || a.n_nationkey, 'near', 'nation/' || b.n_nationkey, FALSE FROM nation a JOIN nation b
            ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND (a.n_nationkey + b.n_nationkey) % 3 <> 0
  UNION ALL SELECT 'nation/' || n_nationkey, 'initial', 'letter/' || substr(n_name, 1, 1), FALSE FROM nation)"""
STAR_SQL = f"""
edges AS (
  SELECT 'nation/' || n_nationkey AS s, 'inRegion' AS p, 'region/' || n_regionkey AS o, FALSE AS lit FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'inNation', 'nation/' || c_nationkey, FALSE FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'inNation', 'nation/' || s_nationkey, FALSE FROM supplier
  UNION ALL SELECT 'order/' || o_orderkey, 'placedBy', 'customer/' || o_custkey, FALSE FROM orders
  UNION ALL SELECT DISTINCT 'order/' || l_orderkey, 'hasPart', 'part/' || l_partkey, FALSE FROM lineitem
  UNION ALL SELECT DISTINCT 'order/' || l_orderkey, 'suppliedBy', 'supplier/' || l_suppkey, FALSE FROM lineitem
  UNION ALL SELECT DISTINCT 'supplier/' || l_suppkey, 'supplies', 'part/' || l_partkey, FALSE FROM lineitem
  UNION ALL SELECT 'nation/' || a.n_nationkey, 'peerOf', 'nation/' || b.n_nationkey, FALSE
            FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
  UNION ALL SELECT 'customer/' || c_custkey, 'segment', c_mktsegment, TRUE FROM customer
  UNION ALL SELECT 'order/' || o_orderkey, 'priority', o_orderpriority, TRUE FROM orders
  UNION ALL SELECT 'part/' || p_partkey, 'brand', p_brand, TRUE FROM part
  UNION ALL SELECT 'customer/' || c_custkey, '{_T}', 'class/Customer', FALSE FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, '{_T}', 'class/Supplier', FALSE FROM supplier
  UNION ALL SELECT 'order/' || o_orderkey, '{_T}', 'class/Order', FALSE FROM orders
  UNION ALL SELECT 'part/' || p_partkey, '{_T}', 'class/Part', FALSE FROM part
  UNION ALL SELECT 'nation/' || n_nationkey, '{_T}', 'class/Nation', FALSE FROM nation
  UNION ALL SELECT 'region/' || r_regionkey, '{_T}', 'class/Region', FALSE FROM region)"""
CATEGORY_SQL = """
edges AS (
  SELECT DISTINCT 'order/' || l_orderkey AS s, 'hasPart_' || l_returnflag || l_linestatus AS p, 'part/' || l_partkey AS o, FALSE AS lit FROM lineitem
  UNION SELECT 'order/' || o_orderkey, 'placedBy_' || substr(o_orderpriority, 1, 1) || o_orderstatus, 'customer/' || o_custkey, FALSE FROM orders
  UNION SELECT 'user/' || user_id, 'did_' || event_type, 'day/' || strftime(ts, '%Y-%m-%d'), FALSE FROM events
  UNION SELECT 'customer/' || c_custkey, 'inNation_' || c_mktsegment, 'nation/' || c_nationkey, FALSE FROM customer)"""
#: The views of :class:`Graph` in SQL, to follow one of the mappings.
VIEWS_SQL = f"""
names AS (SELECT name, min(lit::INT) = 1 AS lit FROM (SELECT s AS name, FALSE AS lit FROM edges UNION ALL SELECT o, lit FROM edges) GROUP BY name),
classes AS (SELECT DISTINCT o AS name FROM edges WHERE p = '{_T}'),
entities AS (SELECT name FROM names WHERE NOT lit AND name NOT IN (SELECT name FROM classes)),
content AS (SELECT s, p, o FROM edges WHERE p <> '{_T}' AND s <> o AND NOT lit),
und AS (SELECT DISTINCT least(s, o) AS u, greatest(s, o) AS v FROM edges WHERE s <> o),
both_ways AS (SELECT u, v FROM und UNION ALL SELECT v, u FROM und),
deg AS (SELECT u AS name, count(*) AS d FROM both_ways GROUP BY u),
cdeg AS (SELECT e.name, coalesce(a.n, 0) AS dout, coalesce(b.n, 0) AS din FROM entities e
  LEFT JOIN (SELECT s AS name, count(*) AS n FROM edges WHERE p <> '{_T}' GROUP BY s) a ON a.name = e.name
  LEFT JOIN (SELECT o AS name, count(*) AS n FROM edges WHERE p <> '{_T}' GROUP BY o) b ON b.name = e.name),
cs AS (SELECT s AS name, string_agg(p, ' ' ORDER BY p) AS cs, count(*) AS n FROM (SELECT DISTINCT s, p FROM edges) GROUP BY s),
inv AS (SELECT o AS name, string_agg(p, ' ' ORDER BY p) AS cs, count(*) AS n FROM (SELECT DISTINCT o, p FROM edges WHERE NOT lit) GROUP BY o)"""
