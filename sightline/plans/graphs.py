"""Reachability over graphs made of orders and their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.tables import read
from .base import query

_CHAIN_SQL = "e AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst, o_orderstatus FROM orders)"
_PART_SQL = """e AS (SELECT DISTINCT l_partkey AS src, dst FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem)
    WHERE dst IS NOT NULL AND dst <> l_partkey)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each order to the next one of its customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each part to the next one of the same order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))


@query(f"""
    WITH RECURSIVE {_CHAIN_SQL}, r(v, d) AS (
        SELECT o_orderkey, 0::BIGINT FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000
        UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.v WHERE e.dst IS NOT NULL)
    SELECT v AS vertex, min(d) AS depth FROM r GROUP BY v
""")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select(F.col("o_orderkey").alias("vertex"))
    return graph.reach(_chain(spark, sf_dir), seeds)


@query(f"""
    WITH RECURSIVE {_PART_SQL}, r(v, d) AS (
        SELECT p_partkey, 0::BIGINT FROM part WHERE p_size = 50 AND p_brand = 'Brand#4'
        UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.v WHERE r.d < 8)
    SELECT v AS vertex, min(d) AS depth FROM r GROUP BY v
""")
def bounded_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR2: what some parts reach within eight steps."""
    seeds = read(spark, sf_dir, "part").where("p_size = 50 and p_brand = 'Brand#4'").select(F.col("p_partkey").alias("vertex"))
    return graph.reach(_parts(spark, sf_dir), seeds, 8)


@query(f"""
    WITH RECURSIVE {_CHAIN_SQL}, r(v, d) AS (
        SELECT o_orderkey, 0::BIGINT FROM orders WHERE o_totalprice > 450000
        UNION SELECT e.src, r.d + 1 FROM r JOIN e ON e.dst = r.v WHERE r.d < 7)
    SELECT v AS vertex, min(d) AS depth FROM r GROUP BY v
""")
def reverse_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_orderkey").alias("vertex"))
    return graph.reach_back(_chain(spark, sf_dir), targets, 7)


@query(f"""
    WITH RECURSIVE {_CHAIN_SQL}, r(v, root) AS (
        SELECT o_orderkey, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'
        UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.v WHERE e.dst IS NOT NULL)
    SELECT v AS vertex, min(root) AS root FROM r GROUP BY v
""")
def smallest_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("vertex"))
    return graph.rooted(_chain(spark, sf_dir), roots)


@query(f"""
    WITH RECURSIVE {_PART_SQL}, r(v, d) AS (SELECT min(p_partkey), 0::BIGINT FROM part UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.v WHERE r.d < 8),
    n AS (SELECT depth, count(*) AS n, sum(count(*)) OVER (ORDER BY depth) AS nodes FROM (SELECT v, min(d) AS depth FROM r GROUP BY v) GROUP BY depth),
    full_ AS (SELECT min(depth) AS depth FROM n WHERE nodes >= 500 AND depth BETWEEN 1 AND 8)
    SELECT n.depth, n, CASE WHEN full_.depth IS NOT NULL THEN 'node_limit' WHEN (SELECT max(depth) FROM n) = 8 THEN 'depth_limit' END AS ended FROM n, full_ WHERE n.depth <= coalesce(full_.depth, 8)
""")
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR3: the levels of a breadth-first tree within eight levels and 500 nodes, and why growth ended early."""
    entry = read(spark, sf_dir, "part").agg(F.min("p_partkey").alias("vertex"))
    nodes, reason = graph.tree(_parts(spark, sf_dir), entry)
    return nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).withColumn("ended", F.lit(reason).cast("string"))


@query(f"""
    WITH RECURSIVE {_PART_SQL}, r(v, d) AS (SELECT min(p_partkey), 0::BIGINT FROM part UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.v WHERE r.d < 8),
    l AS (SELECT v, min(d) AS depth FROM r GROUP BY v), n AS (SELECT depth, sum(count(*)) OVER (ORDER BY depth) AS nodes FROM l GROUP BY depth), last AS (SELECT min(depth) AS depth FROM n WHERE nodes >= 500 AND depth >= 1),
    a AS (SELECT v FROM l, last WHERE l.depth < coalesce(last.depth, CASE WHEN (SELECT max(depth) FROM l) = 8 THEN 8 ELSE 9 END))
    SELECT src, 'edge' AS relation, dst::VARCHAR AS dst FROM e WHERE src IN (SELECT v FROM a) UNION ALL SELECT l_partkey, 'gap', l_orderkey || ':' || l_linenumber FROM lineitem WHERE l_suppkey % 7 = 0 AND l_partkey IN (SELECT v FROM a)
""")
def call_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR3: the edges and gaps of the tree of tree_levels."""
    entry = read(spark, sf_dir, "part").agg(F.min("p_partkey").alias("vertex"))
    nodes, ended = graph.tree(_parts(spark, sf_dir), entry)
    none = F.lit(None)
    sure = _parts(spark, sf_dir).where("dst is not null and src <> dst").select("src", "dst", F.lit("resolved").alias("status"), none.cast("string").alias("name"))
    loose = read(spark, sf_dir, "lineitem").where("l_suppkey % 7 = 0").select(F.col("l_partkey").alias("src"), none.cast("long").alias("dst"), F.lit("ambiguous").alias("status"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("name"))
    return graph.tree_relations(nodes, ended, sure.unionByName(loose))


@query("""
    WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, k::INTEGER AS k FROM n WHERE k <= 8
""")
def first_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR4: the first eight calls of each caller in line order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return read(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w)).where("k <= 8").select("l_orderkey", "l_linenumber", "l_partkey", "k")
