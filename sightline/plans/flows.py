"""Summaries of parameters, values of variables and overlapping spans. Customers are read as methods, orders as calls and
spans, lines of orders as events of variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flow, resolution
from ..operators.tables import read
from .base import query

_TARGET = "1 + (o_custkey * 2 + o_orderkey % 2) % 1499"


@query(f"""
    WITH RECURSIVE o AS (SELECT o_custkey AS m, o_orderkey % 3 AS slot, {_TARGET} AS t, o_orderkey % 4 AS b, o_orderkey % 7 <> 0 AND o_orderkey % 3 = o_custkey % 3 AS returned FROM orders),
    e AS (SELECT m, slot, t, 0 AS argument, returned FROM o UNION SELECT m, 1, t, 1, returned FROM o WHERE b = 0 UNION SELECT m, 2, t, 1, returned FROM o WHERE b = 0),
    f AS (SELECT c_custkey AS m, 'sink' AS category, c_custkey % 2 AS slot FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'return', 0 FROM customer WHERE c_custkey % 7 = 0
          UNION ALL SELECT c_custkey, 'mutation', 1 FROM customer WHERE c_custkey % 11 = 0),
    r(m, category, slot) AS (SELECT * FROM f UNION SELECT e.m, r.category, e.slot FROM r JOIN e ON e.t = r.m AND e.argument = r.slot AND (e.returned OR r.category <> 'return'))
    SELECT m AS method, category, slot FROM r
""")
def taint_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF7: the parameters of each method that reach its return, a sink or a mutation, through any calls."""
    customers, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    parameters = customers.select(F.col("c_custkey").alias("method"), F.explode(F.expr("array(0, 1, 2)")).alias("slot")).withColumn("name", F.concat(F.lit("p"), "slot"))
    calls = orders.selectExpr(
        "o_custkey AS method", f"{_TARGET} AS target", "array(concat('f(p', o_orderkey % 3, ')'), IF(o_orderkey % 4 = 0, 'p1 + p2', 'x.p9')) AS arguments", "IF(o_orderkey % 7 <> 0, concat('v', o_orderkey % 3), NULL) AS assigned_to"
    )
    returns = customers.selectExpr("c_custkey AS method", "concat('g(v', c_custkey % 3, ')') AS expression")
    fact = lambda every, category, slot: customers.where(f"c_custkey % {every} = 0").selectExpr("c_custkey AS method", f"'{category}' AS category", f"{slot} AS slot")
    facts = fact(5, "sink", "c_custkey % 2").unionByName(fact(7, "return", "0")).unionByName(fact(11, "mutation", "1"))
    found, _ = flow.summaries(parameters, calls, returns, facts)
    return found.select("method", "category", "slot")


_EVENT = "l_orderkey AS method, 'v' || CAST(l_suppkey % 2 AS VARCHAR(1)) AS variable, l_linenumber * CAST(1000000000 AS BIGINT) + l_partkey * 1000 + l_suppkey % 1000 AS ordinal, CASE l_partkey % 5 WHEN 0 THEN 'define' WHEN 1 THEN 'kill' WHEN 2 THEN 'add' WHEN 3 THEN 'add' ELSE 'use' END AS kind, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'a' || CAST(l_suppkey % 10 AS VARCHAR(2)) END AS value"


@query(f"""
    WITH e AS (SELECT DISTINCT {_EVENT} FROM lineitem),
    u AS (SELECT u.method, u.variable, u.ordinal, max(d.ordinal) AS since FROM e u LEFT JOIN e d ON d.method = u.method AND d.variable = u.variable AND d.ordinal < u.ordinal AND d.kind IN ('define', 'kill') WHERE u.kind = 'use' GROUP BY ALL)
    SELECT u.method, u.variable, u.ordinal, coalesce(array_to_string(list(v.value ORDER BY v.ordinal) FILTER (v.kind IN ('define', 'add')), ','), '') AS held,
           coalesce(bool_or(v.ordinal = u.since AND v.kind = 'define'), FALSE) AS known
    FROM u LEFT JOIN e v ON v.method = u.method AND v.variable = u.variable AND v.ordinal < u.ordinal AND v.ordinal >= coalesce(u.since, -1) GROUP BY u.method, u.variable, u.ordinal
""")
def values_at_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP17, JN18: what a variable holds where it is used: what was put in since it was last made, unless it was lost."""
    events = read(spark, sf_dir, "lineitem").selectExpr(*_EVENT.split(", ")).dropDuplicates()
    return flow.held_values(events, ["method"]).select("method", "variable", "ordinal", F.array_join("values", ",").alias("held"), "known")


_SPAN = "o_custkey AS k, o_orderkey AS id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS start, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + 20 * (o_orderkey % 30) AS stop"


@query(f"""
    WITH s AS (SELECT {_SPAN} FROM orders)
    SELECT a.id AS reference, b.id AS context FROM s a JOIN s b ON a.k = b.k AND a.start <= b.stop AND b.start <= a.stop WHERE a.id % 2 = 0 AND b.id % 3 = 0
""")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN9: references and the contexts of the same file that share a line with them."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    spans = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), day.alias("start"), (day + 20 * (F.col("o_orderkey") % 30)).cast("int").alias("end"))
    return resolution.overlapping(spans.where("id % 2 = 0").withColumnRenamed("id", "reference"), spans.where("id % 3 = 0").withColumnRenamed("id", "context"), "k", "reference", "context")
