"""Candidates, their routing and severity, authorization by direction and region, and scores against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lattice
from ..operators import decision, evaluation
from ..operators.tables import read
from .base import query

@query("""
    WITH d AS (SELECT coalesce(source, 'none') AS c, quality = 1 AS t, n_chars >= 1000 AS p FROM documents JOIN labels USING (doc_id)),
    n AS (SELECT c, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn
          FROM d WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY GROUPING SETS ((c), ())),
    s AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE round(tp / (tp + fp), 6) END AS "precision", CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE round(tp / (tp + fn), 6) END AS recall FROM n)
    SELECT coalesce(c, 'total') AS category, tp, fp, fn, tn, "precision", recall,
           CASE WHEN "precision" + recall = 0 THEN 0.0::DOUBLE ELSE round(2 * "precision" * recall / ("precision" + recall), 6) END AS f1 FROM s
""")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return evaluation.confusion(docs, F.col("quality") == 1, F.col("n_chars") >= 1000, "source")


_VALUE = "CASE WHEN {y} THEN {v} END"
#: The five metrics as averages by year of order, some of them missing on either side.
_METRICS = {
    "aggregate.explorer_hit_rate": ("o_orderstatus = 'F'", 1997, 1998), "aggregate.conditional_hit_rate": ("o_orderstatus = 'P'", 1997, 1996), "metrics.candidate.precision": ("o_orderpriority = '1-URGENT'", 1996, 1998),
    "metrics.candidate.recall": ("o_orderpriority = '2-HIGH'", 1998, 3000), "metrics.candidate.f1": ("o_orderpriority = '5-LOW'", 3000, 1997),
}


def _scores(side: int) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS metric, round(avg(CASE WHEN {test[0]} THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS value FROM orders WHERE year(o_orderdate) = {test[side]}" for name, test in _METRICS.items())


@query(f"""
    WITH a AS ({_scores(1)}), b AS ({_scores(2)}), c AS (SELECT metric, a.value AS current, b.value AS baseline, CASE WHEN metric LIKE '%.recall' THEN 0.02 WHEN metric LIKE '%.precision' THEN 0.5 ELSE 0.0 END AS tolerance FROM a JOIN b USING (metric)),
    v AS (SELECT *, round(baseline - current, 10) AS deficit, CASE WHEN baseline IS NULL THEN 'SKIP' WHEN current IS NULL OR round(baseline - current, 10) > tolerance THEN 'BLOCK' ELSE 'ALLOW' END AS verdict FROM c)
    SELECT metric, current, baseline, deficit, verdict, CASE WHEN bool_or(verdict = 'BLOCK') OVER () OR bool_and(verdict = 'SKIP') OVER () THEN 'BLOCK' ELSE 'ALLOW' END AS gate FROM v
""")
def baseline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN19: the listed metrics against a baseline, each with its tolerance, and the one gate over all of them."""
    orders = read(spark, sf_dir, "orders")

    def scores(side: int) -> DataFrame:
        aggs = [F.round(F.avg(F.when(F.year("o_orderdate") == spec[side], F.expr(f"CASE WHEN {spec[0]} THEN 1.0D ELSE 0.0D END"))), 4).alias(f"m{i}") for i, spec in enumerate(_METRICS.values())]
        pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"m{i}").alias("value")) for i, name in enumerate(_METRICS)])
        return orders.agg(*aggs).select(F.inline(pairs))

    return evaluation.gate(scores(1), scores(2), {"recall": 0.02, "precision": 0.5})


@query("""
    WITH r AS (SELECT o_custkey, count(*) AS claims, count(*) FILTER (o_orderstatus = 'F') AS hits FROM orders GROUP BY 1)
    SELECT c_mktsegment, count(*) AS runs, sum(hits)::BIGINT AS hits, sum(claims)::BIGINT AS claims, round(sum(hits) / nullif(sum(claims), 0), 6) AS hit_rate
    FROM customer JOIN r ON c_custkey = o_custkey GROUP BY 1
""")
def weighted_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits over claims of all runs; runs without claims have no rate and are left out."""
    runs = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("o_orderstatus") == "F").alias("hits"))
    joined = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(runs, "c_custkey")
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("runs"), F.sum("hits").alias("hits"), F.sum("claims").alias("claims"), F.round(F.sum("hits") / F.nullif(F.sum("claims"), F.lit(0)), 6).alias("hit_rate"))
