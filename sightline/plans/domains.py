"""Coverage of candidates. Orders are read as candidates, suppliers as gaps: fields are expressions over their numbers that
Spark and DuckDB read alike; SQL holds every gap against every candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage
from ..operators.tables import read
from .base import query
from .candidates import pick

K, C, S = "o_orderkey", "o_custkey", "s_suppkey"
TEXT = "CAST({} AS VARCHAR(9))".format
_FIELDS = {
    "component_name": f"CASE WHEN {C} % 23 = 0 THEN NULL ELSE 'com.a.C' || {TEXT(f'{C} % 20')} || CASE WHEN {C} % 3 = 0 THEN '$In' ELSE '' END END",
    "rule_id": f"'R' || {TEXT(f'{K} % 7')}", "extra_rule": f"CASE WHEN {K} % 5 = 0 THEN 'R8' END", "scope_key": f"'S' || {TEXT(f'{C} % 3')}",
    "authorization_operation": pick(C, "read", "write", None, ""), "path": f"'com/a/P' || {TEXT(f'{C} % 30')} || '.java'", "method_id": f"'m' || {TEXT(f'{K} % 11')}",
    "qualified_class": f"CASE WHEN {K} % 2 = 0 THEN 'com.a.K' || {TEXT(f'{C} % 9')} END", "entry": f"'e' || {TEXT(f'{C} % 6')}", "analysis_status": pick(K, "ai_completed", "ai_failed", None, "ai_skipped", "ai_completed", "ai_incomplete", "ai_completed"),
    "chain": f"CASE {C} % 3 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END", "own_impact": pick(f"{K} % 31", "negative_proof", None, None, None, None, None),
}
_GAPS = {
    "code": f"'G' || {TEXT(f'{S} % 40')}", "scope_id": f"CASE WHEN {S} % 4 = 1 THEN 'S' || {TEXT(f'{S} % 3')} END",
    "path": f"CASE {S} % 6 WHEN 0 THEN 'com/a/P' || {TEXT(f'{S} % 30')} || '.java' WHEN 3 THEN 'com/a/C' || {TEXT(f'{S} % 20')} || '.kt' END",
    "method_id": f"CASE {S} % 7 WHEN 2 THEN 'm' || {TEXT(f'{S} % 11')} WHEN 4 THEN 'e' || {TEXT(f'{S} % 6')} END",
    "qualified_class": f"CASE {S} % 9 WHEN 1 THEN 'com.a.K' || {TEXT(f'{S} % 9')} WHEN 2 THEN 'com.a.C' || {TEXT(f'{S} % 20')} END",
    "component_name": f"CASE WHEN {S} % 8 = 5 THEN 'com.a.C' || {TEXT(f'{S} % 20')} END", "rule_id": f"CASE {S} % 5 WHEN 2 THEN 'R' || {TEXT(f'{S} % 7')} WHEN 3 THEN 'R8' END",
    "operation": f"CASE WHEN {S} % 11 = 6 THEN 'read' END", "claim_impact": pick(S, "positive_proof", "negative_proof", "odd", None),
    "affects_positive_proof": f"CASE WHEN {S} % 3 = 0 THEN TRUE END", "affects_negative_proof": f"CASE WHEN {S} % 5 = 0 THEN TRUE WHEN {S} % 5 = 1 THEN FALSE END",
}
_SKIPPED = "'com/a/P' || CAST(p_partkey % 1000 AS VARCHAR(9)) || '.java'", "p_partkey % 1000 > 27"
_LISTS = "[path, replace(split_part(component_name, '$', 1), '.', '/') || '.java', replace(split_part(component_name, '$', 1), '.', '/') || '.kt'] AS files, [method_id, entry] AS methods, [qualified_class, component_name] AS classes, [rule_id, extra_rule] AS rules"
_IMPACT = """CASE WHEN claim_impact IN ('positive_proof', 'negative_proof') THEN claim_impact WHEN coalesce(affects_positive_proof, FALSE) AND NOT coalesce(affects_negative_proof, FALSE) THEN 'positive_proof'
        WHEN coalesce(affects_negative_proof, FALSE) AND NOT coalesce(affects_positive_proof, FALSE) THEN 'negative_proof' ELSE 'both' END"""
_STATED = "coalesce(g.scope_id, g.path, g.method_id, g.qualified_class, g.component_name, g.rule_id, g.operation) IS NOT NULL"
_WITH = f"""
    WITH f AS (SELECT {K} AS candidate, {", ".join(f"{sql} AS {name}" for name, sql in _FIELDS.items())} FROM orders), c AS (SELECT *, {_LISTS} FROM f),
    g0 AS (SELECT {S} AS gap, {", ".join(f"{sql} AS {name}" for name, sql in _GAPS.items())} FROM supplier), g AS (SELECT * REPLACE ({_IMPACT} AS claim_impact) FROM g0),
    pairs AS (
        SELECT candidate, gap, g.code, g.claim_impact FROM c JOIN g ON {_STATED}
         AND (g.scope_id IS NULL OR g.scope_id = c.scope_key) AND (g.path IS NULL OR list_contains(files, g.path)) AND (g.method_id IS NULL OR list_contains(methods, g.method_id))
         AND (g.qualified_class IS NULL OR list_contains(classes, g.qualified_class)) AND (g.component_name IS NULL OR g.component_name = c.component_name)
         AND (g.rule_id IS NULL OR list_contains(rules, g.rule_id)) AND (g.operation IS NULL OR g.operation = c.authorization_operation))"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = read(spark, sf_dir, "orders").select(F.col(K).alias("candidate"), *[F.expr(sql).alias(name) for name, sql in _FIELDS.items()])
    return flat.select(
        "candidate", "component_name", "rule_id", F.array("extra_rule").alias("rule_ids"), "scope_key", "authorization_operation", F.array("entry").alias("entry_points"), "analysis_status",
        F.col("chain").alias("deterministic_chain_verified"), F.array(F.struct("path", "method_id"), F.struct(F.lit(None).cast("string").alias("path"), F.lit("").alias("method_id"))).alias("locations"),
        F.array(F.struct("qualified_class")).alias("sinks"), F.when(F.col("own_impact").isNotNull(), F.array(F.struct(F.lit("OWN").alias("code"), F.col("own_impact").alias("claim_impact")))).alias("coverage_gaps"),
    )


def _run_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.normalized(read(spark, sf_dir, "supplier").select(F.col(S).alias("gap"), *[F.expr(sql).alias(name) for name, sql in _GAPS.items()]), "run")


@query(_WITH + " SELECT candidate, gap FROM pairs")
def gaps_of_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT8, SP41: gaps apply to the candidates that hold every field that their domain states."""
    return coverage.applicable(_run_gaps(spark, sf_dir), _rows(spark, sf_dir), "gap", "candidate")


@query(_WITH + f""", s AS (SELECT DISTINCT {_SKIPPED[0]} AS path FROM part WHERE {_SKIPPED[1]}),
    every AS (
        SELECT candidate, code, claim_impact <> 'negative_proof' AS p, claim_impact <> 'positive_proof' AS n FROM pairs
        UNION ALL SELECT candidate, 'INDEX_FILES_SKIPPED', TRUE, TRUE FROM c WHERE path IN (SELECT path FROM s)
        UNION ALL SELECT candidate, 'OWN', own_impact <> 'negative_proof', own_impact <> 'positive_proof' FROM c WHERE own_impact IS NOT NULL
        UNION ALL SELECT candidate, CASE analysis_status WHEN 'ai_failed' THEN 'AI_ANALYSIS_FAILED' WHEN 'ai_skipped' THEN 'AI_ANALYSIS_SKIPPED' ELSE 'AI_ANALYSIS_INCOMPLETE' END, NOT coalesce(chain, FALSE), TRUE
          FROM c WHERE analysis_status IN ('ai_failed', 'ai_skipped', 'ai_incomplete')),
    a AS (SELECT candidate, array_to_string(list_sort(list_distinct(list(code))), ',') AS gap_codes, bool_or(p) AS p, bool_or(n) AS n FROM every GROUP BY candidate),
    open AS (SELECT count(*) > 0 AS everywhere FROM g WHERE NOT ({_STATED}) AND claim_impact <> 'positive_proof')
    SELECT c.candidate, coalesce(gap_codes, '') AS gap_codes, NOT coalesce(p, FALSE) AS positive_proof_complete, NOT coalesce(n, FALSE) AND NOT everywhere AS negative_proof_complete, a.candidate IS NOT NULL AS analysis_incomplete
    FROM c LEFT JOIN a USING (candidate), open
""")
def coverage_finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN5, FN6: what the gaps of a run, skipped files and unfinished analyses leave provable for each candidate."""
    skipped = read(spark, sf_dir, "part").where(_SKIPPED[1]).select(F.expr(_SKIPPED[0]).alias("path"))
    out = coverage.finalized(_rows(spark, sf_dir), "candidate", _run_gaps(spark, sf_dir), "gap", skipped)
    return out.withColumn("gap_codes", F.array_join("gap_codes", ","))
