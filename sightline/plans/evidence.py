"""Evidence against an index. Documents are read as files, parts as methods, orders as items, three of which belong to
one candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence
from ..operators.tables import read
from .base import query
from .candidates import pick

TEXT = "CAST({} AS VARCHAR(9))".format
K, C = "o_orderkey", "o_custkey"
_ITEM = {
    "item": K, "candidate": f"{K} - {K} % 3", "field": pick(K, "locations", "sources", "sinks"), "artifact": pick(f"{K} % 23", "manifest", "code", None, "code"),
    "path": f"CASE WHEN {K} % 46 = 0 THEN 'AndroidManifest.xml' ELSE 'd/' || {TEXT(f'{K} % 260')} END", "line": f"CASE {K} % 17 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 + {K} % 2 END",
    "scope_id": pick(f"{K} % 29", "S1", None, "S2", None, None), "expected_scope": pick(C, "S1", None, "S1"), "method_id": f"CASE WHEN {K} % 3 = 0 THEN 'm' || {TEXT(f'{K} % 260')} WHEN {K} % 31 = 1 THEN 'gone' END",
    "symbol_key": f"CASE WHEN {K} % 4 = 1 THEN 's' || {TEXT(f'{K} % 26')} WHEN {K} % 37 = 2 THEN 'none' END", "quoted_text": pick(f"{K} % 7", None, "e", "the", "qqq", None, None),
}
_METHOD = {"id": f"'m' || {TEXT('p_partkey')}", "path": f"'d/' || {TEXT('p_partkey % 260')}", "start": "1 + p_partkey % 2", "stop": "1 + p_partkey % 2 + p_partkey % 3", "symbol_key": f"'s' || {TEXT('p_partkey % 26')}"}
_CANDIDATE = {
    "candidate": K, "evidence_level": pick("o_custkey", "L1", "L2", "L3", "L2", None), "deterministic_chain_verified": "CASE o_custkey % 3 WHEN 0 THEN NULL ELSE o_custkey % 3 = 1 END",
    "dataflow_status": pick("o_custkey % 7", "verified", "not_proven", "interprocedural"), "guard_status": pick("o_custkey % 11", "absent", "unknown", "present_bypassable"),
    "authorization_status": pick("o_custkey % 13", "unprotected", "unknown", None), "dynamic_validation_status": pick("o_custkey % 17", "passed", None, None, None, None, None), "promotion_requested": "CASE o_custkey % 2 WHEN 0 THEN TRUE END", "gap": "o_custkey % 5 = 4",
}
_fields = lambda fields: ", ".join(f"{sql} AS {name}" for name, sql in fields.items())
_LINES = "regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r')"
_SQL = f"""
    WITH f AS (SELECT 'd/' || doc_id AS path, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS line_count, text AS content, {_LINES} AS lines FROM documents),
    m AS (SELECT {_fields(_METHOD)} FROM part), i AS (SELECT {_fields(_ITEM)} FROM orders),
    j AS (SELECT i.*, line_count, content, lines, m.path AS m_path, m.start, m.stop, m.symbol_key AS m_symbol FROM i LEFT JOIN f ON f.path = i.path LEFT JOIN m ON m.id = i.method_id),
    v AS (SELECT item, candidate, field, CASE
        WHEN scope_id <> expected_scope THEN 'SCOPE_ID_MISMATCH'
        WHEN field = 'locations' AND artifact = 'manifest' THEN CASE WHEN path <> 'AndroidManifest.xml' OR line < 1 THEN 'MANIFEST_LOCATION_INVALID' END
        WHEN line_count IS NULL OR line IS NULL OR line < 1 OR line > line_count THEN 'LOCATION_NOT_INDEXED' WHEN method_id IS NOT NULL AND m_path IS NULL THEN 'METHOD_ID_NOT_FOUND'
        WHEN symbol_key IS NOT NULL AND symbol_key NOT IN (SELECT symbol_key FROM m) THEN 'SYMBOL_KEY_NOT_FOUND' WHEN symbol_key IS NOT NULL AND method_id IS NOT NULL AND m_symbol <> symbol_key THEN 'METHOD_SYMBOL_MISMATCH'
        WHEN symbol_key IS NOT NULL AND method_id IS NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.symbol_key = j.symbol_key AND m.path = j.path AND j.line BETWEEN m.start AND m.stop) THEN 'SYMBOL_LOCATION_MISMATCH'
        WHEN method_id IS NOT NULL AND NOT (m_path = path AND line BETWEEN start AND stop) THEN 'METHOD_LOCATION_MISMATCH'
        WHEN (method_id IS NOT NULL OR symbol_key IS NOT NULL OR quoted_text IS NOT NULL) AND content IS NULL THEN 'INDEX_CONTENT_UNAVAILABLE'
        WHEN quoted_text IS NOT NULL AND NOT contains(array_to_string(lines[greatest(line - 1, 1):line + 1], chr(10)), quoted_text) THEN 'QUOTED_TEXT_MISMATCH' END AS reason FROM j)"""


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    some = lambda table, fields: read(spark, sf_dir, table).select(*[F.expr(sql).alias(name) for name, sql in fields.items()])
    text = F.coalesce("text", F.lit(""))
    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), (F.regexp_count(text, F.lit("\n")) + 1).alias("line_count"), F.col("text").alias("content"))
    return some("orders", _ITEM), files, some("part", _METHOD).withColumnRenamed("stop", "end")


@query(_SQL + " SELECT item, reason FROM v")
def evidence_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN8: why an item of evidence does not stand in the index, the first of ten codes."""
    return evidence.verified(*_frames(spark, sf_dir)).select("item", "reason")


@query(_SQL + f""", c AS (SELECT {_fields(_CANDIDATE)} FROM orders WHERE o_orderkey % 3 = 0),
    n AS (SELECT candidate, count(*) FILTER (field = 'locations' AND reason IS NULL) AS nl, count(*) FILTER (field = 'sources' AND reason IS NULL) AS ns, count(*) FILTER (field = 'sinks' AND reason IS NULL) AS nk, count(reason) > 0 AS bad FROM v GROUP BY 1),
    a AS (SELECT c.*, CASE WHEN evidence_level = 'L1' THEN 'L1' ELSE 'L2' END AS base, coalesce(nl, 0) AS l, coalesce(ns, 0) AS s, coalesce(nk, 0) AS k, coalesce(bad, FALSE) AS b FROM c LEFT JOIN n USING (candidate)),
    d AS (SELECT *, l > 0 AND (base = 'L1' OR (s > 0 AND k > 0)) AS complete FROM a),
    e AS (SELECT *, complete AND coalesce(deterministic_chain_verified, FALSE) AND dataflow_status <> 'not_proven' AS closed, gap OR b OR NOT complete AS critical, guard_status <> 'unknown' AND coalesce(authorization_status, '') <> 'unknown' AS gradeable FROM d)
    SELECT candidate, CASE WHEN b THEN 'invalid' WHEN complete THEN 'verified' ELSE 'incomplete' END AS fact_integrity, CASE WHEN base = 'L1' THEN 'not_applicable' WHEN closed THEN 'closed' ELSE 'not_proven' END AS semantic,
           CASE WHEN dynamic_validation_status = 'passed' THEN 'dynamically_confirmed' WHEN base = 'L2' AND closed AND NOT critical AND gradeable THEN 'statically_gradeable' ELSE 'pending' END AS exploitability,
           CASE WHEN (promotion_requested OR evidence_level = 'L3') AND base = 'L2' AND closed AND NOT critical AND gradeable THEN 'L3' ELSE base END AS level FROM e
""")
def evidence_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN8: integrity, closure and gradeability of candidates after their evidence was held against the index."""
    rows = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(*[F.expr(sql).alias(name) for name, sql in _CANDIDATE.items()])
    found = evidence.hold_against(*_frames(spark, sf_dir), rows, F.col("gap"))
    return found.select("candidate", "evidence.fact_integrity", "evidence.semantic", "evidence.exploitability", "evidence.level")
