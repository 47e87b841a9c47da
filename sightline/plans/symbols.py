"""Targets of calls. Parts are read as methods of classes in five packages, orders as calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import symbols
from ..operators.tables import read
from .base import query
from .candidates import pick

TEXT = "CAST({} AS VARCHAR(9))".format
_CLASS = lambda k: f"'p' || {TEXT(f'({k}) % 5')} || '.C' || {TEXT(f'({k}) % 211')}"
_METHODS = {
    "id": "p_partkey", "name": pick("p_partkey", "run", "stop", "get"), "qualified_class": f"CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE {_CLASS('p_partkey')} END",
    "descriptor": pick("p_partkey % 17 + p_partkey % 2", "(a.X,int)", "(b.X,int)", "(?,int)", "()", "(a.Y,int)", "(X)", None),
}
K = "o_orderkey"
_CALLS = {
    "call": K, "method": "o_custkey", "method_name": pick(f"{K} % 7", "run", "stop", "get", "none"), "descriptor": pick(f"{K} % 19", "(X,int)", "(?,?)", "()", "(X,long)", "(c.X)", None),
    "receiver_text": pick(f"{K} % 11", "", "this", "super", "x", None), "receiver_type": pick(f"{K} % 13", "", None, "this", "X9", "dotted", "near", "jvm"), "caller_class": f"CASE WHEN o_custkey % 71 = 0 THEN '' ELSE {_CLASS('o_custkey')} END",
}
_TYPE = f"CASE receiver_type WHEN 'dotted' THEN {_CLASS('o_custkey + 3')} WHEN 'near' THEN 'C' || {TEXT('o_custkey % 211')} WHEN 'jvm' THEN 'Lp' || {TEXT('(o_custkey + 1) % 5')} || '/C' || {TEXT('(o_custkey + 1) % 211')} || ';' ELSE receiver_type END"
_LAST = "CASE WHEN {0} LIKE '(%)' AND length({0}) > 2 THEN list_transform(string_split({0}[2:-2], ','), lambda x: string_split(x, '.')[-1]) ELSE [] END".format
_PACKAGE = "CASE WHEN contains({0}, '.') THEN split_part({0}, '.', 1) ELSE '' END".format
_SQL = f"""
    WITH m AS (SELECT *, {_LAST('descriptor')} AS types FROM (SELECT {", ".join(f"{v} AS {k}" for k, v in _METHODS.items())} FROM part) WHERE qualified_class IS NOT NULL),
    c0 AS (SELECT o_custkey, {", ".join(f"{v} AS {k}" for k, v in _CALLS.items())} FROM orders), c1 AS (SELECT * REPLACE ({_TYPE} AS receiver_type) FROM c0),
    c AS (SELECT *, {_LAST('descriptor')} AS wanted, coalesce(receiver_text, '') AS text, coalesce(receiver_type, '') AS type, {_PACKAGE('caller_class')} AS caller_package, trim(replace(coalesce(receiver_type, ''), '/', '.'), 'L;') AS plain FROM c1),
    r AS (SELECT *, CASE WHEN type = '' THEN NULL WHEN plain IN ('this', 'super') THEN nullif(caller_class, '') WHEN contains(plain, '.') THEN plain
                         WHEN caller_package || '.' || plain IN (SELECT qualified_class FROM m) THEN caller_package || '.' || plain END AS receiver_class FROM c),
    own AS (SELECT r.call, m.id, r.wanted, m.types FROM r JOIN m ON m.name = r.method_name AND len(m.types) = len(r.wanted) AND m.qualified_class = CASE WHEN type = '' AND text IN ('', 'this') THEN caller_class ELSE receiver_class END WHERE text <> 'super'),
    around AS (SELECT r.call, m.id, r.wanted, m.types FROM r JOIN m ON m.name = r.method_name AND len(m.types) = len(r.wanted) AND {_PACKAGE('m.qualified_class')} = caller_package WHERE type = '' AND text IN ('', 'this') AND r.call NOT IN (SELECT call FROM own)),
    fit AS (SELECT call, id FROM (SELECT * FROM own UNION ALL SELECT * FROM around) WHERE len(wanted) = 0 OR len(list_filter(list_zip(wanted, types), lambda p: p[1] <> '?' AND p[2] <> '?' AND p[1] <> p[2])) = 0),
    n AS (SELECT call, count(*) AS n, min(id) AS id FROM fit GROUP BY call),
    s AS (SELECT r.call, r.method, r.method_name, coalesce(n.n, 0) AS n, CASE WHEN n.n = 1 THEN id END AS target, CASE WHEN n.n IS NULL THEN 'pending' WHEN n.n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM r LEFT JOIN n USING (call))
"""


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    calls = read(spark, sf_dir, "orders").select("o_custkey", *[F.expr(v).alias(k) for k, v in _CALLS.items()])
    methods = read(spark, sf_dir, "part").select(*[F.expr(v).alias(k) for k, v in _METHODS.items()])
    return calls.withColumn("receiver_type", F.expr(_TYPE)).drop("o_custkey"), methods


@query(_SQL + " SELECT call, status, target, n FROM s")
def symbol_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1, JN2, JN3: the target of each call by receiver, class or package, with compatible parameters."""
    return symbols.targets(*_frames(spark, sf_dir))


@query(_SQL + """ SELECT DISTINCT method::VARCHAR AS method, 'callee' AS relation, target::VARCHAR AS other FROM s WHERE status = 'resolved' UNION ALL SELECT DISTINCT target::VARCHAR, 'caller', method::VARCHAR FROM s WHERE status = 'resolved'
    UNION ALL SELECT method::VARCHAR, 'SYMBOL_TARGET_AMBIGUOUS', call || ':' || method_name FROM s WHERE status = 'ambiguous'""")
def call_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5: callers and callees of methods, and calls with several targets."""
    calls, methods = _frames(spark, sf_dir)
    found = symbols.targets(calls, methods).join(calls.select("call", "method", F.col("method_name").alias("name")), "call")
    return symbols.relations(found.withColumn("line", F.col("call")))
