"""Identity of nested candidates. Orders are read as candidates: a few small numbers of an order say what a candidate is,
others only shuffle its lists or change lines, texts and fields of a run. SQL groups by the numbers that count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings, funnel, identity
from ..operators.tables import read, written
from .base import query

#: s: component, e: entry, m: matrix, f: kind of flow, b: a Binder surface, p: path, d: ends, g: gaps, c: chain id, r: rule;
#: n: noise.
NUMBERS = {
    "s": "o_custkey % 5", "e": "o_custkey % 2", "m": "o_orderkey % 2", "f": "CASE o_custkey % 4 WHEN 0 THEN 1 ELSE 0 END", "b": "CASE o_custkey % 7 WHEN 3 THEN 1 ELSE 0 END",
    "p": "o_orderkey % 3", "d": "o_custkey % 3", "g": "o_orderkey % 3", "c": "o_custkey % 2", "r": "o_orderkey % 2", "n": "o_orderkey % 8",
}
_NUMBERS = ", ".join(f"{sql} AS {name}" for name, sql in NUMBERS.items())
#: The nested fields, in Spark's SQL over the numbers.
FIELDS = {
    "component": "element_at(array('activity', 'service', 'receiver', 'provider', 'service'), CAST(s AS INT) + 1)",
    "component_name": "IF(f = 1, concat('dynamic:a/b', s, '/c/D', n), concat('a.b.C', s))",
    "flow_kind": "IF(f = 1, 'receiver_exposure', 'source_to_sink')",
    "binder_remote_interface": "b = 1",
    "receiver_flag_tier": "IF(f = 1, 'unresolved_flag', NULL)",
    "receiver_binding": "IF(f = 1, named_struct('registration', named_struct('path', concat('a/b', s, '/c/D', n), 'line', n), 'actions', IF(n % 2 = 0, array('x', 'y', 'x'), array('y', 'x'))), NULL)",
    "entry_points": "IF(n % 2 = 0, array(concat('m', e), 'k'), array('k', concat('m', e), 'k'))",
    "entry_method_id": "IF(f = 1, concat('a#M', e, ':', n), concat('m', e))",
    "authorization_matrix": "IF(n % 2 = 0, array(named_struct('operation', 'read', 'path_region', named_struct('kind', 'exact', 'value', concat('/', m))), named_struct('operation', 'write', 'path_region', named_struct('kind', 'all', 'value', NULL))), array(named_struct('operation', 'write', 'path_region', named_struct('kind', 'all', 'value', NULL)), named_struct('operation', 'read', 'path_region', named_struct('kind', 'exact', 'value', concat('/', m)))))",
    "sources": "array(named_struct('path', concat('p', d), 'line', IF(f = 1, n, 7), 'method_id', IF(f = 1, concat('q', n), 'q'), 'kind', 'intent', 'text', concat('noise', n), 'ordinal', n))",
    "sinks": "array(named_struct('path', 'z', 'line', 9, 'taxonomy', concat('file', d), 'kind', 'sink', 'status', concat('noise', n)))",
    "propagation_paths": "transform(IF(p = 0, array('u', 'v', 'w'), IF(p = 1, array('v', 'u', 'w'), array('u', 'w'))), x -> named_struct('method_id', x, 'line', n, 'text', concat('noise', n)))",
    "blocking_gaps": "IF(g = 0, NULL, IF(n % 2 = 0, array(named_struct('code', 'A', 'critical', true, 'line', n), named_struct('code', 'B', 'critical', g = 1, 'line', 1)), array(named_struct('code', 'B', 'critical', g = 1, 'line', n), named_struct('code', 'A', 'critical', true, 'line', 2), named_struct('code', 'A', 'critical', true, 'line', 3))))",
    "guard_coverage": "named_struct('status', 'absent', 'line', n)",
    "chain_id": "IF(c = 0, NULL, concat('dfc_', o_orderkey))",
    "rule_id": "concat('R', r)",
    "risk_score": "CAST(o_custkey % 100 AS INT)",
    "review_status": "concat('noise', n)",
    "locations": "transform(sequence(0, CAST(o_orderkey % 4 AS INT)), x -> named_struct('path', concat('l', x), 'line', n))",
    "severity_hint": "element_at(array('low', 'high', 'medium'), CAST(o_orderkey % 3 AS INT) + 1)",
}
_SCOPE = "s, CASE WHEN b = 1 AND f = 1 THEN n END, f, CASE b WHEN 1 THEN -1 ELSE e END, m"
_CHAIN = "CASE WHEN b = 1 THEN 's' || s || CASE f WHEN 1 THEN n ELSE -1 END WHEN f = 1 THEN 'e' || e ELSE 'm' || e END, b, f, CASE b WHEN 1 THEN -1 ELSE d END, CASE b WHEN 1 THEN -1 ELSE p END, CASE f WHEN 1 THEN s END"
_FACT = "s, f, b, CASE b WHEN 1 THEN -1 ELSE e END, m, g, CASE c WHEN 0 THEN r END"
_BASE = f"WITH o AS (SELECT o_orderkey, {_NUMBERS} FROM orders)"


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested candidates, with their number as candidate."""
    numbers = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *[F.expr(sql).alias(name) for name, sql in NUMBERS.items()])
    return numbers.select(F.col("o_orderkey").alias("candidate"), *[F.expr(sql).alias(name) for name, sql in FIELDS.items()])


@query(f"""{_BASE} SELECT o_orderkey AS candidate, min(o_orderkey) OVER (PARTITION BY {_SCOPE}) AS same_scope, min(o_orderkey) OVER (PARTITION BY {_CHAIN}) AS same_chain,
       min(o_orderkey) OVER (PARTITION BY {_FACT}) AS same_facts FROM o""")
def funnel_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN1, FLT10, SC19: for each key of a candidate the first candidate that has the same."""
    rows = written(identity.identified(nested(spark, sf_dir), ("candidate",), "candidate").select("candidate", *identity.KEYS))
    for key, name in zip(identity.KEYS, ("same_scope", "same_chain", "same_facts"), strict=True):
        first = rows.groupBy(key).agg(F.min("candidate").alias(name))
        rows = rows.join(first, key)
    return rows.select("candidate", "same_scope", "same_chain", "same_facts")


_NEEDS = "(n % 4 = 0)"
_GROUPED = f"""{_BASE}, a AS (SELECT o.*, {_NEEDS} AS needs, (o_custkey % 100)::BIGINT AS risk, o_orderkey % 4 AS places, o.o_orderkey % 3 AS h FROM o JOIN orders USING (o_orderkey)),
    k AS (SELECT *, dense_rank() OVER (ORDER BY {_SCOPE}) AS sk, dense_rank() OVER (ORDER BY {_CHAIN}) AS ck, dense_rank() OVER (ORDER BY {_FACT}) AS fk FROM a),
    w AS (SELECT *, row_number() OVER same AS place, count(*) OVER (PARTITION BY sk, ck, fk) AS n_members, bool_or(needs AND n <> 4) OVER (PARTITION BY sk, ck, fk) AS group_needs,
                 first(o_orderkey) OVER same AS representative, first(h) OVER same AS result
          FROM k WINDOW same AS (PARTITION BY sk, ck, fk ORDER BY needs DESC, risk DESC, places DESC, o_orderkey DESC))"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    helpers = ("candidate", "guard_blocked")
    rows = nested(spark, sf_dir).withColumn("guard_blocked", F.col("candidate") % 8 == 4)
    rows = funnel.identified(rows, helpers, "candidate")
    return rows.withColumn("needs", F.col("candidate") % 4 == 0).withColumn("risk", F.col("risk_score").cast("long"))


@query(_GROUPED + " SELECT representative, n_members, group_needs, risk FROM w WHERE place = 1")
def funnel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8, AG9: candidates grouped by their three keys, with the member that represents each group."""
    return funnel.groups(_candidates(spark, sf_dir), "candidate", "locations").select("representative", "n_members", "group_needs", "risk")


@query(_GROUPED + """ SELECT o_orderkey AS candidate, representative, ['low', 'high', 'medium'][1 + CASE WHEN o_orderkey % 29 = 0 OR representative % 29 = 0 THEN h ELSE result END] AS result,
       CASE WHEN o_orderkey <> representative AND o_orderkey % 29 <> 0 AND representative % 29 <> 0 THEN representative END AS result_source FROM w""")
def funnel_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10: the representative's result is handed to the members if the recorded keys of both still hold. Every 29th
    candidate was changed after its keys were recorded: it hands nothing on and takes nothing."""
    rows = _candidates(spark, sf_dir).withColumn("component", F.when(F.col("candidate") % 29 == 0, "changed").otherwise(F.col("component")))
    found = funnel.propagated(rows, "candidate", "severity_hint", "locations", ("guard_blocked",), ())
    return found.select("candidate", "representative", F.col("severity_hint").alias("result"), "result_source")


@query("""
    WITH o AS (SELECT o_orderkey, o_custkey % 50 AS a, o_custkey % 3 AS b, o_orderkey % 2 AS c FROM orders)
    SELECT o_orderkey AS candidate, min(o_orderkey) OVER same AS first, count(*) OVER same AS n_same FROM o WINDOW same AS (PARTITION BY a, b, c)
""")
def exact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT10, AG8: candidates that are the same but for fields of runs, at any depth, and results of analyses."""
    a, b, c, n = "o_custkey % 50", "o_custkey % 3", "o_orderkey % 2", "o_orderkey % 8"
    rows = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS candidate", f"concat('p|', {a}, '~') AS component_name", f"IF({n} > 3, array('r', 'w', concat({b})), array(concat({b}), 'w', 'r', 'r')) AS permissions",
        f"IF({c} = 0, array('one', 'two'), array('two', 'one')) AS steps", f"named_struct('kind', 'k', 'seen_at', {n}, 'more', array(named_struct('elapsed_ms', {n}, 'x', 1.5D))) AS trace",
        f"map('a', 1, 'timestamp_of', {n}, 'b', {a}) AS tail", f"{n} AS ai_score", f"concat({n}) AS slice_refs", f"{n} AS started_at",
    )
    return identity.exact_groups(rows, "candidate").select("candidate", "first", "n_same")


_LEVELS = "element_at(array('L1', 'L2', 'L3'), CAST(candidate % 3 AS INT) + 1)"


@query(f"""{_BASE.replace("SELECT o_orderkey,", "SELECT o_orderkey, o_orderkey % 4 AS last,")},
    k AS (SELECT *, dense_rank() OVER (ORDER BY s, f, CASE f WHEN 1 THEN n END, {_SCOPE}, {_CHAIN}) AS grp FROM o),
    l AS (SELECT grp, 'l' || x || ':' || n AS place, o_orderkey, x FROM k, generate_series(0, last) t(x)),
    u AS (SELECT grp, place, min((o_orderkey, x)) AS first FROM l GROUP BY ALL), j AS (SELECT grp, string_agg(place, ',' ORDER BY first) AS places FROM u GROUP BY grp),
    w AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY o_orderkey % 3 DESC, o_orderkey % 5 = 0 DESC, r DESC, n DESC, d DESC, CASE p WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END DESC, o_orderkey DESC) AS place FROM k),
    m AS (SELECT grp, count(*) AS n_members, string_agg(DISTINCT 'R' || r, ',' ORDER BY 'R' || r) AS rules, max(o_orderkey) FILTER (place = 1) AS primary_, max(o_orderkey % 3) AS level,
                 min(CASE o_orderkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END) AS auth, bool_or(o_orderkey % 11 = 0) AS open, bool_or(o_orderkey % 11 > 0) AS shut FROM w GROUP BY grp)
    SELECT primary_ AS primary, n_members, rules, ['L1', 'L2', 'L3'][level + 1] AS evidence_level, places, ['unprotected', 'conditional', 'unknown'][auth] AS authorization_status,
           CASE WHEN open AND shut THEN 'present_bypassable' WHEN open THEN 'absent' ELSE 'present_effective' END AS guard_status FROM m JOIN j USING (grp)
""")
def findings_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1, AG2: candidates of one component, scope and chain as one finding, with the union of their places."""
    rows = identity.identified(nested(spark, sf_dir), ("candidate",), "candidate")
    rows = rows.withColumns({
        "evidence_level": F.expr(_LEVELS), "deterministic_chain_verified": F.col("candidate") % 5 == 0, "dataflow_status": F.lit("verified"), "impact_status": F.lit("proven"), "analysis_status": F.lit("ai_completed"),
        "authorization_status": F.when(F.col("candidate") % 7 == 0, "conditional").when(F.col("candidate") % 7 == 1, "unprotected"), "guard_status": F.when(F.col("candidate") % 11 == 0, "absent").otherwise("present_effective"),
    })
    places = F.array_join(F.transform("locations", lambda x: F.concat_ws(":", x["path"], x["line"].cast("string"))), ",")
    return findings.merged(rows, "candidate").select("primary", "n_members", F.array_join("rule_ids", ",").alias("rules"), "evidence_level", places.alias("places"), "authorization_status", "guard_status")
