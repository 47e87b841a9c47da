"""Growth of a taxonomy. Suppliers are read as its entries, customers as proposals, orders as calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import taxonomy
from ..operators.tables import read
from .base import query

TEXT = "CAST({} AS VARCHAR(9))".format


def _fields(k: str, every: int) -> dict[str, str]:
    """Method, constraints and taxonomy by a number; lists are given as one value or none."""
    return {
        "method": f"'m' || {TEXT(f'({k}) % {every}')}", "leaf": f"CASE WHEN ({k}) % 3 = 1 THEN 'L' || {TEXT(f'({k}) % 4')} END", "prefix": f"CASE WHEN ({k}) % 4 = 2 THEN 'a.' END", "exact_name": f"CASE WHEN ({k}) % 5 = 3 THEN 'a.b.L2' END",
        "taxonomy": f"'t' || {TEXT(f'({k}) % 6')}",
    }


_ENTRY = {"place": "s_suppkey", **_fields("s_suppkey", 23), "severity": "CASE WHEN s_suppkey % 2 = 0 THEN 'high' END", "source": "CASE WHEN s_suppkey % 4 = 0 THEN 'manual' ELSE 'base' END"}
_PROPOSAL = {"proposal": "c_custkey", **_fields("c_custkey + 7", 29), "severity": "CASE WHEN c_custkey % 3 = 0 THEN 'low' END"}
_CALL = {"call": "o_orderkey", "method": f"'m' || {TEXT('o_orderkey % 31')}", "receiver": "CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a.b.L2' WHEN 2 THEN 'z.L1' ELSE 'a.L3' END"}
_said = lambda fields: ", ".join(f"{sql} AS {name}" for name, sql in fields.items())
_SAME = "{0}.method = {1}.method AND {0}.leaf IS NOT DISTINCT FROM {1}.leaf AND {0}.prefix IS NOT DISTINCT FROM {1}.prefix AND {0}.exact_name IS NOT DISTINCT FROM {1}.exact_name".format
_SQL = f"""
    WITH e AS (SELECT {_said(_ENTRY)} FROM supplier), p AS (SELECT {_said(_PROPOSAL)} FROM customer WHERE c_custkey % 7 = 0),
    f AS (SELECT method, leaf, prefix, exact_name, min(place) AS at, arg_min(source, place) AS was FROM e GROUP BY ALL),
    j AS (SELECT p.*, f.at, CASE WHEN row_number() OVER (PARTITION BY p.method, p.leaf, p.prefix, p.exact_name ORDER BY proposal) > 1 OR was = 'manual' THEN 'skipped' WHEN was IS NOT NULL THEN 'upgraded' ELSE 'appended' END AS status
          FROM p LEFT JOIN f ON {_SAME('p', 'f')}),
    n AS (SELECT e.place, e.method, e.leaf, e.prefix, e.exact_name, coalesce(j.taxonomy, e.taxonomy) AS taxonomy, coalesce(j.severity, e.severity) AS severity, CASE WHEN j.at IS NULL THEN e.source ELSE 'manual' END AS source
          FROM e LEFT JOIN j ON j.at = e.place AND j.status = 'upgraded'
          UNION ALL SELECT (SELECT max(place) FROM e) + row_number() OVER (ORDER BY proposal), method, leaf, prefix, exact_name, taxonomy, severity, 'manual' FROM j WHERE status = 'appended')
"""


def _listed(rows: DataFrame) -> DataFrame:
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    return rows.withColumns({"leaves": one("leaf"), "prefixes": one("prefix"), "exact": one("exact_name")}).drop("leaf", "prefix", "exact_name")


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    some = lambda table, fields: table.select(*[F.expr(sql).alias(name) for name, sql in fields.items()])
    entries = _listed(some(read(spark, sf_dir, "supplier"), _ENTRY)).withColumn("arities", F.lit(None).cast("array<int>"))
    return entries, _listed(some(read(spark, sf_dir, "customer").where("c_custkey % 7 = 0"), _PROPOSAL))


@query(_SQL + " SELECT place, method, coalesce(leaf, '') || '|' || coalesce(prefix, '') || '|' || coalesce(exact_name, '') AS receiver, taxonomy, severity, source FROM n")
def taxonomy_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX2, FN22: a taxonomy after what people confirmed: base entries become manual, unknown ones are added, others stay."""
    entries, _ = taxonomy.promoted(*_frames(spark, sf_dir))
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    return entries.select("place", "method", F.concat_ws("|", first("leaves"), first("prefixes"), first("exact")).alias("receiver"), "taxonomy", "severity", "source")


_FITS = "(leaf IS NULL AND prefix IS NULL AND exact_name IS NULL OR receiver IS NULL OR coalesce(receiver = exact_name, FALSE) OR coalesce(starts_with(receiver, prefix), FALSE) OR coalesce(string_split(receiver, '.')[-1] = leaf, FALSE))"


@query(_SQL + f""", o AS (SELECT {_said(_CALL)} FROM orders),
    b AS (SELECT call, arg_min(e.taxonomy, place) AS t FROM o JOIN e ON e.method = o.method AND {_FITS} GROUP BY call), a AS (SELECT call, arg_min(n.taxonomy, place) AS t FROM o JOIN n ON n.method = o.method AND {_FITS} GROUP BY call)
    SELECT call, b.t AS taxonomy_before, a.t AS taxonomy_after FROM o LEFT JOIN b USING (call) LEFT JOIN a USING (call) WHERE b.t IS DISTINCT FROM a.t
""")
def taxonomy_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN22: the calls that the grown taxonomy judges differently."""
    entries, proposals = _frames(spark, sf_dir)
    calls = read(spark, sf_dir, "orders").select(*[F.expr(sql).alias(name) for name, sql in _CALL.items()]).withColumn("arity", F.lit(None).cast("int"))
    return taxonomy.judged_anew(calls, entries, taxonomy.promoted(entries, proposals)[0])
