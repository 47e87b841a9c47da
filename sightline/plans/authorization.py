"""Permissions, path regions, exports and the authorization matrix. Parts are read as components of apps (brands)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lattice, protection
from ..operators.tables import read
from .base import query

P, S = "p_partkey", "p_size"
_LEVELS = ["normal", "0x0", "dangerous", "1", "signature|privileged", "0x12", " Signature | AppOp ", "2", "0x13", "signature|odd", "privileged", "normal|dangerous", "0x6", "0x2000001", "internal|module", "5", "0x100002"]
_LEVEL = f"CASE {P} % 18 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_LEVELS)) + " END"
#: What each of the levels means, worked out by hand: base, flags, status, what is unknown.
_MEANT = [
    "normal||conditional|", "normal||conditional|", "dangerous||conditional|", "dangerous||conditional|", "signature|privileged|strongly_protected|", "signature|privileged|strongly_protected|",
    "signature|appop|strongly_protected|", "signature||strongly_protected|", "signatureOrSystem|privileged|strongly_protected|", "signature||unknown|odd", "|privileged|unknown|base_missing", "||unknown|multiple_bases",
    "||unknown|base:6", "dangerous||unknown|flags:0x2000000", "internal|module|strongly_protected|", "internal||strongly_protected|", "signature|incidentReportApprover|strongly_protected|", "||unknown|missing",
]
_TABLE = f"CASE {P} % 18 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_MEANT)) + " END"


@query(f"""WITH m AS (SELECT {P}, {_TABLE} AS t FROM part)
    SELECT {P}, nullif(split_part(t, '|', 1), '') AS base, split_part(t, '|', 2) AS flags, split_part(t, '|', 3) AS status, split_part(t, '|', 4) AS unknown FROM m""")
def protection_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC14: levels in numbers and names against what they mean, worked out by hand."""
    level = protection.protection(F.expr(_LEVEL))
    rows = read(spark, sf_dir, "part").select(P, level.alias("l"))
    return rows.select(P, "l.base", F.array_join("l.flags", ",").alias("flags"), "l.status", F.array_join("l.unknown", ",").alias("unknown"))


_OWN = f"SELECT DISTINCT p_brand AS owner, 'own.' || {S} AS name, CASE WHEN {S} % 2 = 0 THEN 'signature' ELSE 'normal' END AS level FROM part WHERE {S} <= 10"
_PLATFORM = {"android.permission.INTERNET": "normal", "android.permission.CAMERA": "dangerous", "android.permission.DUMP": "signature|development"}
_ASKED = f"""CASE WHEN {S} <= 12 THEN 'own.' || {S} WHEN {S} <= 20 THEN 'android.permission.INTERNET' WHEN {S} <= 25 THEN 'android.permission.CAMERA' WHEN {S} <= 30 THEN 'android.permission.DUMP'
    WHEN {S} <= 34 THEN 'android.permission.NEW' WHEN {S} <= 40 THEN 'other.lib' WHEN {S} <= 43 THEN '' END"""
_HINT = f"CASE {P} % 4 WHEN 0 THEN 'signature' WHEN 1 THEN 'platform_or_unknown' WHEN 2 THEN 'strange' END"
_PERMISSIONS = f"""a AS (SELECT {P}, p_brand AS owner, {_ASKED} AS permission, {_HINT} AS hint FROM part), own AS ({_OWN}),
    f AS (SELECT a.*, CASE WHEN coalesce(permission, '') = '' THEN 'none' WHEN own.name IS NOT NULL THEN 'manifest_permission'
            WHEN permission IN ('android.permission.INTERNET', 'android.permission.CAMERA', 'android.permission.DUMP') THEN 'platform_catalog' WHEN starts_with(permission, 'android.permission.') THEN 'platform_catalog_missing'
            WHEN hint IS NOT NULL AND hint <> 'platform_or_unknown' THEN 'component_protection_hint' ELSE 'dependency_or_undeclared_permission' END AS provenance, own.level AS own_level
          FROM a LEFT JOIN own ON a.owner = own.owner AND a.permission = own.name),
    s AS (SELECT *, CASE provenance WHEN 'none' THEN 'unprotected' WHEN 'manifest_permission' THEN CASE own_level WHEN 'signature' THEN 'strongly_protected' ELSE 'conditional' END
            WHEN 'platform_catalog' THEN CASE WHEN permission = 'android.permission.DUMP' THEN 'strongly_protected' ELSE 'conditional' END
            WHEN 'component_protection_hint' THEN CASE hint WHEN 'signature' THEN 'strongly_protected' ELSE 'unknown' END ELSE 'unknown' END AS status FROM f)"""


def _policies(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    own = read(spark, sf_dir, "part").where(f"{S} <= 10").select(F.col("p_brand").alias("owner"), F.concat(F.lit("own."), S).alias("name"), F.when(F.col(S) % 2 == 0, "signature").otherwise("normal").alias("level")).distinct()
    platform = spark.createDataFrame(list(_PLATFORM.items()), "name string, level string")
    return protection.policies(rows, own, platform)


@query(f"WITH {_PERMISSIONS} SELECT {P}, permission, provenance, status FROM s")
def permission_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP9: where a permission's strength comes from, and what it is."""
    rows = read(spark, sf_dir, "part").select(P, F.col("p_brand").alias("owner"), F.expr(_ASKED).alias("permission"), F.expr(_HINT).alias("hint"))
    return _policies(spark, sf_dir, rows).select(P, "permission", "provenance", "status")


#: Operations by the directions they need; other operations need all.
DIRECTIONS = {"query": ["read"], "insert": ["write"], "update": ["write"], "delete": ["write"]}
_OP = f"CASE {P} % 5 WHEN 0 THEN 'query' WHEN 1 THEN 'insert' WHEN 2 THEN 'delete' ELSE 'call' END"


@query(f"""
    WITH c AS (SELECT {P}, p_brand AS owner, {_OP} AS operation, {_HINT} AS hint, {_ASKED} AS write_permission, CASE WHEN {S} % 3 = 0 THEN 'own.' || ({S} % 10 + 1) END AS read_permission, {P} % 7 = 0 AS has_region, {P} % 11 = 0 AS grants FROM part),
    d AS (SELECT c.*, dir.access FROM c JOIN (VALUES ('query', 'read'), ('insert', 'write'), ('delete', 'write'), ('call', 'read'), ('call', 'write')) dir(op, access) ON dir.op = operation),
    r AS (SELECT d.*, region, CASE WHEN region = 'prefix:/private' THEN 'android.permission.DUMP' WHEN access = 'read' THEN coalesce(nullif(read_permission, ''), write_permission) ELSE write_permission END AS permission
          FROM d JOIN (VALUES ('default:*', FALSE), ('prefix:/private', TRUE)) g(region, is_own) ON NOT is_own OR has_region),
    own AS ({_OWN}),
    s AS (SELECT r.*, CASE WHEN coalesce(permission, '') = '' THEN 'unprotected' WHEN own.level = 'signature' THEN 'strongly_protected' WHEN own.level IS NOT NULL THEN 'conditional'
            WHEN permission = 'android.permission.DUMP' THEN 'strongly_protected' WHEN permission IN ('android.permission.INTERNET', 'android.permission.CAMERA') THEN 'conditional'
            WHEN NOT starts_with(permission, 'android.permission.') AND hint = 'signature' THEN 'strongly_protected' ELSE 'unknown' END AS policy
          FROM r LEFT JOIN own ON r.owner = own.owner AND permission = own.name)
    SELECT {P}, access, region, CASE WHEN grants THEN 'conditional' ELSE policy END AS status, policy = 'unknown' AS permission_gap,
           ['unprotected', 'conditional', 'unknown', 'protected', 'strongly_protected'][min(CASE CASE WHEN grants THEN 'conditional' ELSE policy END WHEN 'unprotected' THEN 1 WHEN 'conditional' THEN 2 WHEN 'unknown' THEN 3 ELSE 5 END) OVER (PARTITION BY {P})] AS weakest
    FROM s
""")
def authorization_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RU19, SP10 to SP12: each component by direction of its operation and by path region; the weakest cell counts.

    Directions and regions are a few per component and are exploded, not crossed; a URI grant makes a cell conditional.
    """
    own = F.col("read_permission")
    parts = read(spark, sf_dir, "part").select(
        P, F.col("p_brand").alias("owner"), F.expr(_OP).alias("operation"), F.expr(_HINT).alias("hint"), F.expr(_ASKED).alias("write_permission"),
        F.when(F.col(S) % 3 == 0, F.concat(F.lit("own."), F.col(S) % 10 + 1)).alias("read_permission"), (F.col(P) % 11 == 0).alias("grants"),
        F.when(F.col(P) % 7 == 0, F.array(F.lit("prefix:/private"))).otherwise(F.array().cast("array<string>")).alias("regions"),
    )
    known = F.create_map(*[x for op, ways in DIRECTIONS.items() for x in (F.lit(op), F.array(*map(F.lit, ways)))])
    ways = F.coalesce(F.try_element_at(known, F.col("operation")), F.array(F.lit("read"), F.lit("write")))
    cells = parts.withColumn("access", F.explode(ways)).withColumn("region", F.explode(F.concat(F.array(F.lit("default:*")), "regions")))
    component = F.when(F.col("access") == "read", F.coalesce(F.when(own != "", own), "write_permission")).otherwise(F.col("write_permission"))
    cells = cells.withColumn("permission", F.when(F.col("region") != "default:*", "android.permission.DUMP").otherwise(component))
    found = _policies(spark, sf_dir, cells).withColumn("cell", F.when(F.col("grants"), "conditional").otherwise(F.col("status")))
    weakest = found.groupBy(P).agg(lattice.least(F.col("cell"), lattice.AUTHORIZATION).alias("weakest"))
    return found.join(weakest, P).select(P, "access", "region", F.col("cell").alias("status"), (F.col("status") == "unknown").alias("permission_gap"), "weakest")


#: Policies by kind, in order; every one that matches a path gives a region, none the default.
POLICIES = (("exact", "/fr/825"), ("prefix", "/en/6"), ("pattern", "/de/.*5"), ("pattern", r"/fr/\8.*"))


@query(r"""
    WITH p AS (SELECT page_id, regexp_extract(url, '//[^/?#]+([^?#]*)', 1) AS path FROM pages),
    m AS (SELECT page_id, path, list_filter([CASE WHEN path = '/fr/825' THEN 'exact:/fr/825' END, CASE WHEN starts_with(path, '/en/6') THEN 'prefix:/en/6' END,
            CASE WHEN regexp_matches(path, '^/de/.*5$') THEN 'pattern:/de/.*5' END, CASE WHEN regexp_matches(path, '^/fr/8.*$') THEN 'pattern:/fr/\8.*' END], lambda x: x IS NOT NULL) AS found FROM p)
    SELECT page_id, unnest(CASE WHEN len(found) > 0 THEN found ELSE ['default:' || path] END) AS region FROM m
""")
def path_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC15, SC16, SP11: the regions of a path by exact, prefix and glob policies. Brackets in a glob are plain signs."""
    path = protection.path_of(F.col("url"))
    each = [F.when(protection.path_matches(F.col("path"), kind, value), F.lit(f"{kind}:{value}")) for kind, value in POLICIES]
    rows = read(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("found", F.filter(F.array(*each), lambda r: r.isNotNull()))
    return rows.select("page_id", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(F.array(F.concat(F.lit("default:"), "path")))).alias("region"))


_KIND = f"CASE {P} % 4 WHEN 0 THEN 'activity' WHEN 1 THEN 'service' WHEN 2 THEN 'receiver' ELSE 'provider' END"
_STATED = f"CASE {S} % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '@bool/x' END"
_SDK = f"CASE WHEN {S} % 7 = 0 THEN NULL ELSE 10 + {P} % 27 END"


@query(f"""
    WITH c AS (SELECT {P}, {_KIND} AS kind, {_STATED} AS stated, {P} % 3 = 0 AS has_filter, {_SDK} AS sdk FROM part)
    SELECT {P}, CASE WHEN stated IN ('true', 'false') THEN stated WHEN stated IS NOT NULL THEN 'unknown' WHEN kind = 'provider' AND sdk IS NULL THEN 'unknown' WHEN kind = 'provider' THEN CASE WHEN sdk < 17 THEN 'true' ELSE 'false' END
             WHEN has_filter AND sdk >= 31 THEN 'conditional' WHEN has_filter THEN 'true' ELSE 'false' END AS exported,
           CASE WHEN stated IN ('true', 'false') THEN 'manifest_explicit' WHEN stated IS NOT NULL THEN 'manifest_explicit_unresolved' WHEN kind = 'provider' AND sdk IS NULL THEN 'target_sdk_missing'
             WHEN kind = 'provider' AND sdk < 17 THEN 'provider_default_target_sdk_lt_17' WHEN kind = 'provider' THEN 'provider_default_target_sdk_gte_17'
             WHEN has_filter AND sdk >= 31 THEN 'android_12_requires_explicit_exported' WHEN has_filter THEN 'intent_filter_default' ELSE 'no_intent_filter_default' END AS basis FROM c
""")
def effective_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC17: whether a component can be reached from outside, and by which rule."""
    found = protection.exported(F.expr(_KIND), F.expr(_STATED), F.col(P) % 3 == 0, F.expr(_SDK), F.lit(36))
    return read(spark, sf_dir, "part").select(P, found.alias("e")).select(P, "e.*")
