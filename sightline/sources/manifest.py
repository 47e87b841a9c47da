"""Package manifests (XML) as component rows with effective export and permission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.protection import exported

KINDS = ("activity", "service", "receiver", "provider")
_COMPONENT = "array<struct<_name: string, _exported: string, _permission: string, `intent-filter`: array<struct<action: array<struct<_name: string>>>>>>"
SCHEMA = f"_package string, `uses-sdk` struct<_targetSdkVersion: int>, application struct<_permission: string, {', '.join(f'{k}: {_COMPONENT}' for k in KINDS)}>"


def qualified(name: Column, package: Column) -> Column:
    """`.X` and `X` belong to the package; names with a dot inside stand for themselves."""
    return F.when(name.startswith("."), F.concat(package, name)).when(~name.contains("."), F.concat_ws(".", package, name)).otherwise(name)


def components(manifests: DataFrame, xml: str = "xml", platform: int = 36) -> DataFrame:
    """One row per component of each manifest: package, kind, name, exported, permission, n_actions. Malformed or null
    XML gives no rows."""
    parsed = manifests.select(F.from_xml(xml, SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("m")).where("m.application is not null")
    rows = None
    for kind in KINDS:
        part = parsed.select(F.col("m._package").alias("package"), F.col("m.`uses-sdk`._targetSdkVersion").alias("sdk"), F.col("m.application._permission").alias("default"), F.lit(kind).alias("kind"), F.inline(f"m.application.{kind}"))
        rows = part if rows is None else rows.unionByName(part)
    filters = F.coalesce(F.size("intent-filter"), F.lit(0))
    actions = F.coalesce(F.size(F.flatten(F.transform("intent-filter", lambda f: F.coalesce(f["action"], F.array())))), F.lit(0))
    return rows.select(
        "package", "kind", qualified(F.col("_name"), F.col("package")).alias("name"),
        exported(F.col("kind"), F.col("_exported"), filters > 0, F.col("sdk"), F.lit(platform))["exported"].alias("exported"),
        F.coalesce("_permission", "default").alias("permission"), F.greatest(actions, F.lit(0)).alias("n_actions"),
    )
