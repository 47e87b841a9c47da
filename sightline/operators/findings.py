"""Candidates of one component, scope and chain merged to a finding: one of them is its proof, the others add to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lattice
from .identity import canonical
from .tables import written

#: Lists that are united over the members of a finding.
UNITED = ("locations", "blocking_gaps", "ai_blocking_gaps", "coverage_gaps", "authorization_matrix")
KEY = ("component", "component_name", "scope_key", "chain_key")


def united(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """group and, for each list column, the different elements of all members' lists in the order in which they come first.

    Elements are counted with their first place before they are listed, so a group is as large as its different elements,
    however many members repeat them. Null lists are empty; a group without elements has null lists.
    """
    out = None
    for column in columns:
        kind = rows.schema[column].dataType.elementType
        each = rows.select(group, order, F.posexplode(column).alias("at", "element"))
        each = each.withColumn("text", canonical(F.col("element"), kind)).groupBy(group, "text").agg(F.min_by("element", F.struct(order, "at")).alias("element"), F.min(F.struct(order, "at")).alias("place"))
        listed = each.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "text", "element"))), lambda x: x["element"]).alias(column))
        out = listed if out is None else out.join(listed, group, "full")
    return out


def merged(rows: DataFrame, order: str) -> DataFrame:
    """One row per finding: finding (its id), component, component_name, n_members, primary (the value of order of the member
    that proves it), rule_ids (sorted), the lists of UNITED that rows have, the primary's sources, sinks,
    propagation_paths, evidence_level, dataflow_status and impact_status, and merged statuses.

    Members share component, component_name, scope_key and chain_key. Auxiliary candidates are left out. The primary has the
    highest level, then a closed chain, then the largest rule, sources, sinks, paths and order; sources, sinks and paths are
    its own, so no proof is put together from several. The authorization is the weakest of all, and an open entry makes
    guards of the others bypassable. rows need the columns named here; others are not read.
    """
    there = [c for c in UNITED if c in rows.columns]
    text = lambda c: canonical(F.col(c), rows.schema[c].dataType, c)
    key = F.sha2(F.concat(*[F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in (F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in KEY)]), 256)
    own = ("sources", "sinks", "propagation_paths", "evidence_level", "dataflow_status", "impact_status")
    level = F.coalesce(F.array_position(F.array(*map(F.lit, ("L1", "L2", "L3"))), F.col("evidence_level")), F.lit(0))
    rank = F.struct(level.alias("level"), F.coalesce("deterministic_chain_verified", F.lit(False)).alias("closed"), F.coalesce("rule_id", F.lit("")).alias("rule"), text("sources").alias("a"), text("sinks").alias("b"), text("propagation_paths").alias("c"), F.col(order).alias("order"))
    auxiliary = F.coalesce(F.col("auxiliary"), F.lit(False)) if "auxiliary" in rows.columns else F.lit(False)
    kept = rows.where(~auxiliary).withColumn("finding_key", key).withColumn("rank_of_member", rank)
    kept = written(kept.select("finding_key", "rank_of_member", order, *[c for c in dict.fromkeys((*KEY[:2], "rule_id", *own, *there, "authorization_status", "guard_status", "analysis_status")) if c != order]))
    primary = F.max_by(F.struct(F.col(order).alias("primary"), *own, *KEY[:2]), "rank_of_member")
    found = kept.groupBy("finding_key").agg(
        primary.alias("p"), F.count(F.lit(1)).alias("n_members"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), lattice.least(F.col("authorization_status"), lattice.AUTHORIZATION).alias("authorization_status"),
        lattice.guard(F.col("guard_status")).alias("guard_status"), lattice.analysis(F.col("analysis_status")).alias("analysis_status"),
    )
    lists = united(kept, "finding_key", order, there) if there else None
    found = found.join(lists, "finding_key", "left") if lists is not None else found
    made = F.concat(F.lit("finding_"), F.substring(F.sha2(F.concat("finding_key", F.array_join("rule_ids", ",")), 256), 1, 20))
    empty = {c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)) for c in there}
    return found.withColumns({"finding": made, **empty}).select("finding", "p.component", "p.component_name", "n_members", "p.primary", "rule_ids", *[f"p.{c}" for c in own], *there, "authorization_status", "guard_status", "analysis_status")
