"""Evidence held against the index: whether places exist, lie in their methods and say what they are quoted with; and what
a candidate's statuses are then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Lists of a candidate that are held against the index, the manifest's file, flows that count as proven,
#: guards and authorizations with which a finding can be graded.
FIELDS = ("locations", "sources", "sinks")
MANIFEST = "AndroidManifest.xml"
PROVEN = ("intraprocedural", "interprocedural", "verified")
OPEN_GUARDS, CLOSED_AUTHORIZATIONS = ("absent", "present_bypassable"), ("unknown", "protected", "strongly_protected")


def _said(items: DataFrame, files: DataFrame) -> DataFrame:
    """item, near: the line that each quoted item names, with the line before and the line after it. Only the lines of files
    that are quoted are cut out, and each meets the items by its number, so no item carries a whole file."""
    quoted = items.where("quoted_text is not null and path is not null and line >= 1").select("item", "path", F.explode(F.expr("array(line - 1, line, line + 1)")).alias("line"))
    wanted = files.join(quoted.select("path").distinct(), "path", "left_semi").where("content is not null")
    lines = wanted.select("path", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("at", "text")).select("path", (F.col("at") + 1).cast("long").alias("line"), "text")
    met = quoted.withColumn("line", F.col("line").cast("long")).join(lines, ["path", "line"])
    return met.groupBy("item").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("near"))


def verified(items: DataFrame, files: DataFrame, methods: DataFrame) -> DataFrame:
    """items with reason: null for a fact, else the first code that applies. Repeated paths or method ids count once.

    items: item (unique), field, artifact, path, line, scope_id, expected_scope, method_id, symbol_key, quoted_text; files:
    path, line_count, content; methods: id, path, start, end, symbol_key. The codes, in order: SCOPE_ID_MISMATCH,
    MANIFEST_LOCATION_INVALID (only locations may lie in the manifest), LOCATION_NOT_INDEXED, METHOD_ID_NOT_FOUND,
    SYMBOL_KEY_NOT_FOUND, METHOD_SYMBOL_MISMATCH, SYMBOL_LOCATION_MISMATCH, METHOD_LOCATION_MISMATCH,
    INDEX_CONTENT_UNAVAILABLE, QUOTED_TEXT_MISMATCH.
    """
    known = files.where("path is not null").groupBy("path").agg(F.max("line_count").alias("line_count"), F.bool_or(F.col("content").isNotNull()).alias("has_content"))
    own = methods.select(F.col("id").alias("method_id"), F.col("path").alias("method_path"), F.col("start").alias("method_start"), F.col("end").alias("method_end"), F.col("symbol_key").alias("method_symbol")).dropDuplicates(["method_id"])
    symbols = methods.where("symbol_key is not null").select("symbol_key", "path", "start", "end")
    exists = symbols.select("symbol_key").distinct().withColumn("symbol_exists", F.lit(True))
    asked = items.where("symbol_key is not null and method_id is null").select("item", "symbol_key", "path", "line")
    held = asked.join(symbols.distinct(), ["symbol_key", "path"]).where("line between start and end").select("item").distinct().withColumn("symbol_holds", F.lit(True))
    found = items.join(known, "path", "left").join(own, "method_id", "left").join(exists, "symbol_key", "left").join(held, "item", "left").join(_said(items, files), "item", "left")
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    line = F.coalesce(F.col("line"), F.lit(0)) >= 1
    in_manifest = (F.col("field") == "locations") & F.coalesce(F.col("artifact") == "manifest", F.lit(False))
    semantic = some("method_id") | some("symbol_key") | F.col("quoted_text").isNotNull()
    outside = some("method_id") & ~F.coalesce((F.col("method_path") == F.col("path")) & F.col("line").between(F.col("method_start"), F.col("method_end")), F.lit(False))
    reason = (
        F.when(some("scope_id") & some("expected_scope") & (F.col("scope_id") != F.col("expected_scope")), "SCOPE_ID_MISMATCH")
        .when(in_manifest, F.when((F.coalesce("path", F.lit("")) != MANIFEST) | (F.col("line").isNotNull() & ~line), "MANIFEST_LOCATION_INVALID"))
        .when(F.col("line_count").isNull() | ~line | (F.col("line") > F.col("line_count")), "LOCATION_NOT_INDEXED")
        .when(some("method_id") & F.col("method_path").isNull(), "METHOD_ID_NOT_FOUND")
        .when(some("symbol_key") & F.col("symbol_exists").isNull(), "SYMBOL_KEY_NOT_FOUND")
        .when(some("symbol_key") & some("method_id") & ~F.col("method_symbol").eqNullSafe(F.col("symbol_key")), "METHOD_SYMBOL_MISMATCH")
        .when(some("symbol_key") & ~some("method_id") & F.col("symbol_holds").isNull(), "SYMBOL_LOCATION_MISMATCH")
        .when(outside, "METHOD_LOCATION_MISMATCH")
        .when(semantic & ~F.col("has_content"), "INDEX_CONTENT_UNAVAILABLE")
        .when(F.col("quoted_text").isNotNull() & ~F.coalesce(F.contains("near", "quoted_text"), F.lit(False)), "QUOTED_TEXT_MISMATCH")
    )
    return found.select(*[items[c] if c not in ("path", "method_id", "symbol_key", "item") else F.col(c) for c in items.columns], reason.alias("reason"))


def counted(items: DataFrame) -> DataFrame:
    """candidate, and of each field how many facts and how many rejected items it has: n_locations, bad_locations, ..."""
    each = []
    for field in FIELDS:
        here = F.col("field") == field
        each += [F.count_if(here & F.col("reason").isNull()).alias(f"n_{field}"), F.count_if(here & F.col("reason").isNotNull()).alias(f"bad_{field}")]
    return items.groupBy("candidate").agg(*each)


def statuses(critical_gap: Column) -> Column:
    """struct(fact_integrity, semantic, exploitability, level, missing) of a candidate with the columns of counted (null: 0),
    evidence_level, deterministic_chain_verified, dataflow_status, guard_status, authorization_status,
    dynamic_validation_status and promotion_requested. critical_gap: whether its other gaps hold a critical one.

    An unknown level is L2. L2 needs facts in all three fields, L1 in locations; a missing field is a critical gap. A level
    becomes L3 only on request, and only for a closed chain without critical gaps, with an open guard and boundary.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    level = F.when(F.col("evidence_level").isin("L1", "L2"), F.col("evidence_level")).otherwise("L2")
    missing = F.filter(F.array(*[F.when((n(f"n_{f}") == 0) & ((level == "L2") | F.lit(f == "locations")), F.lit(f)) for f in FIELDS]), lambda f: f.isNotNull())
    complete = F.size(missing) == 0
    bad = sum((n(f"bad_{f}") for f in FIELDS[1:]), n("bad_locations")) > 0
    critical = critical_gap | bad | ~complete
    closed = complete & yes(F.col("deterministic_chain_verified")) & yes(F.col("dataflow_status").isin(*PROVEN))
    gradeable = yes(F.col("guard_status").isin(*OPEN_GUARDS)) & ~yes(F.col("authorization_status").isin(*CLOSED_AUTHORIZATIONS))
    semantic = F.when(level == "L1", "not_applicable").when(closed, "closed").otherwise("not_proven")
    asked = yes(F.col("promotion_requested")) | yes(F.col("evidence_level") == "L3")
    promoted = asked & (level == "L2") & closed & ~critical & gradeable
    return F.struct(
        F.when(bad, "invalid").when(complete, "verified").otherwise("incomplete").alias("fact_integrity"), semantic.alias("semantic"),
        F.when(yes(F.col("dynamic_validation_status") == "passed"), "dynamically_confirmed").when((semantic == "closed") & ~critical & gradeable, "statically_gradeable").otherwise("pending").alias("exploitability"),
        F.when(promoted, "L3").otherwise(level).alias("level"), missing.alias("missing"),
    )


def hold_against(items: DataFrame, files: DataFrame, methods: DataFrame, candidates: DataFrame, critical_gap: Column) -> DataFrame:
    """candidates (candidate unique) with their statuses after all their items were verified; those without items too."""
    found = counted(written(verified(items, files, methods)))
    joined = candidates.join(found, "candidate", "left")
    return joined.select(*[candidates[c] if c != "candidate" else F.col(c) for c in candidates.columns], statuses(critical_gap).alias("evidence"))
