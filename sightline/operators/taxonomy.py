"""Growth of a taxonomy of sinks by what people confirmed, and the calls that it judges anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lookups
from .tables import broadcast_if_few, join_spread, written


def _key() -> Column:
    """Method and constraints on the receiver: leaves and exact names in any order, prefixes as they stand."""
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return F.to_json(F.struct("method", F.array_sort(listed("leaves")).alias("leaves"), listed("prefixes").alias("prefixes"), F.array_sort(listed("exact")).alias("exact")))


def next_version(version: str, steps: int) -> str:
    """The version after so many changes: the third number grows, numbers that are not there being 0; what is no version
    counts as 1.0.0."""
    parts = (version or "").split(".")
    numbers = [int(p) for p in parts] if all(p.isdigit() for p in parts) else [1, 0, 0]
    first, second, third = (numbers + [0, 0])[:3]
    return f"{first}.{second}.{third + steps}"


def promoted(entries: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries after the proposals, and proposal, status for each of these: skipped (an entry of the same key is manual
    already, or an earlier proposal made it so), upgraded (a base entry became manual) or appended. Doing it again changes
    nothing.

    entries: place, method, leaves, prefixes, exact, arities, taxonomy, severity, source (base or manual); proposals:
    proposal (their order), method, leaves, prefixes, exact, taxonomy, severity. Of entries of one key the first by place
    counts. An upgraded entry takes the taxonomy, and the severity if there is one, and keeps its place; new entries follow
    the last place in order.
    """
    known = written(entries.withColumn("key", _key()))
    asked = proposals.withColumn("key", _key())
    first = known.groupBy("key").agg(F.min(F.struct("place", "source")).alias("first")).select("key", F.col("first.place").alias("at"), F.col("first.source").alias("was"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("proposal"))
    judged = written(asked.join(first, "key", "left").withColumn("turn", turn))
    status = F.when((F.col("turn") > 1) | (F.col("was") == "manual"), "skipped").when(F.col("was").isNotNull(), "upgraded").otherwise("appended")
    judged = judged.withColumn("status", status)
    ups = judged.where("status = 'upgraded'").select(F.col("at").alias("place"), F.col("taxonomy").alias("new_taxonomy"), F.col("severity").alias("new_severity"), F.lit(True).alias("up"))
    kept = known.join(ups, "place", "left").drop("key")
    kept = kept.withColumns({"taxonomy": F.coalesce("new_taxonomy", "taxonomy"), "severity": F.coalesce("new_severity", "severity"), "source": F.when(F.col("up"), "manual").otherwise(F.col("source"))}).select(*entries.columns)
    last = known.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("last"))
    new = judged.where("status = 'appended'").crossJoin(F.broadcast(last))  # one row
    place = (F.col("last") + F.row_number().over(Window.orderBy("proposal"))).cast(entries.schema["place"].dataType)  # as many rows as people confirmed
    given = {"place": place, "source": F.lit("manual")}
    added = new.select(*[(given[f.name] if f.name in given else F.col(f.name) if f.name in proposals.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in entries.schema.fields])
    return kept.unionByName(added), judged.select("proposal", "status")


def _constraints(entries: DataFrame) -> DataFrame:
    """Entries as lookups.taxonomy takes them: a row for each constraint, one without any for an entry that is free."""
    struct = lambda e, p, leaf: F.struct(e.cast("string").alias("exact"), p.cast("string").alias("prefix"), leaf.cast("string").alias("leaf"))
    none = F.lit(None)
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    rows = F.concat(F.transform(listed("exact"), lambda v: struct(v, none, none)), F.transform(listed("prefixes"), lambda v: struct(none, v, none)), F.transform(listed("leaves"), lambda v: struct(none, none, v)))
    rows = F.when(F.size(rows) == 0, F.array(struct(none, none, none))).otherwise(rows)
    return entries.select("place", "method", "taxonomy", "arities", F.explode(rows).alias("c")).select("place", "method", "taxonomy", "arities", "c.*")


def judged_anew(calls: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """call, taxonomy_before, taxonomy_after of the calls (call, method, receiver, arity) that the two taxonomies judge
    differently. Only methods whose entries differ are looked at, and calls that ask the same are judged once."""
    of = lambda entries: entries.select("method", F.to_json(F.struct("place", "method", "leaves", "prefixes", "exact", "arities", "taxonomy")).alias("entry"))
    old, new = of(before), of(after)
    methods = written(old.exceptAll(new).unionByName(new.exceptAll(old)).select("method").distinct())
    asked = calls.join(broadcast_if_few(methods), "method").select("method", "receiver", "arity").distinct()
    asked = written(asked.withColumn("request", F.to_json(F.struct("method", "receiver", "arity"))))
    told = lambda entries, name: lookups.answered(asked, _constraints(entries.join(methods, "method", "left_semi"))).select("request", F.col("best.taxonomy").alias(name))
    both = told(before, "taxonomy_before").join(told(after, "taxonomy_after"), "request", "full")
    changed = both.where(~F.col("taxonomy_before").eqNullSafe(F.col("taxonomy_after")))
    keyed = calls.where("method is not null").select("call", F.to_json(F.struct("method", "receiver", "arity")).alias("request"))
    return join_spread(keyed, written(changed), "request").select("call", "taxonomy_before", "taxonomy_after")
