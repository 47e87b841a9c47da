"""Targets of calls: by the receiver's class, the caller's own class or its package, with compatible parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written


def parameters(descriptor: Column) -> Column:
    """The types between the parentheses of a descriptor; none for anything else."""
    inside = F.regexp_extract(F.coalesce(descriptor, F.lit("")), r"^\(([^)]*)\)", 1)
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inside, ","), lambda t: F.trim(t)))


def last_names(descriptor: Column) -> Column:
    """The types of a descriptor by their last names; ? stays."""
    return F.transform(parameters(descriptor), lambda t: F.substring_index(t, ".", -1))


def package(name: Column) -> Column:
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise("")


def _agree(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: (x == "?") | (y == "?") | (x == y)), lambda x: x)


def receivers(calls: DataFrame, classes: DataFrame) -> DataFrame:
    """calls with receiver_class: the class that a stated receiver_type names. this and super are the caller's class, a name
    with dots (or slashes) is a full name, another one must be a class of the caller's package. L and ; are taken off both
    ends. classes: qualified_class. Without a type, or where no class is found, it is null."""
    plain = F.regexp_replace(F.replace(F.coalesce("receiver_type", F.lit("")), F.lit("/"), F.lit(".")), "^[L;]+|[L;]+$", "")
    own = package(F.coalesce("caller_class", F.lit("")))
    near = F.when((plain != "") & ~plain.contains(".") & ~plain.isin("this", "super"), F.concat(own, F.when(own == "", "").otherwise("."), plain))
    known = classes.select(F.col("qualified_class").alias("near_class")).where("near_class is not null and near_class <> ''").distinct()
    found = calls.withColumns({"plain_type": plain, "near_class": near}).join(known.withColumn("is_near", F.lit(True)), "near_class", "left")
    caller = F.when(F.col("caller_class") != "", F.col("caller_class"))
    of = F.when(F.coalesce("receiver_type", F.lit("")) == "", None).when(F.col("plain_type").isin("this", "super"), caller).when(F.col("plain_type").contains("."), F.col("plain_type")).when(F.col("is_near"), F.col("near_class"))
    return found.withColumn("receiver_class", of).drop("plain_type", "near_class", "is_near")


def targets(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """call, status, target and n for calls (call, method_name, descriptor, receiver_text, receiver_type, caller_class) and
    methods (id, name, qualified_class, descriptor).

    A call on super has no target here. With a receiver type, methods of its class count; without a receiver or on this,
    those of the caller's class or, if it has none of the name and number of parameters, those of its package; another
    receiver of no known type has none. Of these the ones with compatible parameters count (? fits any type, others by
    last name): one is the target (resolved), several are ambiguous, none leaves the call pending.

    Methods of equal parameters are counted before the join, so overloads and common names do not multiply calls.
    """
    named = methods.where("coalesce(qualified_class, '') <> ''").select("id", "name", "qualified_class", last_names(F.col("descriptor")).alias("types"))
    named = written(named.withColumn("package", package(F.col("qualified_class"))))

    def counted(owner: str) -> DataFrame:
        return named.groupBy(F.col(owner).alias("owner"), F.col("name").alias("method_name"), F.size("types").alias("arity"), "types").agg(F.count(F.lit(1)).alias("n_methods"), F.min("id").alias("first"))

    text = F.coalesce("receiver_text", F.lit(""))
    asked = receivers(calls, named).withColumns({"wanted": last_names(F.col("descriptor")), "untyped": (F.coalesce("receiver_type", F.lit("")) == "") & text.isin("", "this")})
    asked = asked.withColumn("arity", F.size("wanted")).where(text != "super")
    owner = F.when(F.col("untyped"), F.col("caller_class")).otherwise(F.col("receiver_class"))
    asked = written(asked.select("call", "method_name", "arity", "wanted", "untyped", owner.alias("owner"), package(F.coalesce("caller_class", F.lit(""))).alias("caller_package")))
    keys = ["owner", "method_name", "arity"]
    by_class = counted("qualified_class")
    here = asked.join(by_class, keys).select("call", "wanted", "types", "n_methods", "first")
    without = asked.where("untyped").join(by_class.select(*keys).distinct(), keys, "left_anti").drop("owner").withColumnRenamed("caller_package", "owner")
    around = without.join(counted("package"), keys).select("call", "wanted", "types", "n_methods", "first")
    fitting = here.unionByName(around).where(_agree(F.col("wanted"), F.col("types")))
    settled = fitting.groupBy("call").agg(F.sum("n_methods").alias("n"), F.min("first").alias("first"))
    n = F.coalesce("n", F.lit(0))
    return calls.select("call").join(settled, "call", "left").select("call", F.when(n == 0, "pending").when(n == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(n == 1, F.col("first")).alias("target"), n.cast("long").alias("n"))


def relations(calls: DataFrame) -> DataFrame:
    """method, relation, other of calls (method, ordinal, status, target, line, name): callers and callees of methods, each
    once, and for calls with several targets a gap with the line and the name in other. Rows, not lists: a method may have
    any number of callers."""
    sure = calls.where("status = 'resolved' and target is not null")
    callees = sure.select(F.col("method").cast("string").alias("method"), F.lit("callee").alias("relation"), F.col("target").cast("string").alias("other")).distinct()
    callers = callees.select(F.col("other").alias("method"), F.lit("caller").alias("relation"), F.col("method").alias("other"))
    gaps = calls.where("status = 'ambiguous'").select(F.col("method").cast("string").alias("method"), F.lit("SYMBOL_TARGET_AMBIGUOUS").alias("relation"), F.concat_ws(":", F.col("line").cast("string"), "name").alias("other"))
    return callees.unionByName(callers).unionByName(gaps)
