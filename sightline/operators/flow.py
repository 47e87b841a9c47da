"""Taint summaries as relational fixpoints over (method, slot) facts, and what a variable holds where it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .tables import Steps

_node = lambda method, slot: F.concat_ws("\x1f", method, F.col(slot).cast("string"))
#: What a summary says of a parameter.
CATEGORIES = ("return", "sink", "mutation")


def reaching_sinks(transfers: DataFrame, sinks: DataFrame, validators: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """method, slot, hops: every slot whose value may reach a sink, with the least number of transfers.

    transfers: method, slot, to_method, to_slot (a value handed on, by assignment, call or return); sinks: method,
    slot; validators: method, slot, at which values are checked and go no further. Cycles end; no more than `most`
    transfers are followed where that is given.
    """
    edges = transfers.select(_node("method", "slot").alias("src"), _node("to_method", "to_slot").alias("dst"))
    ends = sinks.select(_node("method", "slot").alias("vertex"))
    if validators is not None:
        checked = validators.select(_node("method", "slot").alias("checked")).distinct()
        edges = edges.join(checked, F.col("src") == F.col("checked"), "left_anti").join(checked, F.col("dst") == F.col("checked"), "left_anti")
        ends = ends.join(checked, F.col("vertex") == F.col("checked"), "left_anti")
    found = graph.reach_back(edges, ends, most)
    parts = F.split("vertex", "\x1f")
    return found.select(parts[0].alias("method"), parts[1].cast("int").alias("slot"), F.col("depth").alias("hops"))


def words(expression: Column) -> Column:
    """The different names in an expression."""
    return F.filter(F.array_distinct(F.split(F.coalesce(expression, F.lit("")), r"[^\w$]+")), lambda w: w != "")


def handed_on(parameters: DataFrame, calls: DataFrame, returns: DataFrame) -> DataFrame:
    """method, slot, target, argument, returned: parameters of a method that an argument of one of its calls names, and
    whether the method returns the variable that the call's result is assigned to."""
    named = calls.where("target is not null").select("method", "target", "assigned_to", F.posexplode("arguments").alias("argument", "expression"))
    used = named.select("method", "target", "assigned_to", "argument", F.explode(words(F.col("expression"))).alias("name"))
    used = used.join(parameters.select("method", "name", "slot"), ["method", "name"])
    given = returns.select("method", F.explode(words(F.col("expression"))).alias("assigned_to"), F.lit(True).alias("returned")).distinct()
    return used.join(given, ["method", "assigned_to"], "left").select("method", "slot", "target", "argument", F.coalesce("returned", F.lit(False)).alias("returned")).distinct()


def summaries(parameters: DataFrame, calls: DataFrame, returns: DataFrame, facts: DataFrame, most: int | None = None) -> tuple[DataFrame, str]:
    """(method, category, slot, round) of all that can be said of the parameters of methods, and whether that is all:
    converged, or limit_reached if `most` rounds were given and there was more.

    A parameter reaches a return, a sink or a mutation by a fact of its own (facts: method, category, slot), or by being
    named in an argument whose parameter in the call's target does; for a return, the call's result must be returned as
    well. parameters: method, name, slot; calls: method, target, arguments, assigned_to; returns: method, expression.
    Only new facts are looked at in a round; recursion ends once there are none.
    """
    steps = Steps(facts.sparkSession)
    edges = steps.put(handed_on(parameters, calls, returns))
    seen = steps.put(facts.select("method", "category", F.col("slot").cast("long").alias("slot")).where("method is not null and slot is not null").distinct().withColumn("round", F.lit(0)))
    new, turn, status = seen, 0, "converged"
    asked = edges.select(F.col("method").alias("caller"), F.col("slot").cast("long").alias("parameter"), "target", F.col("argument").cast("long").alias("argument"), "returned")
    while not new.isEmpty():
        turn += 1
        met = new.join(asked, (F.col("method") == F.col("target")) & (F.col("slot") == F.col("argument"))).where("returned or category <> 'return'")
        found = met.select(F.col("caller").alias("method"), "category", F.col("parameter").alias("slot")).distinct()
        new = steps.put(found.join(seen, ["method", "category", "slot"], "left_anti").withColumn("round", F.lit(turn)))
        if most is not None and turn > most:
            status = "converged" if new.isEmpty() else "limit_reached"
            break
        seen = seen.unionByName(new)
        if turn % 8 == 0:
            seen = steps.put(seen)
    return steps.result(seen), status


def held_values(events: DataFrame, scope: list[str], variable: str = "variable", ordinal: str = "ordinal") -> DataFrame:
    """For each use of a variable what it holds there: scope, variable, ordinal, values and known.

    events: scope, variable, ordinal, kind, value. define gives the variable a new object (with value, if not null), add
    adds a value to it, kill gives it something unknown, use asks. values are those since the last define or kill before the
    use, in order; known tells whether that was a define. Of events with one ordinal uses come last. A use reads backwards
    only as far as its variable was last defined, so a window ends there; scopes are methods.
    """
    keys = [*scope, variable]
    place = F.when(F.col("kind") == "use", 1).otherwise(0)
    along = Window.partitionBy(*keys).orderBy(ordinal, place)
    fresh = F.col("kind").isin("define", "kill")
    lives = events.withColumn("life", F.sum(F.when(fresh, 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "life").orderBy(ordinal, place).rowsBetween(Window.unboundedPreceding, 0)
    values = F.collect_list(F.when(F.col("kind").isin("define", "add"), F.col("value"))).over(inside)
    known = F.max(F.when(F.col("kind") == "define", True).otherwise(False)).over(inside)
    return lives.select(*keys, ordinal, "kind", values.alias("values"), known.alias("known")).where("kind = 'use'").drop("kind")
