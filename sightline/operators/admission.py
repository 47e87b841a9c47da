"""Admission of records under budgets, in which rejected records cost nothing; and windows of lines about anchors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Steps, join_spread, unused, written
from .windows import running_total


def greedy(rows: DataFrame, scope: str, order: str, cost: str, budget: int | str) -> DataFrame:
    """Add admitted (boolean) and used (budget spent in the scope so far). In order, a record is admitted if it still
    fits; later, smaller ones may follow a rejected one, so no single running sum can tell. Null costs count as 0.

    Rounds: of the records left in a scope, those larger than its rest are rejected; the longest run of the others that
    fits is admitted, and the next record is rejected. Each round is one running total over all scopes at once, so a
    scope is spread over tasks. Rounds end when no scope has records left: a few as a rule, at most one for each record
    that is rejected between admitted ones. order must be unique within a scope. budget: a number, or a column that is the
    same in a scope. Columns named admitted and used are replaced.
    """
    spark = rows.sparkSession
    steps = Steps(spark)
    rows = rows.drop("admitted", "used")
    rest, total, key, at, price = unused(rows.columns, "rest_of_budget", "total_of_run", "scope_of_row", "place_of_row", "cost_of_row")
    left = rows.select(F.col(f"`{scope}`").alias(key), F.col(f"`{order}`").alias(at), F.coalesce(F.col(f"`{cost}`"), F.lit(0)).cast("long").alias(price), (F.lit(budget) if isinstance(budget, int) else F.col(f"`{budget}`")).cast("long").alias(rest))
    left = steps.put(left)
    taken = []
    while True:
        fitting = left.where(F.col(price) <= F.col(rest))
        summed = steps.put(running_total(fitting, [key], [at], F.col(price), total))
        if summed.isEmpty():
            break
        run = summed.where(F.col(total) <= F.col(rest))
        taken.append(run.select(key, at, price))
        # the first record beyond the run is rejected; what follows it meets the rest of the budget
        stop = summed.where(F.col(total) > F.col(rest)).groupBy(key).agg(F.min(at).alias("stop_of_run"))
        spent = run.groupBy(key).agg(F.max(total).alias("spent_in_run"))
        ends = stop.join(spent.withColumnRenamed(key, "of_scope"), F.col(key).eqNullSafe(F.col("of_scope")), "left").select(F.col(key).alias("of_scope"), "stop_of_run", F.coalesce("spent_in_run", F.lit(0)).alias("spent_in_run"))
        moved = summed.join(ends, F.col(key).eqNullSafe(F.col("of_scope"))).where(F.col(at) > F.col("stop_of_run"))
        left = steps.put(moved.select(key, at, price, (F.col(rest) - F.col("spent_in_run")).alias(rest)))
    if taken:
        admitted = reduce(DataFrame.unionByName, taken).select(F.col(key).alias("of_scope"), F.col(at).alias("of_place"), F.lit(True).alias("admitted"))
    else:
        admitted = left.limit(0).select(F.col(key).alias("of_scope"), F.col(at).alias("of_place"), F.lit(True).alias("admitted"))
    admitted = steps.result(admitted)
    out = rows.join(admitted, F.col(f"`{scope}`").eqNullSafe(F.col("of_scope")) & F.col(f"`{order}`").eqNullSafe(F.col("of_place")), "left").drop("of_scope", "of_place")
    out = out.withColumn("admitted", F.coalesce("admitted", F.lit(False)))
    spent = F.when(F.col("admitted"), F.coalesce(F.col(f"`{cost}`"), F.lit(0)).cast("long")).otherwise(F.lit(0).cast("long"))
    return running_total(out, [scope], [order], spent, "used")


def contexts(rows: DataFrame, scope: str, priority: str, context: str, cost: str, most_tokens: int, most_contexts: int) -> DataFrame:
    """Add selected, reason and status to the contexts of each scope. Those of priority 0 and 1 are needed for the proof:
    all of them are kept or, if they are too many or too large, the scope is left whole with status cannot_trim_safely.
    The others follow by priority and id while they fit: reason tells whether count or tokens kept one out. status is
    trimmed if any was left out, else within_budget. Ids are unique in a scope; null costs count as 0."""
    core = F.col(f"`{priority}`") <= 1
    tokens = F.coalesce(F.col(f"`{cost}`"), F.lit(0)).cast("long")
    needed = rows.groupBy(F.col(f"`{scope}`").alias("of_scope")).agg(F.coalesce(F.sum(F.when(core, tokens)), F.lit(0)).alias("core_tokens"), F.count_if(core).alias("n_core"), F.count(F.lit(1)).alias("n"))
    safe = (F.col("n_core") <= most_contexts) & (F.col("core_tokens") <= most_tokens)
    needed = needed.select(F.to_json(F.struct("of_scope")).alias("scope_text"), safe.alias("safe"), (F.lit(most_tokens) - F.col("core_tokens")).alias("tokens_left"), (F.lit(most_contexts) - F.col("n_core")).alias("places_left"))
    keyed = rows.withColumn("scope_text", F.to_json(F.struct(F.col(f"`{scope}`").alias("of_scope"))))
    known = written(join_spread(keyed, needed, "scope_text").withColumn("rank_of_context", F.struct(F.col(f"`{priority}`"), F.col(f"`{context}`"))))
    optional = greedy(known.where(F.col("safe") & ~core).withColumn("tokens_of_context", tokens), "scope_text", "rank_of_context", "tokens_of_context", "tokens_left")
    counted = running_total(optional, ["scope_text"], ["rank_of_context"], F.col("admitted").cast("long"), "n_admitted")
    full = (F.col("n_admitted") - F.col("admitted").cast("long")) >= F.col("places_left")
    reason = F.when(full, "context_count_budget").when(~F.col("admitted"), "input_token_budget")
    chosen = counted.select(*[F.col(f"`{c}`") for c in known.columns], reason.alias("reason"))
    others = known.where(core | ~F.col("safe")).withColumn("reason", F.lit(None).cast("string"))
    found = chosen.unionByName(others)
    trimmed = found.groupBy("scope_text").agg(F.bool_or(F.col("reason").isNotNull()).alias("any_left_out"))
    status = F.when(~F.col("safe"), "cannot_trim_safely").when(F.col("any_left_out"), "trimmed").otherwise("within_budget")
    return join_spread(found, trimmed, "scope_text").select(*[F.col(f"`{c}`") for c in rows.columns], F.col("reason").isNull().alias("selected"), "reason", status.alias("status"))


def line_window(start: Column, end: Column, first: Column, last: Column, most: int, core: Column) -> Column:
    """A struct (status, start, end) for a context of lines start to end, of which first to last hold anchors (null without
    any), cut to at most so many lines about them. unchanged: it is short enough; trimmed; cannot_trim_safely: the anchors
    do not fit, or there are none and it is core; omit: there are none and it is not."""
    spare = F.lit(most) - (last - first + 1)
    begin = F.greatest(start, first - F.floor(spare / 2))
    stop = F.least(begin + (most - 1), end)
    begin = F.when(begin + (most - 1) > end, F.greatest(start, stop - (most - 1))).otherwise(begin)
    status = F.when(end - start + 1 <= most, "unchanged").when(first.isNull(), F.when(core, "cannot_trim_safely").otherwise("omit")).when(last - first + 1 > most, "cannot_trim_safely").otherwise("trimmed")
    cut = status == "trimmed"
    return F.struct(status.alias("status"), F.when(cut, begin).otherwise(start).cast("long").alias("start"), F.when(cut, stop).otherwise(end).cast("long").alias("end"))
