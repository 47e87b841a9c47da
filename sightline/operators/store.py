"""Findings kept over runs, and review writes that may be sent twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, key: str, machine: list[str], manual: list[str]) -> DataFrame:
    """The store after a run: machine columns come from the run, manual ones stay as they are in the store, rows that
    the run lacks are marked deleted, and rows that come back are revived.

    old: key, machine, manual, deleted (boolean); new: key, machine; keys are unique on either side. Adds `action`:
    insert, update, revive, delete or keep_deleted.
    """
    a = old.select(key, *[F.col(c).alias(f"old_{c}") for c in machine], *manual, "deleted", F.lit(True).alias("in_old"))
    b = new.select(key, *machine, F.lit(True).alias("in_new"))
    both = a.join(b, key, "full")
    here = F.col("in_new").isNotNull()
    action = F.when(F.col("in_old").isNull(), "insert").when(here & F.col("deleted"), "revive").when(here, "update").when(F.col("deleted"), "keep_deleted").otherwise("delete")
    chosen = [F.when(here, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in machine]
    return both.select(key, *chosen, *manual, (~here).alias("deleted"), action.alias("action"))


def review_outcomes(writes: DataFrame, request: str, payload: str, order: str) -> DataFrame:
    """Add outcome to review writes: the first of a request id is `applied`; later ones with its payload are `noop`,
    with another one `conflict`. order must be unique."""
    w = Window.partitionBy(request).orderBy(order)
    first = F.first(payload).over(w)
    return writes.withColumn("outcome", F.when(F.row_number().over(w) == 1, "applied").when(first.eqNullSafe(F.col(payload)), "noop").otherwise("conflict"))
