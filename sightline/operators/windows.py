"""Running totals along an order, of groups of any size: no group has to fit into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import unused, written


def running_total(rows: DataFrame, scope: list[str], order: list[str], value: Column | dict[str, Column], name: str = "") -> DataFrame:
    """rows with name: the sum of value (null: 0) over the rows of the scope up to this one, in order (nulls first); or the
    sums of several values by name. Rows that scope and order do not tell apart may stand in any order among each other.

    Rows are dealt by ranges of scope and order, summed in each part of a scope, and the parts' sums are added up. A part
    continues one scope at most from the part before, so what is broadcast is as long as there are parts.
    """
    values = value if isinstance(value, dict) else {name: value}
    part, *own = unused([*rows.columns, *values], "part_of_scope", *[f"value_{n}_of_row" for n in values])
    ahead = [f"ahead_{i}" for i in range(len(own))]
    ranged = rows.withColumns({o: F.coalesce(v, F.lit(0)) for o, v in zip(own, values.values(), strict=True)})
    ranged = written(ranged.repartitionByRange(*[F.col(f"`{c}`") for c in (*scope, *order)]).withColumn(part, F.spark_partition_id()))
    scoped = [F.col(f"`{c}`") for c in scope]
    sums = ranged.groupBy(*scoped, part).agg(*[F.sum(o).alias(o) for o in own])
    before = Window.partitionBy(*scoped).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumns({a: F.sum(o).over(before) for a, o in zip(ahead, own, strict=True)}).where(F.col(ahead[0]).isNotNull())
    offsets = offsets.select(*[c.alias(f"at_{i}") for i, c in enumerate(scoped)], F.col(part).alias("at_part"), *ahead)
    same = ranged[part] == F.col("at_part")
    for i, c in enumerate(scope):
        same &= ranged[f"`{c}`"].eqNullSafe(F.col(f"at_{i}"))
    inside = Window.partitionBy(*scoped, part).orderBy(*[F.col(f"`{c}`") for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), same, "left")
    out = out.withColumns({n: F.coalesce(F.col(a), F.lit(0)) + F.sum(o).over(inside) for n, a, o in zip(values, ahead, own, strict=True)})
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *values)
