"""Resolving references to targets: by key with fallback, by interval, by any of several keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import unused


def by_key(calls: DataFrame, targets: DataFrame, keys: list[str], target_id: str, fallback: list[str] | None = None) -> DataFrame:
    """Add target and status to calls: exactly one target of the key is `resolved`, more are `ambiguous`, none leaves
    the call `pending`. With fallback keys, these are tried only if the first have no target at all.

    Targets are counted by key before the join, so ambiguous keys never multiply rows. Null keys match nothing.
    """
    names = unused(calls.columns, "n_first", "id_first", "n_second", "id_second")

    def counted(on: list[str], n: str, first: str) -> DataFrame:
        return targets.groupBy(*on).agg(F.count(F.lit(1)).alias(n), F.min(target_id).alias(first))

    out = calls.join(counted(keys, names[0], names[1]), keys, "left")
    n, found = F.col(names[0]), F.col(names[1])
    if fallback:
        out = out.join(counted(fallback, names[2], names[3]), fallback, "left")
        n, found = F.coalesce(n, names[2]), F.when(n.isNull(), F.col(names[3])).otherwise(found)
    status = F.when(n.isNull(), "pending").when(n == 1, "resolved").otherwise("ambiguous")
    out = out.withColumns({"target": F.when(n == 1, found), "status": status})
    return out.drop(*names)


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, point_id: str) -> DataFrame:
    """For each point the shortest span of its key that holds it (start <= at <= end); a tie of spans is no match.

    spans: key, span_id, start, end (whole numbers). Points without a span have a null span_id.
    """
    near = holding(points.select(point_id, key, at), spans, key, at)
    size = F.col("end").cast("double") - F.col("start").cast("double")
    # The first and the last id of the shortest spans, in one aggregation: they differ where spans tie.
    first, last = F.min(F.struct(size.alias("size"), "span_id")).getField("span_id"), F.max(F.struct((-size).alias("size"), "span_id")).getField("span_id")
    best = near.groupBy(point_id).agg(first.alias("a"), last.alias("b")).select(point_id, F.when(F.col("a") == F.col("b"), F.col("a")).alias("span_id"))
    return points.join(best, point_id, "left")


def holding(points: DataFrame, spans: DataFrame, key: str, at: str) -> DataFrame:
    """Points with the spans of their key that hold them. Each span lies in at most two bins of a width near its own
    length; a point asks for its bin of each width that spans have. So a point meets spans about its own place alone,
    not all spans of its key: one equi-join, with twice the spans and as many copies of a point as there are widths."""
    length = F.col("end") - F.col("start") + 1
    level = F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")
    sized = spans.where("start <= end").withColumn("level_of_span", level)
    widths = [r[0] for r in sized.select("level_of_span").distinct().collect()]  # at most 64
    bin_of = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(2.0), level)).cast("long")
    binned = sized.withColumn("bin", F.explode(F.array_distinct(F.array(bin_of("start", F.col("level_of_span")), bin_of("end", F.col("level_of_span"))))))
    asked = points.withColumn("level_of_span", F.explode(F.array(*map(F.lit, widths)).cast("array<int>"))).withColumn("bin", bin_of(at, F.col("level_of_span")))
    return asked.join(binned, [key, "level_of_span", "bin"]).where((F.col(at) >= F.col("start")) & (F.col(at) <= F.col("end"))).drop("level_of_span", "bin")


def overlapping(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id of the pairs of spans of one key that share a place (start and end in both, whole numbers). Of two
    such spans the start of one lies in the other, so each pair is found there: once, at the later start."""
    a = left.select(key, F.col(left_id).alias("left_of_pair"), F.col("start").alias("left_start"), "end")
    b = right.select(key, F.col(right_id).alias("right_of_pair"), F.col("start").alias("right_start"), "end")
    spans = lambda df, start, span: df.select(key, F.col(start).alias("start"), "end", F.col(span))
    inside = holding(b.where("right_start <= end").drop("end"), spans(a, "left_start", "left_of_pair"), key, "right_start")
    before = holding(a.where("left_start <= end").drop("end"), spans(b, "right_start", "right_of_pair"), key, "left_start").where(F.col("left_start") > F.col("start"))
    pairs = inside.select("left_of_pair", "right_of_pair").unionByName(before.select("left_of_pair", "right_of_pair"))
    return pairs.select(F.col("left_of_pair").alias(left_id), F.col("right_of_pair").alias(right_id))


def by_any_key(left: DataFrame, right: DataFrame, left_keys: list[Column], right_keys: list[Column], left_id: str, right_id: str, order: str) -> DataFrame:
    """For each left row that shares at least one key with right rows, the first of these in order.

    Keys are exploded into one typed column; right rows collapse to their first by key before the join.
    """
    typed = lambda keys: F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), k.cast("string").alias("value")) for i, k in enumerate(keys)]))
    a = left.select(left_id, typed(left_keys).alias("key")).where("key.value is not null")
    b = right.select(typed(right_keys).alias("key"), F.struct(F.col(order).alias("place"), F.col(right_id).alias("id")).alias("first")).where("key.value is not null").groupBy("key").agg(F.min("first").alias("first"))
    return a.join(b, "key").groupBy(left_id).agg(F.min("first").getField("id").alias(right_id))
