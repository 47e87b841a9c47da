"""Scores of predictions against labels, and the gate that compares two sets of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b to six digits, 0 if b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, 6))


def confusion(df: DataFrame, truth: Column, predicted: Column, category: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 by category and, as category `total`, over all rows. F1 is made of the
    rounded precision and recall. Rows without truth or prediction count nowhere."""
    held = df.select(F.coalesce(category, F.lit("none")).alias("c"), truth.alias("t"), predicted.alias("p")).where("t is not null and p is not null")
    n = lambda cond: F.count_if(cond).alias
    t, p = F.col("t"), F.col("p")
    counts = held.rollup("c").agg(n(t & p)("tp"), n(~t & p)("fp"), n(t & ~p)("fn"), n(~t & ~p)("tn"))
    scored = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both)).withColumn("category", F.coalesce("c", F.lit("total"))).drop("c")


#: The metrics that the gate looks at.
GATED = ("aggregate.explorer_hit_rate", "aggregate.conditional_hit_rate", "metrics.candidate.precision", "metrics.candidate.recall", "metrics.candidate.f1")


def gate(current: DataFrame, baseline: DataFrame, tolerances: dict[str, float] | None = None, metrics: tuple[str, ...] = GATED) -> DataFrame:
    """metric, current, baseline, deficit, verdict, gate for each of the metrics.

    A metric without a baseline is skipped; one that is missing now, or worse by more than its tolerance (by its short
    name, else 0), blocks. The gate blocks if a metric does, or if no metric has a baseline. The result has one row per
    listed metric, whatever the inputs hold.
    """
    spark = current.sparkSession
    short = lambda name: (tolerances or {}).get(name.rsplit(".", 1)[-1], 0.0)
    listed = spark.createDataFrame([(m, float(short(m))) for m in metrics], "metric string, tolerance double")
    side = lambda df, name: df.groupBy("metric").agg(F.max("value").alias(name))
    both = listed.join(side(current, "current"), "metric", "left").join(side(baseline, "baseline"), "metric", "left")
    deficit = F.round(F.col("baseline") - F.col("current"), 10)
    verdict = F.when(F.col("baseline").isNull(), "SKIP").when(F.col("current").isNull() | (deficit > F.col("tolerance")), "BLOCK").otherwise("ALLOW")
    judged = both.select("metric", "current", "baseline", deficit.alias("deficit"), verdict.alias("verdict"))
    whole = judged.agg((F.bool_or(F.col("verdict") == "BLOCK") | F.bool_and(F.col("verdict") == "SKIP")).alias("stop"))
    return judged.crossJoin(F.broadcast(whole)).withColumn("gate", F.when(F.col("stop"), "BLOCK").otherwise("ALLOW")).drop("stop")  # one row joined
