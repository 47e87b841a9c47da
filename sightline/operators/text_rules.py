"""Detection rules over text: pattern hits with line numbers, token search, identity by content."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line with line_no from 1; a null text has no lines, an empty one a single empty line."""
    return df.select("*", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).withColumn("line_no", (F.col("pos") + 1).cast("long")).drop("pos", text)


def hits(df: DataFrame, rules: dict[str, str], text: str = "text") -> DataFrame:
    """A row for each line and rule whose pattern occurs in it: the other columns, line_no, rule_id (columns of these
    names are replaced). Only texts in which some pattern occurs at all are cut into lines."""
    names = [c for c in df.columns if c not in (text, "line_no", "rule_id")]
    some = reduce(lambda a, b: a | b, [F.col(text).rlike(f"(?m){pattern}") for pattern in rules.values()])
    cut = df.where(some).select(F.struct(*[f"`{c}`" for c in names]).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("at", "held"))
    each = F.array(*[F.when(F.col("held").rlike(pattern), F.lit(rule)) for rule, pattern in rules.items()])
    found = cut.select("row", "at", F.explode(F.filter(each, lambda r: r.isNotNull())).alias("rule_id"))
    return found.select("row.*", (F.col("at") + 1).cast("long").alias("line_no"), "rule_id")


def first_of_equal(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows with equal keys the first in order; found by aggregation, so copies collapse before the shuffle."""
    kept = df.groupBy(key.alias("_key")).agg(F.min(order).alias(order)).select(order)
    return df.join(kept, order, "left_semi")


def has_token(text: Column, terms: list[str]) -> Column:
    """Whether the lower-cased text has one of the terms as a whole token of letters, digits, _ and $. The text is read
    once, without an array of its tokens."""
    any_of = "|".join(re.escape(t) for t in terms)
    return F.lower(text).rlike(rf"(?<![a-z0-9_$])(?:{any_of})(?![a-z0-9_$])")


def has_word(text: Column, words: list[str]) -> Column:
    """Whether one of the words occurs between word boundaries, in any case."""
    return text.rlike(r"(?i)\b(" + "|".join(words) + r")\b")
