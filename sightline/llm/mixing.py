"""Mixing sources to target weights: temperature, then budgeted block permutations.

The token shares of the sources are raised to an exponent between 0 (all sources alike) and 1 (as they are) and made
to sum to one. The exponent is bisected to meet a target entropy of the weights, or a limit to how often a source's
text repeats. Each source gets a quota of tokens. Its documents are dealt to blocks, and every pass over the source is
a new permutation of its blocks: whole passes as long as the quota lasts, then blocks of one more pass until it is
used up, the last of them up to the document in which the quota ends.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop_table, text_of, unused, write_table

BLOCK_TOKENS = 65_536
#: Sources up to this number are weighed on the driver and broadcast; more are weighed by jobs and joined by shuffle.
DRIVER_SOURCES = 100_000
BISECTIONS = 50


@dataclass(frozen=True)
class Target:
    """What to meet. Exactly one of entropy (nats) and repetition (passes over a source at most) is given.

    budget: tokens to hand out over all sources. None: the least budget that hands out every document at least once.
    """

    entropy: float | None = None
    repetition: float | None = None
    budget: int | None = None
    block_tokens: int = BLOCK_TOKENS
    seed: str = "mix"

    def __post_init__(self) -> None:
        if (self.entropy is None) == (self.repetition is None):
            raise ValueError("give either entropy or repetition")


def word_count(text: Column) -> Column:
    """Words parted by blanks, tabs and line ends."""
    return F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")).cast("long")


def source_of(docs: DataFrame) -> Column:
    """The source as a key; null counts as the source without a name."""
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _doc_key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _block(n_blocks: Column) -> Column:
    return F.pmod(F.conv(F.substring("doc_key", 1, 8), 16, 10).cast("long"), n_blocks)


def _block_key(seed: str) -> Column:
    """The place of a block in the permutation of a pass."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), "mix_source", F.col("block").cast("string")).cast("binary"))


def bisect(meets: Callable[[float], bool]) -> float:
    """The least exponent in [0, 1] that meets a condition which holds from some exponent on; 1 if none does."""
    if meets(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(BISECTIONS):
        middle = (low + high) / 2
        low, high = (low, middle) if meets(middle) else (middle, high)
    return high


def exponent(sizes: DataFrame, target: Target) -> float:
    """The exponent for sources (mix_source, tokens) with tokens."""
    sizes = sizes.where("tokens > 0")
    totals = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("all"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not totals["n"]:
        return 1.0
    if totals["n"] <= DRIVER_SOURCES:
        tokens = [r["tokens"] for r in sizes.select("tokens").collect()]
        norm = lambda a: math.fsum((t / totals["most"]) ** a for t in tokens)
        slope = lambda a: math.fsum((t / totals["most"]) ** a * math.log((t / totals["most"]) ** a) for t in tokens)
    else:
        share = F.col("tokens") / F.lit(totals["most"])
        norm = lambda a: sizes.agg(F.sum(F.pow(share, F.lit(a)))).first()[0]
        slope = lambda a: sizes.agg(F.sum(F.pow(share, F.lit(a)) * F.log(F.pow(share, F.lit(a))))).first()[0]
    if target.entropy is not None:
        # The entropy of the weights falls as the exponent grows: the largest exponent with at least the target.
        return 1 - bisect(lambda b: math.log(norm(1 - b)) - slope(1 - b) / norm(1 - b) >= target.entropy)
    smallest = totals["least"] / totals["most"]
    # passes over the smallest source, which repeats most
    passes = (lambda a: smallest ** (a - 1)) if target.budget is None else (lambda a: target.budget * smallest**a / norm(a) / totals["least"])
    return bisect(lambda a: passes(a) <= target.repetition)


def quotas(sizes: DataFrame, target: Target) -> DataFrame:
    """Sources (mix_source, tokens, n_docs) with weight, quota, full_epochs (whole passes), rest (tokens of the pass
    after them) and n_blocks. A source without tokens weighs nothing; it is handed out once if budget is None."""
    alpha = exponent(sizes, target)
    totals = sizes.agg(F.max("tokens").alias("most")).first()
    most = max(1, totals["most"] or 0)
    norm = sizes.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / most, F.lit(alpha)))).first()[0] or 1.0
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / most, F.lit(alpha))).otherwise(0.0)
    budget = target.budget if target.budget is not None else most * norm
    out = sizes.withColumn("weight", power / norm)
    out = out.withColumn("quota", F.round(F.lit(float(budget)) * F.col("weight")).cast("long"))
    full = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0 if target.budget is not None else 1)
    out = out.withColumn("full_epochs", full.cast("int")).withColumn("rest", F.col("quota") - F.col("full_epochs") * F.col("tokens"))
    return out.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / target.block_tokens)).cast("long"))


def _first_over(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of rows (*by, order, n, rest) the one of each group in which the running sum of n reaches rest; rest becomes
    what is left of it for that row."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("upto", F.sum("n").over(window))
    return summed.where("upto >= rest and upto - n < rest").withColumn("rest", F.col("rest") - F.col("upto") + F.col("n")).drop("upto", "n")


def plan(docs: DataFrame, target: Target) -> DataFrame:
    """One row per source: mix_source, tokens, n_docs, weight, quota, full_epochs, rest, n_blocks, and where the pass
    after the whole ones ends: cut_key (key of its last block) and cut_doc (key of the last document there).

    The end is found in three steps, so that no window holds more than a share of a source: keys by their first three
    digits, the blocks of one such bucket, the documents of one block.
    """
    spark = docs.sparkSession
    counted = docs.select("doc_id", source_of(docs).alias("mix_source"), word_count(text_of()).alias("n_tokens")).withColumn("doc_key", _doc_key(target.seed))
    counted = write_table(counted, "token-counts")
    sizes = counted.groupBy("mix_source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    counts = write_table(sizes, "source-sizes")
    sources = write_table(quotas(counts, target), "quotas")

    cut = _small(sources.where("rest > 0").select("mix_source", "n_blocks", "rest", F.col("full_epochs").alias("epoch")))
    dealt = counted.join(cut, "mix_source").withColumn("block", _block(F.col("n_blocks")))
    blocks = dealt.groupBy("mix_source", "block", "epoch", "rest").agg(F.sum("n_tokens").alias("n"))
    blocks = write_table(blocks.withColumn("key", _block_key(target.seed)).withColumn("bucket", F.substring("key", 1, 3)), "blocks")
    bucket = _first_over(blocks.groupBy("mix_source", "bucket", "rest").agg(F.sum("n").alias("n")), ["mix_source"], "bucket")
    block = _first_over(blocks.drop("rest").join(_small(bucket), ["mix_source", "bucket"]), ["mix_source"], "key").select("mix_source", "block", F.col("key").alias("cut_key"), "rest")
    in_block = dealt.drop("rest", "epoch").join(_small(block), ["mix_source", "block"]).groupBy("mix_source", "cut_key", "doc_key", "rest").agg(F.sum("n_tokens").alias("n"))
    last = _first_over(in_block, ["mix_source"], "doc_key").select("mix_source", "cut_key", F.col("doc_key").alias("cut_doc"))
    out = write_table(sources.join(last, "mix_source", "left"), "mix-plan")
    for table in (counted, counts, sources, blocks):
        drop_table(table)
    return out


def _small(sources: DataFrame) -> DataFrame:
    """A table with a row per source, broadcast if its count is within the bound."""
    return F.broadcast(sources) if sources.count() <= DRIVER_SOURCES else sources


OUT = ("epoch", "block", "block_key", "doc_key")


def realise(docs: DataFrame, plan_: DataFrame, target: Target, into: tuple[str, str, str, str] = OUT) -> DataFrame:
    """The rows handed out: each document as often as passes reach it, with epoch (pass), block, block_key and doc_key;
    ordering a source by epoch, block_key, doc_key gives its stream. No text is shuffled.

    Columns of docs stay, whatever their names; those with the names of the results are replaced (give other names to
    keep them). Documents without words are part of their block. Rows that share a doc_id go together. Null doc_id,
    text and source count as empty.
    """
    names = [c for c in docs.columns if c not in into]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), source_of(docs).alias("mix_source"), _doc_key(target.seed).alias("doc_key"))
    rows = keyed.join(_small(plan_.select("mix_source", "full_epochs", "n_blocks", "cut_key", "cut_doc")), "mix_source")
    rows = rows.withColumn("block", _block(F.col("n_blocks"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full_epochs"))))
    rows = rows.withColumn("block_key", _block_key(target.seed))
    inside = (F.col("block_key") < F.col("cut_key")) | ((F.col("block_key") == F.col("cut_key")) & (F.col("doc_key") <= F.col("cut_doc")))
    kept = rows.where((F.col("epoch") < F.col("full_epochs")) | F.coalesce(inside, F.lit(False)))
    return kept.select("row.*", *[F.col(own).alias(name) for own, name in zip(OUT, into, strict=True)])


def mix(docs: DataFrame, target: Target, into: tuple[str, str, str, str] = OUT) -> DataFrame:
    """Plan over all rows, then realise. An empty table gives no rows."""
    return realise(docs, plan(docs, target), target, into)


def repeat(docs: DataFrame, target: Target) -> DataFrame:
    """The rows handed out with the columns of docs alone, all of them untouched."""
    return mix(docs, target, unused(docs, *OUT)).select(*[f"`{c}`" for c in docs.columns])
