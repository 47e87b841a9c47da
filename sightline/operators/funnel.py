"""Groups of candidates that are the same, and results handed from a representative to its group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import KEYS, content, identified, keys_once, semantic_keys
from .tables import join_spread, written

__all__ = ["KEYS", "groups", "identified", "propagated"]


def _order(member: str, locations: str | None) -> list[Column]:
    """What makes a member represent its group: it needs an analysis, then the highest risk, most locations, largest id."""
    places = F.greatest(F.size(locations), F.lit(0)) if locations else F.lit(0)
    return [F.coalesce("needs", F.lit(False)).alias("needs"), F.coalesce("risk", F.lit(0)).alias("risk"), places.alias("places"), F.col(member)]


def groups(rows: DataFrame, member: str, locations: str | None = None) -> DataFrame:
    """One row per identity: the keys, representative, its risk, n_members and group_needs (whether a member that no
    guard blocks needs an analysis). One aggregation, which collapses members before the shuffle. Null keys are keys."""
    best = F.max(F.struct(*_order(member, locations)))
    found = rows.groupBy(*KEYS).agg(best.alias("best"), F.count(F.lit(1)).alias("n_members"), F.bool_or(F.coalesce(F.col("needs") & ~F.coalesce("guard_blocked", F.lit(False)), F.lit(False))).alias("group_needs"))
    return found.select(*KEYS, F.col(f"best.{member}").alias("representative"), F.col("best.risk").alias("risk"), "n_members", "group_needs")


def propagated(rows: DataFrame, member: str, result: str, locations: str | None = None, leave_out: tuple[str, ...] = (), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Rows with representative, the representative's result, and result_source (null where the own result stays).

    rows carry the keys that were recorded with them. They are computed anew: a row whose recorded keys differ from its
    own keeps its result, and a representative whose keys differ hands nothing on. Members of large groups are not dealt
    to one task. keep: the columns of rows to hand on beside member and result; all, if None.
    """
    now, leave_out = ("scope_now", "chain_now", "fact_now"), (member, *leave_out)
    kept = [c for c in rows.columns if keep is None or c in (member, result, *keep)]
    order = F.struct(*_order(member, locations), F.col(result)).alias("order_of_row")
    recorded = [F.col(k).alias(f"{k}_of_row") for k in KEYS]
    keyed = written(rows.select(*kept, *recorded, order, content(rows, leave_out).alias("content_of_row")))
    keys = keys_once(rows, member, keyed.select(member, "content_of_row"), "content_of_row", now, leave_out)
    if keys is None:
        keyed = rows.select(*kept, *recorded, order, F.lit(None).alias("content_of_row"), *[c.alias(n) for n, c in zip(now, semantic_keys(rows, leave_out), strict=True)])
    else:
        keyed = keyed.join(F.broadcast(keys), "content_of_row")
    sound = reduce(Column.__and__, [F.col(f"{k}_of_row") == F.col(n) for k, n in zip(KEYS, now, strict=True)])
    identity = F.concat_ws(":", *[F.coalesce(f"{k}_of_row", F.lit("~")) for k in KEYS])
    order = F.struct("order_of_row.*", F.coalesce(sound, F.lit(False)).alias("sound_row"))
    keyed = written(keyed.select(*kept, identity.alias("identity_of_row"), order.alias("order_of_row")))
    joined = join_spread(keyed, keyed.groupBy("identity_of_row").agg(F.max("order_of_row").alias("best_of_row")), "identity_of_row")
    handed = F.col("order_of_row.sound_row") & F.col("best_of_row.sound_row") & (F.col(f"best_of_row.{member}") != F.col(member))
    return joined.withColumns({
        "representative": F.col(f"best_of_row.{member}"), result: F.when(handed, F.col(f"best_of_row.{result}")).otherwise(F.col(result)), "result_source": F.when(handed, F.col(f"best_of_row.{member}")),
    }).drop("identity_of_row", "best_of_row", "order_of_row")
