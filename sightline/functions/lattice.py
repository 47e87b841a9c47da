"""Ranked statuses and their merges. Every table is a fixed value; a merge is the least rank, with few exceptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, weakest protection first.
AUTHORIZATION = ("unprotected", "conditional", "unknown", "protected", "strongly_protected")
#: Fixed values. Guards: the status that hides the others first. Analyses: unsuccessful ones, then successful ones.
GUARD = ("unknown", "present_partial", "present_bypassable", "absent", "other", "present_effective")
ANALYSIS_FAILED, ANALYSIS_DONE = ("ai_failed", "ai_incomplete", "ai_skipped"), ("human_confirmed", "ai_completed")
REVIEW = ("confirmed", "pending_ai", "pending_manual")
REVIEW_FALSE = ("ai_false_positive", "manual_false_positive")
SEVERITY = ("critical", "high", "medium", "low", "informational", "pending")


def rank(status: Column, order: tuple[str, ...]) -> Column:
    """Place in the order from 0; a status outside it has none."""
    table = F.create_map(*[F.lit(x) for pair in zip(order, range(len(order)), strict=True) for x in pair])
    return F.try_element_at(table, status)


def named(place: Column, order: tuple[str, ...]) -> Column:
    return F.when(place.isNotNull(), F.get(F.array(*map(F.lit, order)), place))


def least(status: Column, order: tuple[str, ...], none: str = "unknown") -> Column:
    """Aggregate: the status that comes first in the order; null and a group without any count as `none`."""
    return named(F.coalesce(F.min(rank(F.coalesce(status, F.lit(none)), order)), F.lit(order.index(none))), order)


def strongest(status: Column, order: tuple[str, ...]) -> Column:
    """Aggregate: the status that comes last in the order; without any, the first of the order."""
    return named(F.coalesce(F.max(rank(status, order)), F.lit(0)), order)


def guard(status: Column) -> Column:
    """Aggregate of guard statuses. Absent beside effective is a way around the guard. A status outside the table only
    spoils what is otherwise effective."""
    place = F.coalesce(rank(F.coalesce(status, F.lit("unknown")), GUARD), F.lit(GUARD.index("other")))
    worst, best = F.min(place), F.max(place)
    around = (worst == GUARD.index("absent")) & (best == GUARD.index("present_effective"))
    found = F.when(around, "present_bypassable").otherwise(named(worst, GUARD))
    return F.when(found == "other", "unknown").otherwise(F.coalesce(found, F.lit("unknown")))


def analysis(status: Column) -> Column:
    """Aggregate of analysis statuses: the worst failure, `ai_partial` if there is a success too; else the best success."""
    failed, done = F.min(rank(status, ANALYSIS_FAILED)), F.min(rank(status, ANALYSIS_DONE))
    return F.when(failed.isNotNull() & done.isNotNull(), "ai_partial").otherwise(F.coalesce(named(failed, ANALYSIS_FAILED), named(done, ANALYSIS_DONE), F.lit("rule_only")))


def review(status: Column) -> Column:
    """Aggregate of review statuses: the first open one; false positives only if all members agree on the kind."""
    only = F.when((F.min(status) == F.max(status)) & F.min(status).isin(*REVIEW_FALSE) & (F.count(status) == F.count(F.lit(1))), F.min(status))
    return F.coalesce(named(F.min(rank(status, REVIEW)), REVIEW), only, F.lit("pending_manual"))


def one_or_mixed(value: Column, none: str) -> Column:
    """Aggregate: the value that all members share, or `mixed`; null counts as `none`."""
    value = F.coalesce(value, F.lit(none))
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise("mixed")
