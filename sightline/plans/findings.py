"""Aggregation of findings, order, budgets, the store and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lattice
from ..operators import store
from ..operators.tables import read
from ..operators.windows import running_total
from .base import query

_STATUS = "CASE {x} % 5 WHEN 0 THEN 'unprotected' WHEN 1 THEN 'conditional' WHEN 2 THEN 'unknown' WHEN 3 THEN 'protected' ELSE 'strongly_protected' END"


@query(f"""
    WITH f AS (SELECT *, {_STATUS.format(x='o_orderkey')} AS auth, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END AS r FROM orders),
    g AS (SELECT o_custkey, max((o_totalprice, o_orderkey)) AS best, min(r) AS r, count(*) AS n_members, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM f GROUP BY 1)
    SELECT o_custkey, p.o_orderkey AS primary_id, p.o_orderstatus AS primary_status,
           ['unprotected', 'conditional', 'unknown', 'protected', 'strongly_protected'][r + 1] AS authorization_status, n_members, priorities
    FROM g JOIN orders p USING (o_custkey) WHERE (p.o_totalprice, p.o_orderkey) = best
""")
def findings_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary finding is the largest by rank and gives its own fields; statuses merge over all members."""
    auth = F.expr(_STATUS.format(x="o_orderkey"))
    primary = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_totalprice", "o_orderkey"))
    found = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        primary.alias("best"), lattice.least(auth, lattice.AUTHORIZATION).alias("authorization_status"), F.count(F.lit(1)).alias("n_members"),
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"),
    )
    return found.select("o_custkey", F.col("best.o_orderkey").alias("primary_id"), F.col("best.o_orderstatus").alias("primary_status"), "authorization_status", "n_members", "priorities")


@query("""
    WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O')
    SELECT o_orderkey, k::INTEGER AS place FROM r WHERE k <= 20
""")
def triage_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty candidates that the budget allows; a top-k first, so that only these are numbered in one task."""
    order = ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"]
    best = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice", "o_orderpriority").orderBy(*order).limit(20)
    return best.select("o_orderkey", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("""
    WITH s AS (SELECT doc_id, source, length(text)::BIGINT AS n, sum(length(text)) OVER (PARTITION BY source, lang ORDER BY doc_id)::BIGINT AS used,
                      row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents)
    SELECT doc_id, source, n FROM s WHERE used <= 50000 OR k = 1
""")
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by source and language up to a budget of characters; the first one always stays."""
    sized = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").cast("long").alias("n"))
    summed = running_total(sized, ["source", "lang"], ["doc_id"], {"used": F.col("n"), "k": F.lit(1)})
    return summed.where("(used <= 50000 and n is not null) or k = 1").select("doc_id", "source", "n")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(length(text), turn)::BIGINT AS n_chars FROM conversations GROUP BY 1")
def last_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("turn", "role", F.length("text").cast("long").alias("n_chars")), "turn")
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(last.alias("last")).select("conv_id", "last.*")


@query("""
    WITH u AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations WHERE role = 'user')
    SELECT u.conv_id, u.turn AS start_turn, count(*) AS n_turns, sum(length(c.text))::BIGINT AS n_chars
    FROM u JOIN conversations c ON c.conv_id = u.conv_id AND c.turn >= u.turn AND (c.turn < u.next_turn OR u.next_turn IS NULL) GROUP BY 1, 2
""")
def case_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn opens a case that lasts until the next one: a running count instead of a range join."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    start = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    return read(spark, sf_dir, "conversations").withColumn("start_turn", start).where("start_turn is not null").groupBy("conv_id", "start_turn").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("n_chars")
    )


_OLD, _NEW = "o_orderkey % 4 <> 0", "o_orderkey % 3 <> 0"


@query(f"""
    WITH o AS (SELECT o_orderkey AS id, o_totalprice AS score, o_orderpriority AS review, o_orderstatus = 'F' AS deleted FROM orders WHERE {_OLD}),
    n AS (SELECT o_orderkey AS id, o_totalprice * 2 AS score FROM orders WHERE {_NEW})
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.score ELSE o.score END AS score, review, n.id IS NULL AS deleted,
           CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NOT NULL AND deleted THEN 'revive' WHEN n.id IS NOT NULL THEN 'update' WHEN deleted THEN 'keep_deleted' ELSE 'delete' END AS action
    FROM o FULL JOIN n ON o.id = n.id
""")
def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    old = orders.where(_OLD).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("review"), (F.col("o_orderstatus") == "F").alias("deleted"))
    new = orders.where(_NEW).select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * 2).alias("score"))
    return store.merge(old, new, "id", ["score"], ["review"])


@query("""
    WITH w AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, first(role) OVER (PARTITION BY conv_id ORDER BY turn) AS payload FROM conversations)
    SELECT conv_id, turn, CASE WHEN k = 1 THEN 'applied' WHEN payload = role THEN 'noop' ELSE 'conflict' END AS outcome FROM w
""")
def review_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.review_outcomes(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "role", "turn").select("conv_id", "turn", "outcome")


@query("""
    WITH g AS (SELECT c_nationkey, c_mktsegment, arg_max(c_custkey, (c_acctbal, c_custkey)) AS winner, count(*) AS n_rows, min(c_custkey) AS created FROM customer GROUP BY ALL)
    SELECT c_custkey, winner, winner = c_custkey AS stays, n_rows, created FROM customer JOIN g USING (c_nationkey, c_mktsegment)
""")
def migration_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows that a migration makes equal one wins; all the others are to point to it."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    won = rows.groupBy("c_nationkey", "c_mktsegment").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("winner"), F.count(F.lit(1)).alias("n_rows"), F.min("c_custkey").alias("created"))
    return rows.join(won, ["c_nationkey", "c_mktsegment"]).select("c_custkey", "winner", (F.col("winner") == F.col("c_custkey")).alias("stays"), "n_rows", "created")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS starts, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import events

    return events.windows(read(spark, sf_dir, "events"), "1 hour")


@query("""
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, min(ts) AS starts, count(*) AS n FROM s GROUP BY user_id, session
""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import events

    return events.sessions(read(spark, sf_dir, "events"), "30 minutes")
