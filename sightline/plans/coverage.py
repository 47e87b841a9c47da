"""Gaps, representatives, budgets, policies and walks along parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import admission, decision, graph
from ..operators.tables import join_spread, read
from .base import query


@query("""
    WITH g AS (SELECT sha256(text) AS id, min(doc_id) AS representative FROM documents WHERE text IS NOT NULL GROUP BY 1)
    SELECT d.doc_id, representative, l.quality FROM documents d JOIN g ON sha256(d.text) = id LEFT JOIN labels l ON l.doc_id = representative
""")
def representative_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member of a group of equal texts gets the result of the group's representative."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("id"))
    firsts = docs.groupBy("id").agg(F.min("doc_id").alias("representative"))
    results = firsts.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("representative"), "quality"), "representative", "left")
    return join_spread(docs, results, "id").select("doc_id", "representative", "quality")


@query("""
    SELECT l_returnflag || l_linestatus AS code, count(*) AS n, bool_or(l_discount > 0.09) AS critical,
           min(l_orderkey) AS first_order, count(DISTINCT l_suppkey) AS n_owners
    FROM lineitem GROUP BY 1
""")
def gap_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat("l_returnflag", "l_linestatus").alias("code")
    return read(spark, sf_dir, "lineitem").groupBy(code).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_discount") > 0.09).alias("critical"), F.min("l_orderkey").alias("first_order"), F.count_distinct("l_suppkey").alias("n_owners")
    )


@query("""
    SELECT l_partkey, count(*) AS total, count(DISTINCT l_suppkey) AS distinct_states, count(*) FILTER (l_tax = 0) AS killed,
           concat_ws(',', 'A=' || count(*) FILTER (l_returnflag = 'A'), 'N=' || count(*) FILTER (l_returnflag = 'N'), 'R=' || count(*) FILTER (l_returnflag = 'R')) AS histogram
    FROM lineitem GROUP BY 1
""")
def reaching_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = F.concat_ws(",", *[F.concat(F.lit(f"{s}="), F.count_if(F.col("l_returnflag") == s).cast("string")) for s in "ANR"])
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("l_suppkey").alias("distinct_states"), F.count_if(F.col("l_tax") == 0).alias("killed"), histogram.alias("histogram")
    )


@query("""
    WITH e AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
    n AS (SELECT src, dst, count(*) AS n FROM e WHERE dst IS NOT NULL GROUP BY ALL)
    SELECT src, count(*) FILTER (n = 1) AS exact_hops, count(*) FILTER (n > 1) AS ambiguous_hops FROM n GROUP BY src
""")
def exact_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops over which a path is certain have exactly one edge."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null")
    n = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("src").agg(F.count_if(F.col("n") == 1).alias("exact_hops"), F.count_if(F.col("n") > 1).alias("ambiguous_hops"))


@query("""
    WITH RECURSIVE p AS (SELECT c_custkey AS v, CASE WHEN c_custkey % 10 > 0 THEN c_custkey // 2 END AS up FROM customer),
    r(v, top, nxt, steps) AS (SELECT v, v, up, 0::BIGINT FROM p UNION ALL SELECT r.v, r.nxt, p.up, r.steps + 1 FROM r LEFT JOIN p ON p.v = r.nxt WHERE r.nxt IS NOT NULL AND r.nxt <> r.v AND r.steps < 8)
    SELECT v AS vertex, arg_max(top, steps) AS top, max(steps) AS steps, CASE WHEN arg_max(coalesce(nxt, -1), steps) = -1 THEN NULL WHEN arg_max(nxt, steps) = v THEN 'cycle' ELSE 'depth_limit' END AS gap
    FROM r GROUP BY v
""")
def parent_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("c_custkey") % 10 > 0, F.floor(F.col("c_custkey") / 2))
    return graph.walk_up(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vertex"), parent.alias("parent")))


@query("""
    WITH s AS (SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS used FROM orders)
    SELECT o_orderkey, CASE WHEN used <= 1000000 THEN 'full' WHEN used <= 2000000 THEN 'verify_only' ELSE 'deferred' END AS mode FROM s
""")
def budget_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    spent = read(spark, sf_dir, "orders").select("o_orderkey", used.alias("used"))
    return spent.select("o_orderkey", decision.cascade([(F.col("used") <= 1_000_000, "full"), (F.col("used") <= 2_000_000, "verify_only")], "deferred").alias("mode"))


@query("""
    WITH c AS (SELECT coalesce(source, 'none') AS source, CASE WHEN text IS NULL OR n_chars <> length(text) THEN 2 WHEN n_chars < 20 OR lang IS NULL THEN 1 ELSE 0 END AS r FROM documents)
    SELECT source, ['PASS', 'WARN', 'FAIL'][max(r) + 1] AS verdict, count(*) FILTER (r = 1) AS n_warn, count(*) FILTER (r = 2) AS n_fail FROM c GROUP BY 1
""")
def report_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("text").isNull() | (F.col("n_chars") != F.length("text"))
    r = F.when(failed, 2).when((F.col("n_chars") < 20) | F.col("lang").isNull(), 1).otherwise(0)
    checked = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), r.alias("r"))
    verdict = F.element_at(F.array(*map(F.lit, ("PASS", "WARN", "FAIL"))), F.max("r") + 1)
    return checked.groupBy("source").agg(verdict.alias("verdict"), F.count_if(F.col("r") == 1).alias("n_warn"), F.count_if(F.col("r") == 2).alias("n_fail"))


@query("""
    SELECT p_partkey, count(l_orderkey) > 0 AS call_site_exists, coalesce(bool_and(l_discount < 0.1), false) AS argument_constant, count(*) FILTER (l_returnflag = 'N') AS n_unresolved
    FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1
""")
def sink_argument_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.lit(True).alias("call_site_exists"), F.bool_and(F.col("l_discount") < 0.1).alias("argument_constant"), F.count_if(F.col("l_returnflag") == "N").alias("n_unresolved")
    )
    joined = read(spark, sf_dir, "part").select("p_partkey").join(facts, "p_partkey", "left")
    return joined.fillna(False, ["call_site_exists", "argument_constant"]).fillna(0, ["n_unresolved"])


_TURNS = "t AS (SELECT conv_id, turn, length(text)::BIGINT AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"


@query(f"""WITH RECURSIVE {_TURNS},
    g AS (SELECT conv_id, turn, cost, k, cost <= 600 AS admitted, CASE WHEN cost <= 600 THEN cost ELSE 0 END AS used FROM t WHERE k = 1
        UNION ALL SELECT t.conv_id, t.turn, t.cost, t.k, g.used + t.cost <= 600, g.used + CASE WHEN g.used + t.cost <= 600 THEN t.cost ELSE 0 END FROM g JOIN t ON t.conv_id = g.conv_id AND t.k = g.k + 1)
    SELECT conv_id, turn, cost AS n_chars, admitted, used::BIGINT AS used FROM g
""")
def context_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN6: turns of each conversation that fit into its budget; a rejected turn costs nothing."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))
    return admission.greedy(turns, "conv_id", "turn", "n_chars", 600)


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, turn % 5 AS priority, ceil(length(text) / 4)::BIGINT AS cost FROM conversations),
    m AS (SELECT conv_id, coalesce(sum(cost) FILTER (priority <= 1), 0) AS core, count(*) FILTER (priority <= 1) AS n_core FROM t GROUP BY 1),
    o AS (SELECT t.*, 300 - core AS room, 4 - n_core AS places, row_number() OVER (PARTITION BY conv_id ORDER BY priority, turn) AS k FROM t JOIN m USING (conv_id) WHERE priority > 1 AND core <= 300 AND n_core <= 4),
    g AS (SELECT conv_id, turn, k, room, places, CASE WHEN places <= 0 THEN 'context_count_budget' WHEN cost > room THEN 'input_token_budget' END AS reason,
                 CASE WHEN places > 0 AND cost <= room THEN cost ELSE 0 END AS used, CASE WHEN places > 0 AND cost <= room THEN 1 ELSE 0 END AS n FROM o WHERE k = 1
        UNION ALL SELECT o.conv_id, o.turn, o.k, o.room, o.places, CASE WHEN g.n >= o.places THEN 'context_count_budget' WHEN g.used + o.cost > o.room THEN 'input_token_budget' END,
                 g.used + CASE WHEN g.n < o.places AND g.used + o.cost <= o.room THEN o.cost ELSE 0 END, g.n + CASE WHEN g.n < o.places AND g.used + o.cost <= o.room THEN 1 ELSE 0 END
          FROM g JOIN o ON o.conv_id = g.conv_id AND o.k = g.k + 1)
    SELECT t.conv_id, t.turn, reason IS NULL AS selected, reason,
           CASE WHEN core > 300 OR n_core > 4 THEN 'cannot_trim_safely' WHEN bool_or(reason IS NOT NULL) OVER (PARTITION BY t.conv_id) THEN 'trimmed' ELSE 'within_budget' END AS status
    FROM t JOIN m USING (conv_id) LEFT JOIN g ON g.conv_id = t.conv_id AND g.turn = t.turn
""")
def context_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO6: turns of each conversation by rank: the first two ranks whole or not at all, the others while they fit."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 5).alias("priority"), F.ceil(F.length("text") / 4).alias("cost"))
    return admission.contexts(turns, "conv_id", "priority", "turn", "cost", 300, 4).select("conv_id", "turn", "selected", "reason", "status")
