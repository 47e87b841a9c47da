"""Lookups, filters and orders. Customers are read as classes (segment as package, nation as simple name), parts as
called methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookups
from ..operators.tables import read
from .base import query

_QUALIFIED = "'com.' || lower(c_mktsegment) || '.N' || (c_custkey % 40)"
_CLASSES = f"SELECT c_custkey, {_QUALIFIED} AS qualified, 'N' || (c_custkey % 40) AS name, CASE WHEN c_custkey % 6 = 0 THEN 'com/' || lower(c_mktsegment) || '/N' || (c_custkey % 40) || CASE WHEN c_custkey % 12 = 0 THEN '.kt' ELSE '.java' END ELSE 'src/' || c_custkey || '.java' END AS path FROM customer WHERE c_custkey % 40 < 30 OR c_mktsegment = 'BUILDING'"
_ASKED = "SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'com.building.N' || (s_suppkey % 45) WHEN 1 THEN 'com.machinery.N' || (s_suppkey % 45) || '$Inner' ELSE 'com.none.N' || (s_suppkey % 45) END AS component FROM supplier"


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    for name in ("customer", "supplier"):
        read(spark, sf_dir, name).createOrReplaceTempView(f"lookup_{name}")
    return spark.sql(_ASKED.replace("supplier", "lookup_supplier")), spark.sql(_CLASSES.replace("FROM customer", "FROM lookup_customer"))


_A = f"c AS ({_CLASSES}), a AS (SELECT component, split_part(component, '$', 1) AS full_name, split_part(split_part(component, '$', 1), '.', 3) AS simple FROM ({_ASKED}) x)"


_LAST = ("simple", "split_part(component, '.', 3)")


@query(f"""
    WITH {_A} SELECT DISTINCT component, path FROM a JOIN c ON qualified IN (component, full_name) OR replace(full_name, '.', '/') || '.java' = path
    OR {" OR ".join(f"{last} = name OR lower(path) LIKE '%/' || lower({last}) || '.java' OR lower(path) LIKE '%/' || lower({last}) || '.kt'" for last in _LAST)}
""")
def files_of_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT2: the files of components by full name, simple name or path; the outer class stands for nested ones."""
    return lookups.files_of_components(*_frames(spark, sf_dir), strict=False)


@query(f"""
    WITH {_A}, sure AS (SELECT DISTINCT component, path FROM a JOIN c ON full_name = qualified OR path IN (replace(full_name, '.', '/') || '.java', replace(full_name, '.', '/') || '.kt'))
    SELECT * FROM sure UNION ALL
    SELECT DISTINCT component, path FROM a JOIN c ON simple = name WHERE component NOT IN (SELECT component FROM sure) AND name IN (SELECT name FROM c GROUP BY name HAVING count(DISTINCT qualified) = 1)
""")
def files_of_components_strictly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT3: the same, the simple name only if it is unique and nothing else was found."""
    return lookups.files_of_components(*_frames(spark, sf_dir), strict=True)


@query("""
    (SELECT 'customer' AS kind, c_name AS name, c_custkey AS id FROM customer WHERE lower(c_name) LIKE 'customer#%1%' ORDER BY c_name, c_custkey LIMIT 50)
    UNION ALL (SELECT 'supplier', s_name, s_suppkey FROM supplier WHERE lower(s_name) LIKE 'customer#%1%' ORDER BY s_name, s_suppkey LIMIT 50)
""")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT4, SO7: the first fifty symbols of each kind that begin with a term; % is a wildcard in it."""
    both = {kind: read(spark, sf_dir, kind).select(F.col(f"{kind[0]}_name").alias("name"), F.col(f"{kind[0]}_{kind[:4]}key").alias("id")) for kind in ("customer", "supplier")}
    return lookups.search(both, "CUSTOMER#%1")


_TREE = "SELECT 'com.p.C' || c_custkey AS qualified, 'C' || c_custkey AS name, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'com.p.C' || (c_custkey // 3) WHEN 2 THEN 'C' || (c_custkey // 3) ELSE 'C' || c_custkey END AS extends, c_custkey % 5 AS n FROM customer"


@query(f"""
    WITH c AS ({_TREE}), r AS (
        SELECT qualified, 'parent' AS relation, extends AS other FROM c WHERE extends IS NOT NULL
        UNION SELECT qualified, 'interface', 'I' || i FROM c, (VALUES (0), (1)) v(i) WHERE i < n % 3
        UNION SELECT a.qualified, 'subclass', b.qualified FROM c a JOIN c b ON (b.extends = a.qualified OR b.extends = a.name) AND a.qualified <> b.qualified)
    SELECT qualified, relation, other FROM r
""")
def class_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN8, ST3: parents, interfaces and direct subclasses by full or simple name."""
    read(spark, sf_dir, "customer").createOrReplaceTempView("lookup_customer")
    rows = spark.sql(_TREE.replace("//", "DIV").replace("FROM customer", "FROM lookup_customer"))
    named = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.when(i <= F.col("n") % 3, F.concat(F.lit("I"), i - 1)))
    return lookups.relations(rows.withColumn("implements", F.array_compact(named)))


#: place, method, taxonomy, exact, prefix, leaf, arities
_ENTRIES = [
    (0, "open", "file", "com.io.File", None, None, [1]), (1, "open", "net", None, "com.net.", None, None), (2, "open", "any", None, None, "Opener", [1, 2]),
    (3, "exec", "command", None, None, None, [1, 3]), (4, "load", "web", None, None, "WebView", None), (5, "load", "lib", "com.io.File", None, None, [2]),
]
_CALL = """SELECT p_partkey AS call, CASE p_partkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'exec' WHEN 2 THEN 'load' ELSE 'other' END AS method,
    CASE p_size % 6 WHEN 0 THEN 'com.io.File' WHEN 1 THEN 'com.net.Socket' WHEN 2 THEN 'a.Opener' WHEN 3 THEN 'x.WebView' WHEN 4 THEN 'q.Other' END AS receiver, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 5 END AS arity FROM part"""
_VALUES = ", ".join(f"({p}, '{m}', '{t}', {repr(e) if e else 'NULL'}, {repr(x) if x else 'NULL'}, {repr(leaf) if leaf else 'NULL'}, {a if a else 'NULL::INTEGER[]'})" for p, m, t, e, x, leaf, a in _ENTRIES)


@query(f"""
    WITH calls AS ({_CALL}), e AS (SELECT * FROM (VALUES {_VALUES}) v(place, method, taxonomy, exact, prefix, leaf, arities)),
    j AS (SELECT call, first(taxonomy ORDER BY place) AS taxonomy, first(arities IS NULL OR arity IS NOT NULL ORDER BY place) AS confirmed FROM calls JOIN e USING (method)
          WHERE (receiver IS NULL OR (exact IS NULL AND prefix IS NULL AND leaf IS NULL) OR coalesce(receiver = exact, FALSE) OR coalesce(starts_with(receiver, prefix), FALSE) OR coalesce(split_part(receiver, '.', -1) = leaf, FALSE))
            AND (arities IS NULL OR arity IS NULL OR list_contains(arities, arity)) GROUP BY call)
    SELECT call, method, receiver, arity, taxonomy, confirmed FROM calls LEFT JOIN j USING (call)
""")
def taxonomy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC24, SC25: what kind of operation a call is, by method, receiver and number of arguments."""
    read(spark, sf_dir, "part").createOrReplaceTempView("lookup_part")
    calls = spark.sql(_CALL.replace("FROM part", "FROM lookup_part"))
    entries = spark.createDataFrame(_ENTRIES, "place int, method string, taxonomy string, exact string, prefix string, leaf string, arities array<int>")
    return lookups.taxonomy(calls.withColumn("arity", F.col("arity").cast("int")), entries)


@query("""
    WITH s AS (SELECT 'com/p' || (doc_id % 50) || CASE doc_id % 3 WHEN 0 THEN '.java' WHEN 1 THEN '/A.java' ELSE '/b/C.java' END AS path FROM documents WHERE lang IS NULL OR doc_id % 4 = 0),
    c AS (SELECT 'com.p' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '$In' ELSE '' END AS component, 'com/p' || c_custkey AS source FROM customer WHERE c_custkey % 3 > 0)
    SELECT DISTINCT component, path FROM c JOIN s ON path = source || '.java' OR starts_with(path, source || '/')
""")
def skipped_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14, ST4: exported components whose source was skipped."""
    tail = F.when(F.col("doc_id") % 3 == 0, ".java").when(F.col("doc_id") % 3 == 1, "/A.java").otherwise("/b/C.java")
    skipped = read(spark, sf_dir, "documents").where("lang is null or doc_id % 4 = 0").select(F.concat(F.lit("com/p"), F.col("doc_id") % 50, tail).alias("path"))
    key = F.col("c_custkey")
    components = read(spark, sf_dir, "customer").select(F.concat(F.lit("com.p"), key, F.when(key % 2 == 0, "$In").otherwise("")).alias("component"), F.when(key % 3 > 0, "true").otherwise("false").alias("exported"))
    return lookups.skipped_components(components, skipped)


@query("""
    SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\bthe of\\b') THEN 'critical' WHEN regexp_matches(text, '(?i)the') THEN 'high' WHEN regexp_matches(text, '(?i)sch') THEN 'medium' ELSE 'low' END AS severity FROM documents
""".replace("\\\\", "\\"))
def severity_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC22: the first of a ladder of words that a text has."""
    ladder = ((r"\bthe of\b", "critical"), ("the", "high"), ("sch", "medium"))
    return read(spark, sf_dir, "documents").select("doc_id", lookups.severity_words(F.coalesce("text", F.lit("")), ladder, "low").alias("severity"))


@query("""
    WITH e AS (SELECT l_orderkey, l_linenumber AS line, l_linenumber + l_quantity % 4 - 1 AS end_line, l_partkey % 9 AS path_no FROM lineitem), f AS (SELECT o_orderkey, o_custkey % 6 AS total, o_orderkey % 7 AS path_no FROM orders)
    SELECT l_orderkey, count(*) FILTER (f.o_orderkey IS NOT NULL AND line >= 1 AND line <= end_line AND end_line <= total) AS n_kept, count(*) FILTER (NOT coalesce(f.o_orderkey IS NOT NULL AND line >= 1 AND line <= end_line AND end_line <= total, FALSE)) AS n_dropped
    FROM e LEFT JOIN f ON l_orderkey = o_orderkey AND e.path_no = f.path_no GROUP BY 1
""")
def evidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT12, AG14: evidence whose file exists and whose lines lie in it, and how much was dropped."""
    e = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), (F.col("l_linenumber") + F.col("l_quantity") % 4 - 1).alias("end_line"), (F.col("l_partkey") % 9).alias("path_no"))
    f = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 6).alias("total"), (F.col("o_orderkey") % 7).alias("path_no"))
    return lookups.within_files(e, f, ["l_orderkey", "path_no"]).groupBy("l_orderkey").agg(F.count_if("within").alias("n_kept"), F.count_if(~F.col("within")).alias("n_dropped"))


@query("""
    WITH q AS (SELECT o_orderkey, o_orderpriority, o_totalprice, o_custkey, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS rank FROM orders)
    SELECT queue, o_orderkey, place FROM (
        SELECT 'human' AS queue, o_orderkey, row_number() OVER (ORDER BY rank DESC, o_totalprice DESC, o_custkey DESC, o_orderkey) AS place FROM q
        UNION ALL SELECT 'view', o_orderkey, row_number() OVER (ORDER BY o_orderpriority, rank, o_orderkey) FROM q
        UNION ALL SELECT 'runs', o_orderkey, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) FROM q) WHERE place <= 25
""")
def queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO3 to SO5: the heads of the queues in their orders; each a top-k, so that only these rows are numbered."""
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    rows = read(spark, sf_dir, "orders").withColumn("rank", rank)
    orders = {"human": [F.desc("rank"), F.desc("o_totalprice"), F.desc("o_custkey"), "o_orderkey"], "view": ["o_orderpriority", "rank", "o_orderkey"], "runs": [F.desc("o_custkey"), "o_orderkey"]}
    return lookups.heads(rows, "o_orderkey", orders, 25)


@query("""
    WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest, source FROM documents)
    SELECT doc_id, digest, min(doc_id) OVER (PARTITION BY digest) AS asset, 'run_' || coalesce(source, 'none') || '_' || substr(digest, 1, 12) AS scoped_id FROM a
""")
def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP52, SNK4: assets are unique by content and keep their first copy; ids carry their run."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("source").alias("run"))
    return lookups.assets(rows, "doc_id", "digest", "run").select("doc_id", "digest", "asset", "scoped_id")
