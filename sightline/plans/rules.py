"""Text rules, token search, scalar functions and identity over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text_rules
from ..operators.tables import read
from ..operators.windows import running_total
from .base import query

#: Patterns that Java's and RE2's dialects read alike.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "licence_line": r"(?i)licen[cs]e",
    "assigned_secret": r"(?i)(token|secret|password|api_key|key)\s*[=:]\s*['\"][^'\"]{8,}['\"]",
    "private_address": r"\b(10\.[0-9]+|192\.168)\.[0-9]+\.[0-9]+\b",
}
TERMS = ["license", "licence", "copyright", "token", "password"]

_hits_sql = " UNION ALL ".join(f"SELECT *, '{rule}' AS rule_id FROM l WHERE regexp_matches(line, '{pattern.replace(chr(39), chr(39) * 2)}')" for rule, pattern in RULES.items())
_lines_sql = """l AS (SELECT doc_id, lang, i::BIGINT AS line_no, s[i] AS line FROM
    (SELECT *, string_split(text, chr(10)) AS s FROM {source}), unnest(range(1, len(s) + 1)) AS r(i))"""


@query(f"""
    WITH d AS (SELECT doc_id, lang, text FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY sha256(text))),
    {_lines_sql.format(source="d")}, h AS ({_hits_sql})
    SELECT rule_id, lang, count(*) AS n_hits, count(DISTINCT doc_id) AS n_documents FROM h GROUP BY ALL
""")
def rule_scan_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_rules.first_of_equal(read(spark, sf_dir, "documents"), F.sha2("text", 256), "doc_id").select("doc_id", "lang", "text")
    return text_rules.hits(docs, RULES).groupBy("rule_id", "lang").agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct("doc_id").alias("n_documents"))


@query(f"WITH {_lines_sql.format(source='documents')}, h AS ({_hits_sql}) SELECT doc_id, rule_id, line_no FROM h")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_rules.hits(read(spark, sf_dir, "documents").select("doc_id", "text"), RULES).select("doc_id", "rule_id", "line_no")


@query(f"SELECT doc_id FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '[a-z0-9_$]+'), {TERMS})")
def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(text_rules.has_token(F.col("text"), TERMS)).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\b(license|licensed|copyright)\b')")
def word_boundary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(text_rules.has_word(F.col("text"), ["license", "licensed", "copyright"])).select("doc_id")


@query("""
    SELECT doc_id, greatest(1, ceil(octet_length(encode(text)) / 4.0))::BIGINT AS n_tokens,
           len(string_split(text, chr(10)))::BIGINT AS n_lines, sha256(text) AS content_id
    FROM documents
""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.split("text", "\n", -1)).cast("long")
    tokens = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / 4)).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", tokens.alias("n_tokens"), lines.alias("n_lines"), F.sha2("text", 256).alias("content_id"))


@query(r"""
    WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '//([^/?#]+)', 1), '[^A-Za-z0-9]+', '_', 'g') AS base FROM pages),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS k FROM p)
    SELECT page_id, base || CASE WHEN k > 1 THEN '__' || k ELSE '' END AS entry_id FROM n
""")
def entry_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made of hosts; repeated ones get __2, __3 in page order."""
    base = F.regexp_replace(F.regexp_extract("url", "//([^/?#]+)", 1), "[^A-Za-z0-9]+", "_")
    rows = read(spark, sf_dir, "pages").select("page_id", base.alias("base"))
    return running_total(rows, ["base"], ["page_id"], F.lit(1), "k").select("page_id", F.concat("base", F.when(F.col("k") > 1, F.concat(F.lit("__"), "k")).otherwise("")).alias("entry_id"))


@query(r"""
    WITH h AS (SELECT regexp_extract(url, '//([^/?#]+)', 1) AS authority, page_id, regexp_extract(html, '<title>([^<]*)', 1) AS owner FROM pages)
    SELECT authority, count(*) AS n_pages, count(DISTINCT owner) AS n_owners, min(owner) AS first_owner FROM h GROUP BY authority HAVING count(DISTINCT owner) > 1
""")
def authority_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/?#]+)", 1).alias("authority"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("owner"))
    found = held.groupBy("authority").agg(F.count(F.lit(1)).alias("n_pages"), F.count_distinct("owner").alias("n_owners"), F.min("owner").alias("first_owner"))
    return found.where("n_owners > 1")


@query(r"""
    WITH s AS (SELECT regexp_extract(url, '//(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+)(?:[/?#]|$)', 1) AS package, min(page_id) AS first_page, count(*) AS n FROM pages GROUP BY 1)
    SELECT package, n FROM s ORDER BY n DESC, first_page LIMIT 1
""")
def dominant_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    package = F.regexp_extract("url", r"//(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+)(?:[/?#]|$)", 1).alias("package")
    found = read(spark, sf_dir, "pages").groupBy(package).agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), "first_page").limit(1).select("package", "n")


@query("""
    SELECT sha256(coalesce(text, '')) AS identity, min(doc_id) AS representative, count(*) AS n_members, count(DISTINCT source) AS n_sources
    FROM documents GROUP BY 1
""")
def identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("identity"), "doc_id", "source")
    return docs.groupBy("identity").agg(F.min("doc_id").alias("representative"), F.count(F.lit(1)).alias("n_members"), F.count_distinct("source").alias("n_sources"))
