"""The corpus operators over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, conversations, exact_dedup, html_text, importance, language_id, line_dedup, mixing, near_dedup, order_minhash, personal_data, shared, token_files, vector_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled rows that are not held out."""
    return language_id.learn_and_predict(_documents(spark, sf_dir))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract(pages)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the bytes that they decode to."""
    return byte_bpe.digest_round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the row with the largest doc_id stays."""
    return exact_dedup.exact_groups(_documents(spark, sf_dir), keep="largest").withColumnRenamed("digest", "text_sha256")


#: Every document at least once, small sources up to twice.
MIX = mixing.Target(repetition=2.0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row handed out, with its epoch, block and keys."""
    docs = _documents(spark, sf_dir)
    counted = docs.select("doc_id", "source", mixing.word_count(shared.text_of()).alias("n_tokens"))
    return mixing.realise(counted, mixing.plan(docs, MIX), MIX)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return order_minhash.compare_with_next(_documents(spark, sf_dir))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document: those of the patterns, and those that the field adds."""
    return personal_data.find(_documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents with its group of near lines, and whether it stays."""
    return line_dedup.decide(_documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets, counts and checksums of every document, read back from the token files."""
    return token_files.round_trip(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share most of their shingles; the smallest doc_id stays."""
    return near_dedup.near_groups(_documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations with their faults, the cheapest edits and the digest of what is left."""
    return conversations.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their weights towards the benchmark, and the ranks of the tenth that is drawn."""
    return importance.importance(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the number of their near ones of the same label, and their groups."""
    return vector_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_html_text": op2_html_text,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_order_minhash": op6_order_minhash,
    "op7_personal_data": op7_personal_data,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_files": op9_token_files,
    "op10_near_dedup": op10_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_importance": op12_importance,
    "op13_vector_dedup": op13_vector_dedup,
}

#: The checksum of bytes in SQL: a table of 256 entries by rule, and a step for each byte.
_CRC = """
    crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS tab FROM range(256) t(i))"""
_CRC_OF = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, tab[1 + xor(c & 255, b)])), 4294967295)"

ORACLE_SQL = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    # The exponent in closed form: the smallest source is passed over twice when the largest is passed over once.
    "op5_mixing": """
        WITH d AS (
            SELECT doc_id, source, coalesce(source, '') AS s, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS doc_key,
                   len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'))::BIGINT AS n_tokens
            FROM documents),
        sizes AS (SELECT s, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY s),
        most AS (SELECT max(tokens) AS m, min(tokens) FILTER (tokens > 0) AS l FROM sizes),
        a AS (SELECT m, CASE WHEN l = m THEN 0 ELSE greatest(0, 1 + ln(2.0) / ln(l / m)) END AS alpha FROM most),
        q AS (SELECT s, tokens, greatest(1, ceil(tokens / 65536.0))::BIGINT AS n_blocks,
                     round(CASE WHEN tokens > 0 THEN m * pow(tokens / m, alpha) ELSE 0 END)::BIGINT AS quota FROM sizes, a),
        f AS (SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS full_epochs FROM q),
        r AS (
            SELECT d.*, ('0x' || substr(doc_key, 1, 8))::BIGINT % n_blocks AS block, epoch, full_epochs,
                   quota - full_epochs * tokens AS rest
            FROM d JOIN f USING (s), generate_series(0, 1000) AS g(epoch) WHERE epoch <= full_epochs),
        k AS (SELECT *, md5('mix:' || epoch || ':' || s || ':' || block) AS block_key FROM r),
        w AS (SELECT *, sum(n_tokens) OVER (PARTITION BY s, epoch ORDER BY block_key, doc_key) - n_tokens AS before FROM k)
        SELECT doc_id, source, n_tokens, epoch::INTEGER AS epoch, block, block_key, doc_key
        FROM w WHERE epoch < full_epochs OR before < rest
    """,
    "op11_conversation_repair": f"""
        WITH RECURSIVE {_CRC},
        c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {_CRC_OF.format(bytes="list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)")} % 20 AS how
            FROM conversations, crc),
        d AS (
            SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
                   CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM c, generate_series(1, CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) WHERE how > 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM d),
        f AS (
            SELECT conv_id, turn, role, text, k, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS said,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair
            FROM o),
        g AS (
            SELECT *, CASE WHEN t = '' THEN 'blank' WHEN said > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM f),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
            FROM g GROUP BY conv_id),
        inserts(a, b, cost, audit, lines) AS (VALUES
            (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
            (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:'])),
        moves(a, initial, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        edits AS (
            SELECT conv_id, k, a, b, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cost, 'K' AS audit, [role || ':' || text] AS lines
            FROM g JOIN moves USING (initial) WHERE fault IN ('', 'truncated')
            UNION ALL
            SELECT conv_id, k, a, b, CASE WHEN fault = 'truncated' THEN 3 ELSE 2 END, 'R', [CASE moves.initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
            FROM g, moves WHERE fault IN ('', 'truncated') AND moves.initial <> 's'
            UNION ALL
            SELECT conv_id, k, a, a, 3, 'D', [] FROM g, range(4) s(a)),
        turns AS (
            SELECT conv_id, k, i.a, e.b, min({{'cost': i.cost + e.cost, 'audit': i.audit || e.audit, 'lines': i.lines || e.lines}}) AS x
            FROM inserts i JOIN edits e ON i.b = e.a GROUP BY conv_id, k, i.a, e.b),
        walk AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS state, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS x FROM conversations
            UNION ALL
            SELECT w.conv_id, t.k, t.b, min({{'cost': w.x.cost + t.x.cost, 'audit': w.x.audit || t.x.audit, 'lines': w.x.lines || t.x.lines}})
            FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.k = w.k + 1 AND t.a = w.state GROUP BY w.conv_id, t.k, t.b),
        ended AS (
            SELECT w.conv_id, min({{'cost': w.x.cost + i.cost, 'audit': w.x.audit || i.audit, 'lines': w.x.lines || i.lines}}) AS x
            FROM walk w JOIN inserts i ON i.a = w.state AND i.b IN (0, 3) LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM w.conv_id
            WHERE w.k = coalesce(counts.n, 0) GROUP BY w.conv_id)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, x.cost::BIGINT AS cost, x.audit AS audit, sha256(array_to_string(x.lines, chr(10))) AS repaired_sha256
        FROM ended e LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
    "op12_importance": f"""
        WITH {_CRC},
        w AS (
            SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents
            UNION ALL
            SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
        distinct_words AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM w),
        hashed AS (
            SELECT word, {_CRC_OF.format(bytes="list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)")} % 10000 AS bucket
            FROM distinct_words, crc),
        counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM w JOIN hashed USING (word) GROUP BY bucket),
        gains AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
        sums AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS whole FROM w JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
        weighed AS (
            SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (whole - ((whole % n) + n) % n) // n ELSE 0 END AS weight,
                   ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h
            FROM documents d LEFT JOIN sums USING (doc_id)),
        scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                   count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed
    """,
    "op13_vector_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        u AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v WHERE list_dot_product(e, e) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
        reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
        SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
               vec_id <= coalesce(b, vec_id) AS kept
        FROM embeddings LEFT JOIN least ON a = vec_id
    """,
}
