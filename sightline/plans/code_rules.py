"""Rules over source text and manifest facts. Orders are read as files, each with one of a few snippets of code; what
the rules must find in these was worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import brackets, code_rules
from ..operators.tables import read
from .base import query

#: Lines of code below a first line, and (rule, line) of the hits in them.
SNIPPETS = [
    (['web.addJavascriptInterface(new Bridge(), "bridge");'], [("WEBVIEW_JS_BRIDGE_EXPOSED", 2)]),
    (["// s.setAllowFileAccess(true);", "s.setAllowFileAccess( true );", "", "s.setAllowFileAccessFromFileURLs(true);"], [("WEBVIEW_FILE_ACCESS_ENABLED", 3), ("WEBVIEW_FILE_ACCESS_ENABLED", 5)]),
    (["/* x", "setAllowUniversalAccessFromFileURLs(true) */", "s.setAllowUniversalAccessFromFileURLs(false);"], []),
    (["s.setJavaScriptEnabled(true);", 'w.loadUrl("https://a.b"); // w.loadUrl("http://c")', 'w.loadUrl("file:///x");'], [("WEBVIEW_EXTERNAL_CONTENT", 3)]),
    (['w.loadUrl("https://a.b");'], []),
    (["void onReceivedSslError(WebView v, H h) { if (x) { h.cancel(); }", "h.proceed(); }"], [("WEBVIEW_SSL_ERROR_IGNORED", 2)]),
    (["void onReceivedSslError(WebView v, H h) { h.cancel(); }", "void f() { h.proceed(); }"], []),
    (["public void checkServerTrusted(X c) { // nothing", "}", "void checkServerTrusted(Y y) { check(y); }"], [("TRUST_MANAGER_ALL_ACCEPT", 2)]),
    (["boolean verify(String h, S s) { return true; }"], [("HOSTNAME_VERIFIER_ALWAYS_TRUE", 2)]),
    (['Cipher.getInstance("AES/ECB/PKCS5Padding");', 'Cipher.getInstance("DES");', 'Cipher.getInstance("AES");', 'Cipher.getInstance("AES/GCM/NoPadding");'], [("WEAK_CIPHER_ECB", 2), ("WEAK_CIPHER_ECB", 4), ("WEAK_CIPHER_ALGORITHM", 3)]),
    (['MessageDigest.getInstance("SHA-1");', '// MessageDigest.getInstance("MD5");', 'MessageDigest.getInstance("SHA-256");'], [("WEAK_CIPHER_ALGORITHM", 2)]),
    (["PendingIntent.getActivity(c, f(0), i, PendingIntent.FLAG_IMMUTABLE);", "PendingIntent.getService(c, 0, i,", "  g(0));"], [("PENDING_INTENT_MUTABLE", 3)]),
    (['Log.d(TAG, "t" + token);', 'Log.i(TAG, "password");', 'Log.wtf(TAG, f(userPassword(x)));'], [("LOG_SENSITIVE_DATA", 2), ("LOG_SENSITIVE_DATA", 4)]),
    (['static final String API_KEY = "0123456789abcdef";', 'String token = "short";', '// String secret = "0123456789";'], [("HARDCODED_SECRET", 2)]),
    (["int x = 1;"], []),
    (['String passwrd = "0123456789";', 'private static final', '  String AccessKey = "01234567" + x;'], [("HARDCODED_SECRET", 3)]),
    (["void onReceivedSslError(WebView v, H h) { if (a) { if (b) { if (c) { if (d) { h.cancel(); } } } }", "h.proceed(); }", "void onReceivedSslError(WebView v, H h) {", "{ { { { h . proceed (); } } } } }"], [("WEBVIEW_SSL_ERROR_IGNORED", 2), ("WEBVIEW_SSL_ERROR_IGNORED", 4)]),
    (["PendingIntent.getActivity(c, f(g(h(k(1)))), i, 0);", "PendingIntent.getActivity(c, f(g(h(k(1)))), i, FLAG_IMMUTABLE);", "PendingIntent.getActivity(c, 0, i, EXTRA_FLAG_IMMUTABLE_STATE);"], [("PENDING_INTENT_MUTABLE", 2), ("PENDING_INTENT_MUTABLE", 4)]),
    (["Log.w(TAG, paymentInfo);", "Log.e(TAG, latitude);", "Log . i(TAG, f(g(h(k(userId)))));"], [("LOG_SENSITIVE_DATA", 2), ("LOG_SENSITIVE_DATA", 4)]),
    (['String s = """', 'Log.d(TAG, token); " unpaired', '""";', "Log.d(TAG, deviceId);"], [("LOG_SENSITIVE_DATA", 5)]),
    (["boolean verify(String h, S s) { if (x) { return true; } return false; }", "boolean verify(String h, S s) { return Boolean.TRUE; }"], [("HOSTNAME_VERIFIER_ALWAYS_TRUE", 3)]),
    (["void checkServerTrusted(X c) { return ; }", "void checkServerTrusted(X c) { if (a) { } }"], [("TRUST_MANAGER_ALL_ACCEPT", 2)]),
]
_N = len(SNIPPETS)
_CODE = f"'class A {{' || chr(10) || CASE o_orderkey % {_N} " + " ".join(f"WHEN {i} THEN " + " || chr(10) || ".join(f"'{line}'" for line in lines) for i, (lines, _) in enumerate(SNIPPETS)) + " END || chr(10) || '}'"
_WANT = ", ".join(f"({i}, '{rule}', {line})" for i, (_, found) in enumerate(SNIPPETS) for rule, line in found)


@query(f"SELECT o_orderkey, rule_id, line::BIGINT AS line FROM orders JOIN (VALUES {_WANT}) h(i, rule_id, line) ON o_orderkey % {_N} = i")
def code_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RU6 to RU10, SC1, SC4: every hit of the code rules outside comments, with its line."""
    return code_rules.hits(read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_CODE).alias("code")))


_DEPTH = "o_orderkey % 21"
_NESTED = f"""concat('void m() {{', chr(10), array_join(transform(sequence(0, CAST({_DEPTH} AS INT)), k -> concat('o', k, '.call', k, '(",(", ')), ''), 'z', repeat(')', CAST({_DEPTH} AS INT) + 1), ';', chr(10), '}}')"""


@query(f"""
    SELECT o_orderkey, 'm' AS name, '' AS owner, 1::BIGINT AS line, 1::BIGINT AS level, 1 AS n_arguments, '' AS first_argument FROM orders
    UNION ALL SELECT o_orderkey, 'call' || k, 'o' || k, 2, 1 + k, 2, '",("' FROM orders, generate_series(0, {_DEPTH}) g(k)
""")
def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC2, SC3, SC9: call sites with their arguments, brackets being matched at any depth."""
    found = brackets.call_sites(read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_NESTED).alias("code")))
    return found.select("file.o_orderkey", "name", "owner", "line", F.col("level").cast("long").alias("level"), F.size("arguments").alias("n_arguments"), F.get("arguments", F.lit(0)).alias("first_argument"))


_FACTS = "CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'unknown' END AS allow_backup, CASE o_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'unknown' END AS cleartext"
_APP = f"o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'true' WHEN o_orderkey % 9 = 1 THEN NULL ELSE 'false' END AS debuggable, {_FACTS}, CASE WHEN o_custkey % 8 = 0 THEN NULL ELSE 18 + o_orderkey % 17 END AS target_sdk, o_custkey % 3 = 0 AS has_backup_rules, o_custkey % 5 = 0 AS has_network_config"


@query(f"""
    WITH a AS (SELECT {_APP} FROM orders)
    SELECT o_orderkey, 'DEBUGGABLE_IN_PRODUCTION' AS rule_id, 'high' AS severity_hint FROM a WHERE debuggable = 'true'
    UNION ALL SELECT o_orderkey, 'ALLOW_BACKUP_ENABLED', CASE WHEN allow_backup = 'true' AND NOT has_backup_rules THEN NULL ELSE 'low' END FROM a WHERE target_sdk >= 23 AND coalesce(allow_backup, 'unknown') <> 'false'
    UNION ALL SELECT o_orderkey, 'CLEARTEXT_TRAFFIC_ALLOWED', CASE WHEN has_network_config THEN 'low' END FROM a WHERE target_sdk >= 28 AND cleartext = 'true'
    UNION ALL SELECT o_orderkey, 'CLEARTEXT_TRAFFIC_ALLOWED', 'low' FROM a WHERE target_sdk < 28 AND (coalesce(cleartext, '') <> 'false' OR has_network_config)
""")
def manifest_fact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RU5: rules on the facts of a manifest alone."""
    apps = read(spark, sf_dir, "orders").selectExpr(*[f"{x}" for x in _split(_APP)])
    return code_rules.manifest_facts(apps).select("o_orderkey", "rule_id", "severity_hint")


def _split(fields: str) -> list[str]:
    """The select list cut at the commas after each alias."""
    out, held = [], ""
    for part in fields.split(", "):
        held = f"{held}, {part}" if held else part
        if " AS " in held or held == "o_orderkey":
            out.append(held)
            held = ""
    return out


_KIND = "CASE o_custkey % 4 WHEN 0 THEN 'activity' WHEN 1 THEN 'service' WHEN 2 THEN 'receiver' ELSE 'provider' END"
_LINES = ["class A extends IFoo.Stub {", "void delete(Uri u) {}", "IBinder onBind(Intent i)", "startForeground(1, n)", "MatrixCursor c", "WebView w", "int x"]
_LINE = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_LINES)) + " END"
_RULE = "CASE WHEN o_orderkey % 2 = 0 THEN 'SERVICE_EXPORTED_NO_PERMISSION' ELSE 'OTHER' END"


@query(f"""
    WITH c AS (SELECT o_orderkey, {_KIND} AS kind, o_orderkey % 7 AS i, o_orderkey % 2 = 0 AS exposed FROM orders)
    SELECT o_orderkey, CASE WHEN i = 0 THEN 100 WHEN i = 1 AND kind = 'provider' THEN 95 WHEN i = 2 AND kind = 'service' THEN 90 WHEN i = 3 AND kind = 'service' THEN 85 WHEN i = 4 AND kind = 'provider' THEN 75
           WHEN i = 5 AND kind = 'activity' THEN 70 WHEN exposed THEN 40 ELSE 50 END AS priority FROM c
""")
def review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RU20: how early a person should look at a candidate."""
    return read(spark, sf_dir, "orders").select("o_orderkey", code_rules.priority(F.expr(_RULE), F.expr(_KIND), F.expr(_LINE)).alias("priority"))


_NAMES = ["com.a.LoginActivity", "com.a.KeyEventView", "com.a.AuthorList", "com.a.reset_page", "com.a.HTTPTokenStore", "com.a.RepayView", "com.pay.Main", None]
_SENSITIVE = (0, 3, 4, 6)


@query(f"SELECT o_orderkey, o_orderkey % 8 IN {_SENSITIVE} AND o_orderkey % 8 <> 7 AS sensitive FROM orders WHERE o_orderkey % 8 <> 7")
def sensitive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RU3, SC30: activities whose names have a sensitive word as a whole word of camel case."""
    name = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_NAMES) if v) + " END"
    found = read(spark, sf_dir, "orders").select("o_orderkey", code_rules.sensitive_name(F.expr(name)).alias("sensitive"))
    return found.where("sensitive is not null")


_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'unprotected' WHEN 1 THEN 'conditional' WHEN 2 THEN 'strongly_protected' WHEN 3 THEN 'unknown' ELSE 'protected' END"


@query(f"""
    WITH c AS (SELECT o_orderkey, {_KIND} AS kind, CASE o_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'conditional' END AS exported, {_STATUS} AS auth, o_orderkey % 7 = 0 AS only_protected FROM orders)
    SELECT o_orderkey, CASE WHEN kind = 'provider' THEN 'PROVIDER_READ_WRITE_PERMISSION_MISSING' ELSE upper(kind) || '_EXPORTED_NO_PERMISSION' END AS rule_id FROM c
    WHERE exported = 'true' AND CASE WHEN kind = 'provider' THEN auth <> 'strongly_protected' ELSE auth = 'unprotected' AND NOT (kind = 'receiver' AND only_protected) END
""")
def exposed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RU1, RU2: components that others reach without a permission; receivers of protected broadcasts alone are left out."""
    stated = F.when(F.col("o_custkey") % 3 == 0, "true").when(F.col("o_custkey") % 3 == 1, "false").otherwise("conditional")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", code_rules.exposed(F.expr(_KIND), stated, F.expr(_STATUS), F.col("o_orderkey") % 7 == 0).alias("rule_id"))
    return rows.where("rule_id is not null")
