"""Code rules and brackets on texts worked out by hand: long, deep, null, repeated, with clashing columns."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import brackets, code_rules


def hits(spark, *texts):
    files = spark.createDataFrame(list(enumerate(texts)), "i int, code string")
    return sorted(tuple(r) for r in code_rules.hits(files).collect())


def test_long_bodies_literals_calls_and_files(spark):
    pad = "x = y + 1; " * 100_000  # over 1 MB
    literal = '"' + "A" * 100_000 + '"'
    assert hits(
        spark,
        f"void onReceivedSslError(V v, H h) {{ {pad} h.proceed(); }}",
        f"String cert = {literal};\nLog.d(TAG, token);",
        "Log.d(TAG, " + "a + " * 50_000 + "token);",
        f'String secretKey = {literal};',
        "/* " + "c" * 1_000_000 + " */ s.setAllowFileAccess(true);",
    ) == [(0, "WEBVIEW_SSL_ERROR_IGNORED", 1), (1, "LOG_SENSITIVE_DATA", 2), (2, "LOG_SENSITIVE_DATA", 1), (3, "HARDCODED_SECRET", 1), (4, "WEBVIEW_FILE_ACCESS_ENABLED", 1)]


@pytest.mark.parametrize("depth", [1, 4, 20, 200])
def test_any_depth(spark, depth):
    deep = "f(" * depth + "1" + ")" * depth
    ifs = "if (a) { " * depth + "h.cancel(); " + "} " * depth
    assert hits(
        spark,
        f"PendingIntent.getActivity(c, {deep}, i, 0);\nPendingIntent.getActivity(c, {deep}, i, PendingIntent.FLAG_IMMUTABLE);",
        f"void onReceivedSslError(V v, H h) {{ {ifs} h.proceed(); }}\nvoid onReceivedSslError(V v, H h) {{ {ifs} }}",
    ) == [(0, "PENDING_INTENT_MUTABLE", 1), (1, "WEBVIEW_SSL_ERROR_IGNORED", 1)]


def test_texts_that_do_not_close(spark):
    assert hits(spark, "Log.d(TAG, token", ") } ) Log.d(TAG, token); {", 'String s = "Log.d(TAG, token);', "/* Log.d(TAG, token);", "", None, "\\") == [(1, "LOG_SENSITIVE_DATA", 1)]


def test_columns_rows_and_empty_tables(spark):
    rows = [(1, 2, "p", "Log.d(TAG, token);"), (1, 2, "p", "Log.d(TAG, token);"), (None, None, None, None)]
    files = spark.createDataFrame(rows, "line int, rule_id int, `a.b` string, code string")
    out = code_rules.hits(files)
    assert out.columns == ["line", "rule_id", "a.b", "_rule_id", "_line"]
    assert [tuple(r) for r in out.collect()] == [(1, 2, "p", "LOG_SENSITIVE_DATA", 1)] * 2
    assert code_rules.hits(files.limit(0)).count() == 0


def test_masks_keep_length_and_lines(spark):
    code = 'a = "x\\"y"; // "z\n/* b\n*/ c = \'"\'; d = """\n"e" // f\n"""; g'
    bare, text = spark.range(1).select(brackets.masked(F.lit(code)), brackets.masked(F.lit(code), False)).first()
    assert len(bare) == len(text) == len(code) and bare.count("\n") == code.count("\n")
    assert bare.split() == ["a", "=", ";", "c", "=", ";", "d", "=", ";", "g"]
    assert text.split() == ["a", "=", '"x\\"y";', "c", "=", "'\"';", "d", "=", '"""', '"e"', "//", "f", '""";', "g"]


def test_arguments_by_hand(spark):
    code = 'x = a.b(c(1, 2), "p,q(", new D() { void m(int i, int j) { n(); } }).e();'
    files = spark.createDataFrame([(7, code)], "i int, code string")
    got = sorted((r["name"], r["owner"], r["level"], tuple(r["arguments"])) for r in brackets.call_sites(files).collect())
    assert got == [
        ("D", "", 2, ("",)), ("b", "a", 1, ("c(1, 2)", '"p,q("', "new D() { void m(int i, int j) { n(); } }")), ("c", "", 2, ("1", "2")),
        ("e", "", 1, ("",)), ("m", "", 2, ("int i", "int j")), ("n", "", 2, ("",)),
    ]


def test_priority_takes_the_first_that_holds(spark):
    rows = [("service", "class A extends IFoo.Stub { onBind(x) }"), ("service", "void onBind (Intent i)"), ("service", "accountName"), ("provider", "query(uri)"), ("provider", "queryAll"), ("activity", "WebView"), (None, None)]
    got = spark.createDataFrame(rows, "kind string, code string").select(code_rules.priority(F.lit("X_EXPORTED_NO_PERMISSION"), F.col("kind"), F.col("code"))).collect()
    assert [r[0] for r in got] == [100, 90, 85, 75, 40, 70, 40]


def test_words_of_names(spark):
    names = ["LoginActivity", "KeyEventView", "AuthorList", "HTTPTokenStore", "reset_page2Go", "a.B__c", ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(code_rules.name_tokens(F.col("n"))).collect()]
    assert got == [["login", "activity"], ["key", "event", "view"], ["author", "list"], ["http", "token", "store"], ["reset", "page2", "go"], ["a", "b", "c"], []]
