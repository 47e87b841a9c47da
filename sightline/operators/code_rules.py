"""Rules over source text and manifest facts. Rules are rows of a table, matched with the call sites of the texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import brackets
from .tables import join_spread, unused, written


@dataclass(frozen=True)
class Rule:
    """A call of one of the methods (of owner, if given; in any case with any_case) that passes all the tests given.

    first or second: words with which that argument, a literal, begins (whole: that it is, as the only argument; "": any
    literal). only: what the only argument is. lacks: a word that no argument may hold. parts: one of these stands
    somewhere in the arguments, outside strings. body: a name of BODIES, for headers of methods. beside: (method,
    argument) of a call elsewhere in the text.
    """

    methods: tuple[str, ...]
    owner: str = ""
    any_case: bool = False
    first: tuple[str, ...] = ()
    second: tuple[str, ...] = ()
    whole: tuple[str, ...] = ()
    only: str = ""
    lacks: str = ""
    parts: tuple[str, ...] = ()
    body: str = ""
    beside: tuple[str, str] | None = None


#: Names of the platform, of weak algorithms, and words for personal or secret data.
SENSITIVE_DATA = ("token", "password", "passwd", "secret", "credential", "account", "payment", "location", "contact", "private", "auth", "device", "battery", "userid")
SECRET_NAMES = ("secret", "api_key", "apikey", "access_key", "accesskey", "private_key", "privatekey", "token", "password", "passwd")
LEAST_SECRET = 8
RULES = [
    ("WEBVIEW_JS_BRIDGE_EXPOSED", Rule(("addJavascriptInterface",), second=("",))),
    ("WEBVIEW_FILE_ACCESS_ENABLED", Rule(("setAllowFileAccess", "setAllowFileAccessFromFileURLs"), only="true")),
    ("WEBVIEW_UNIVERSAL_ACCESS_FROM_FILE", Rule(("setAllowUniversalAccessFromFileURLs",), only="true")),
    ("WEBVIEW_SSL_ERROR_IGNORED", Rule(("onReceivedSslError",), any_case=True, body="proceeds")),
    ("WEBVIEW_EXTERNAL_CONTENT", Rule(("loadUrl",), first=("http://", "https://"), beside=("setJavaScriptEnabled", "true"))),
    ("TRUST_MANAGER_ALL_ACCEPT", Rule(("checkServerTrusted",), any_case=True, body="empty")),
    ("HOSTNAME_VERIFIER_ALWAYS_TRUE", Rule(("verify",), any_case=True, body="true")),
    ("WEAK_CIPHER_ECB", Rule(("getInstance",), owner="Cipher", any_case=True, first=("AES/ECB/",))),
    ("WEAK_CIPHER_ECB", Rule(("getInstance",), owner="Cipher", any_case=True, whole=("AES",))),
    ("WEAK_CIPHER_ALGORITHM", Rule(("getInstance",), owner="Cipher", any_case=True, first=("DES", "DESede", "3DES", "RC4"))),
    ("WEAK_CIPHER_ALGORITHM", Rule(("getInstance",), owner="MessageDigest", any_case=True, whole=("MD5", "SHA1", "SHA-1"))),
    ("PENDING_INTENT_MUTABLE", Rule(("getActivity", "getActivities", "getBroadcast", "getService", "getForegroundService"), owner="PendingIntent", lacks="FLAG_IMMUTABLE")),
    ("LOG_SENSITIVE_DATA", Rule(("d", "e", "i", "v", "w", "wtf"), owner="Log", parts=SENSITIVE_DATA)),
]
#: What the body of a method is, without blanks, or has in it.
BODIES = {
    "empty": lambda body: body.isin("", "return;"),
    "true": lambda body: F.lower(body).isin(*[f"return{value}{end}" for value in ("true", "(true)", "boolean.true", "(boolean.true)") for end in ("", ";")]),
    "proceeds": lambda body: body.rlike(r"\w\.proceed\("),
}
_WANTED = "(?i)" + "|".join(sorted({m for _, r in RULES for m in r.methods if len(m) > 3} | {"Log", *SECRET_NAMES}))


def _matches(rule: Rule) -> Column:
    """Whether a call passes: name, owner, literals (the quoted argument texts), bare (their texts without strings), body."""
    same = lambda c, values: F.lower(c).isin(*[v.lower() for v in values]) if rule.any_case else F.col(c).isin(*values)
    cased = lambda c: F.lower(c) if rule.any_case else c
    word = lambda v: v.lower() if rule.any_case else v
    out = same("name", rule.methods)
    if rule.owner:
        out &= same("owner", (rule.owner,))
    begins = lambda n, values: F.coalesce(F.get("quoted", F.lit(n)).rlike("^[\"'].") & F.exists(F.array(*[F.lit(word(v)) for v in values]), lambda v: F.substring(cased(F.get("quoted", F.lit(n))), 2, 99).startswith(v)), F.lit(False))
    if rule.first:
        out &= begins(0, rule.first)
    if rule.second:
        out &= begins(1, rule.second)
    if rule.whole:
        out &= (F.size("quoted") == 1) & cased(F.get("quoted", F.lit(0))).isin(*[q + word(v) + q for v in rule.whole for q in "\"'"])
    if rule.only:
        out &= (F.size("quoted") == 1) & (F.get("quoted", F.lit(0)) == rule.only)
    if rule.lacks:
        out &= ~F.array_contains(F.split("plain", r"\W+"), rule.lacks)
    if rule.parts:
        out &= F.exists(F.array(*map(F.lit, rule.parts)), lambda v: F.contains(F.lower("plain"), v))
    if rule.body:
        out &= F.coalesce(BODIES[rule.body](F.col("inner")), F.lit(False))
    return out


def _call_hits(texts: DataFrame, cut: DataFrame, rules: list[tuple[str, Rule]]) -> DataFrame:
    methods = sorted({m.lower() for _, r in rules for m in r.methods} | {r.beside[0].lower() for _, r in rules if r.beside})
    sites = brackets.calls(cut).where(F.lower("name").isin(*methods))
    sites = sites.join(brackets.blocks(cut), ["digest", "body"], "left")
    listed = sites.groupBy("digest").agg(F.collect_list(F.struct("name", "owner", "line", "begin", "end", "arguments", "body", "body_end")).alias("sites"))
    read = texts.join(listed, "digest").select("digest", "text", "bare", F.explode("sites").alias("s"))
    quoted = F.transform("s.arguments", lambda a: F.trim(F.regexp_replace(brackets.between("text", a["begin"], a["end"]), r"^\s++|\s++\z", "")))
    inner = F.regexp_replace(brackets.between("bare", F.col("s.body"), F.col("s.body_end")), r"\breturn\b\s*+", "return")
    read = read.select("digest", "s.name", "s.owner", "s.line", quoted.alias("quoted"), brackets.between("bare", F.col("s.begin"), F.col("s.end")).alias("plain"), F.regexp_replace(inner, r"\s++", "").alias("inner"))
    each = [F.when(_matches(r), F.struct(F.lit(name).alias("rule_id"), F.lit(r.beside[0] if r.beside else None).cast("string").alias("beside"), F.lit(r.beside[1] if r.beside else None).cast("string").alias("value"))) for name, r in rules]
    found = read.select("digest", "line", F.explode(F.filter(F.array(*each), lambda h: h.isNotNull())).alias("h")).select("digest", "line", "h.*")
    alone = found.where("beside is null")
    if not any(r.beside for _, r in rules):
        return alone.select("digest", "rule_id", "line")
    there = read.where(F.size("quoted") == 1).select("digest", F.col("name").alias("beside"), F.get("quoted", F.lit(0)).alias("value")).distinct()
    return alone.unionByName(found.join(there, ["digest", "beside", "value"], "left_semi")).select("digest", "rule_id", "line")


def _secret_hits(texts: DataFrame, cut: DataFrame) -> DataFrame:
    """String fields named like secrets, with a literal of LEAST_SECRET characters or more."""
    field = r"(?i)(?:(?:static|final)\s++)*+(?:java\.lang\.)?String\s++(\w++)\s*+="
    whole = F.regexp_extract("head", field, 0)
    named = cut.where(F.col("head").rlike(field)).withColumns({"whole": whole, "name": F.lower(F.regexp_extract("head", field, 1))})
    named = named.where(F.exists(F.array(*map(F.lit, SECRET_NAMES)), lambda v: F.contains("name", v))).withColumn("place", F.expr("instr(head, whole) - 1"))
    breaks = F.regexp_count(F.expr("left(head, place)"), F.lit("\n"))
    named = named.select("digest", (F.col("line") + breaks).cast("long").alias("line"), (F.col("begin") + F.col("place") + F.length("whole")).alias("from"), F.col("end").alias("to"))
    listed = named.groupBy("digest").agg(F.collect_list(F.struct("line", "from", "to")).alias("fields"))
    read = texts.join(listed, "digest").select("digest", "text", F.explode("fields").alias("f"))
    return read.where(brackets.between("text", F.col("f.from"), F.col("f.to")).rlike(rf'^\s*+"[^"\n]{{{LEAST_SECRET},}}+"')).select("digest", F.lit("HARDCODED_SECRET").alias("rule_id"), "f.line")


def hits(files: DataFrame, code: str = "code", rules: list[tuple[str, Rule]] = RULES) -> DataFrame:
    """The other columns of files with rule_id and line for every hit outside comments.

    Calls and bodies are read whole, at any depth and of any length. Null and empty texts have no hits; repeated rows
    each have theirs; an empty table gives no rows. Columns named rule_id or line, and names with dots, stay: the new
    columns then have underscores before their names. Texts without any name of the rules are not cut.
    """
    names = [c for c in files.columns if c != code]
    rule_name, line_name = unused(names, "rule_id", "line")
    keyed = files.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("file"), F.col(f"`{code}`").alias("code"))
    keyed = keyed.where(F.col("code").rlike(_WANTED) if rules is RULES else F.col("code").isNotNull())
    texts = written(brackets.contents(keyed))
    cut = brackets.pieces(texts)
    found = _call_hits(texts, cut, rules)
    if rules is RULES:
        found = found.unionByName(_secret_hits(texts, cut))
    found = written(found.groupBy("digest").agg(F.collect_list(F.struct("rule_id", "line")).alias("hits")))
    each = join_spread(keyed.select("file", F.sha2("code", 256).alias("digest")), found, "digest").select("file", F.explode("hits").alias("h"))
    return each.select(*[F.col("file").getField(c).alias(c) for c in names], F.col("h.rule_id").alias(rule_name), F.col("h.line").alias(line_name))


#: By what the code of a component can do for other apps, how early a person should look (the first row
#: that holds): kind of the component (None: any), how the names stand in the code, the names, the number.
LADDER = [
    (None, "type", ("Stub", "Binder"), 100),
    (None, "call", ("onTransact",), 100),
    (None, "word", ("IInterface",), 100),
    ("provider", "call", ("openFile", "delete", "call"), 95),
    ("service", "call", ("onBind",), 90),
    ("service", "part", ("Location", "Sensor", "startForeground", "Sport", "Workout", "Account"), 85),
    ("provider", "word", ("MatrixCursor", "rawQuery", "query"), 75),
    ("activity", "word", ("WebView", "loadUrl"), 70),
]
EXPOSED, OTHERS = 40, 50


def priority(rule_id: Column, kind: Column, code: Column) -> Column:
    """The number of the first row of LADDER that holds; without one, a number by the rule. A null code holds nothing."""
    words = F.split(code, r"\W+")
    lower = F.lower(code)

    def holds(how: str, names: tuple[str, ...]) -> Column:
        if how == "word":
            return F.arrays_overlap(words, F.array(*map(F.lit, names)))
        if how == "part":
            return F.exists(F.array(*[F.lit(n.lower()) for n in names]), lambda n: F.contains(lower, n))
        any_of = "|".join(names)
        return code.rlike(rf"\b(?:{any_of})\s*+\(" if how == "call" else rf"extends\s++[\w.$]*(?:{any_of})")

    rows = [F.when(F.coalesce(holds(how, names) & (F.lit(True) if k is None else kind == k), F.lit(False)), number) for k, how, names, number in LADDER]
    return F.coalesce(*rows, F.when(rule_id.endswith("EXPORTED_NO_PERMISSION"), EXPOSED), F.lit(OTHERS))


def exposed(kind: Column, exported: Column, authorization: Column, only_protected: Column) -> Column:
    """The rule that an exported component breaks, or null: a provider that is not strongly protected, another one that is
    unprotected, but for receivers of protected broadcasts alone. Null is neither exported nor protected."""
    weak = F.when(kind == "provider", ~authorization.eqNullSafe("strongly_protected")).otherwise((authorization == "unprotected") & ~((kind == "receiver") & F.coalesce(only_protected, F.lit(False))))
    rule = F.when(kind == "provider", "PROVIDER_READ_WRITE_PERMISSION_MISSING").otherwise(F.concat(F.upper(kind), F.lit("_EXPORTED_NO_PERMISSION")))
    return F.when((exported == "true") & weak, rule)


def manifest_facts(apps: DataFrame) -> DataFrame:
    """rule_id and severity_hint for apps (debuggable, allow_backup, cleartext: true, false, unknown or null; target_sdk;
    has_backup_rules, has_network_config), beside their other columns."""
    sdk, backup, clear = F.coalesce("target_sdk", F.lit(0)), F.coalesce("allow_backup", F.lit("unknown")), F.coalesce("cleartext", F.lit("unknown"))
    made = lambda rule, hint: F.struct(F.lit(rule).alias("rule_id"), F.lit(hint).cast("string").alias("severity_hint"))
    allowed = F.when((backup == "true") & (sdk >= 23), F.when(F.col("has_backup_rules"), made("ALLOW_BACKUP_ENABLED", "low")).otherwise(made("ALLOW_BACKUP_ENABLED", None))).when((backup == "unknown") & (sdk >= 23), made("ALLOW_BACKUP_ENABLED", "low"))
    old = (sdk > 0) & (sdk < 28) & ~((clear == "false") & ~F.col("has_network_config"))
    plain = F.when((clear == "true") & (sdk >= 28), F.when(F.col("has_network_config"), made("CLEARTEXT_TRAFFIC_ALLOWED", "low")).otherwise(made("CLEARTEXT_TRAFFIC_ALLOWED", None))).when(old, made("CLEARTEXT_TRAFFIC_ALLOWED", "low"))
    found = F.filter(F.array(F.when(F.col("debuggable") == "true", made("DEBUGGABLE_IN_PRODUCTION", "high")), allowed, plain), lambda r: r.isNotNull())
    return apps.withColumn("fact", F.explode(found)).select(*apps.columns, "fact.*")


def name_tokens(name: Column) -> Column:
    """The lower-case words of a name in camel case, or with underscores or dots."""
    parted = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(parted), "[ _.]+"), lambda w: w != "")


#: Words in the names of activities that hint at sensitive business.
SENSITIVE_NAMES = ("reset", "password", "admin", "payment", "debug", "login", "token", "account", "pay", "auth", "credential", "cert")


def sensitive_name(name: Column) -> Column:
    return F.arrays_overlap(name_tokens(name), F.array(*map(F.lit, SENSITIVE_NAMES)))
