"""Protection levels, permission policies, path policies and effective export, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import broadcast_if_few, unused

#: Fixed values of the platform: base levels by number, flags by bit.
BASES = ("normal", "dangerous", "signature", "signatureOrSystem", "knownSigner", "internal")
FLAGS = (
    "privileged", "development", "appop", "pre23", "installer", "verifier", "preinstalled", "setup", "instant", "runtime", "oem", "vendorPrivileged",
    "textClassifier", "recents", "role", "configurator", "incidentReportApprover", "appPredictor", "companion", "retailDemo", "module",
)
FIRST_FLAG = 4
STATUS = {"normal": "conditional", "dangerous": "conditional"} | dict.fromkeys(BASES[2:], "strongly_protected")


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def protection(level: Column) -> Column:
    """struct(base, flags, status, unknown) of a protection level written as a number (decimal or 0x...) or as names
    with | between them. Anything unknown makes the status unknown."""
    text = F.trim(level)
    bits = F.when(text.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(text, 3, 16), 16, 10)).when(text.rlike(r"^[0-9]{1,18}$"), text).cast("long")
    low = bits.bitwiseAND(F.lit(15)).cast("int")
    all_flags = sum(1 << FIRST_FLAG + i for i in range(len(FLAGS)))
    set_flags = F.filter(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << FIRST_FLAG + i)) > 0, F.lit(name)) for i, name in enumerate(FLAGS)]), lambda f: f.isNotNull())
    rest = bits.bitwiseAND(F.lit(~(all_flags | 15)))
    numbered = F.filter(F.array(F.when(low >= len(BASES), F.concat(F.lit("base:"), low)), F.when(rest != 0, F.concat(F.lit("flags:0x"), F.lower(F.hex(rest))))), lambda u: u.isNotNull())

    tokens = F.filter(F.transform(F.split(level, r"\|"), lambda t: F.trim(t)), lambda t: t != "")
    by_name = lambda names: F.create_map(*[F.lit(x) for n in names for x in (n.lower(), n)])
    listed = lambda names: F.filter(F.transform(tokens, lambda t: F.try_element_at(by_name(names), F.lower(t))), lambda t: t.isNotNull())
    bases = listed(BASES)
    strange = F.filter(tokens, lambda t: ~F.lower(t).isin(*[n.lower() for n in BASES + FLAGS]))
    missing = F.when(F.size(bases) == 0, _array(["base_missing"])).when(F.size(bases) > 1, _array(["multiple_bases"])).otherwise(F.array().cast("array<string>"))

    is_number = bits.isNotNull()
    base = F.when(is_number, F.get(_array(BASES), low)).otherwise(F.when(F.size(bases) == 1, bases[0]))
    unknown = F.when(level.isNull(), _array(["missing"])).when(is_number, numbered).otherwise(F.concat(strange, missing))
    status = F.when(F.size(unknown) > 0, "unknown").otherwise(F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), base))
    flags = F.when(level.isNull(), F.array().cast("array<string>")).when(is_number, set_flags).otherwise(listed(FLAGS))
    return F.struct(base.alias("base"), flags.alias("flags"), F.coalesce(status, F.lit("unknown")).alias("status"), unknown.alias("unknown"))


def policies(rows: DataFrame, custom: DataFrame, platform: DataFrame, permission: str = "permission", hint: str = "hint") -> DataFrame:
    """Add provenance, level and status to rows: the app's own permissions (custom: owner, name, level) come before the
    platform's (platform: name, level), before a stated hint. Unlisted platform permissions stay unknown. rows need
    owner, permission and hint; both dimensions are unique by key. Columns of rows stay, but for provenance, level and status."""
    own_level, is_own, platform_level = unused(rows.columns, "own_level", "is_own", "platform_level")
    own = custom.select("owner", F.col("name").alias(permission), F.col("level").alias(own_level), F.lit(True).alias(is_own))
    listed = platform.select(F.col("name").alias(permission), F.col("level").alias(platform_level))
    both = rows.join(own, ["owner", permission], "left").join(broadcast_if_few(listed), permission, "left")
    name, told = F.col(permission), F.col(hint).isNotNull() & ~F.col(hint).isin("platform_or_unknown", "unknown")
    found = [
        (F.coalesce(name, F.lit("")) == "", "none", F.lit(None)),
        (F.col(is_own), "manifest_permission", F.col(own_level)),
        (F.col(platform_level).isNotNull(), "platform_catalog", F.col(platform_level)),
        (name.startswith("android.permission."), "platform_catalog_missing", F.lit(None)),
        (told, "component_protection_hint", F.col(hint)),
    ]
    where, level = F.lit("dependency_or_undeclared_permission"), F.lit(None)
    for test, source, value in reversed(found):
        where, level = F.when(test, source).otherwise(where), F.when(test, value).otherwise(level)
    out = both.withColumns({"provenance": where, "level": level.cast("string")}).drop(own_level, is_own, platform_level)
    return out.withColumn("status", F.when(F.col("provenance") == "none", "unprotected").otherwise(protection(F.col("level"))["status"]))


def glob(pattern: str) -> str:
    """A regular expression for the platform's simple globs: a dot is any sign, * repeats the sign before it, a
    backslash takes the next sign as it is."""
    out, at = [], 0
    while at < len(pattern):
        sign = pattern[at]
        if sign == "\\" and at + 1 < len(pattern):
            at += 1
            sign = pattern[at]
        elif sign == ".":
            sign = ""
        atom = "." if not sign else sign if sign.isalnum() else "\\" + sign
        at += 1
        if pattern[at : at + 1] == "*":
            atom, at = f"(?:{atom})*", at + 1
        out.append(atom)
    return "".join(out)


def path_matches(path: Column, kind: str, value: str) -> Column:
    """exact, prefix or pattern (simple glob over the whole path)."""
    return {"exact": lambda: path == value, "prefix": lambda: path.startswith(value), "pattern": lambda: path.rlike(f"^(?:{glob(value)})$")}[kind]()


def path_of(uri: Column) -> Column:
    """The path of a URI; of other text what is before the question mark."""
    return F.when(uri.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)).otherwise(F.split(uri, r"\?")[0])


def exported(kind: Column, stated: Column, has_filter: Column, target_sdk: Column, platform: Column) -> Column:
    """struct(exported, basis) by the platform's rules: a stated value decides; providers depend on the target version;
    filters export, but from version 31 on an export without a statement is only conditional."""
    made = lambda value, basis: F.struct(F.lit(value).alias("exported"), F.lit(basis).alias("basis"))
    provider = F.when(target_sdk.isNull(), made("unknown", "target_sdk_missing")).when(target_sdk < 17, made("true", "provider_default_target_sdk_lt_17")).otherwise(made("false", "provider_default_target_sdk_gte_17"))
    modern = (F.coalesce(target_sdk, F.lit(0)) >= 31) & (platform >= 31)
    filtered = F.when(modern, made("conditional", "android_12_requires_explicit_exported")).otherwise(made("true", "intent_filter_default"))
    return (
        F.when(stated.isin("true", "false"), F.struct(stated.alias("exported"), F.lit("manifest_explicit").alias("basis"))).when(stated.isNotNull(), made("unknown", "manifest_explicit_unresolved"))
        .when(kind == "provider", provider).when(has_filter, filtered).otherwise(made("false", "no_intent_filter_default"))
    )
