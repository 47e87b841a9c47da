"""Lookups by name: components to files, symbols by prefix, class relations, taxonomy of calls, requests for methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import join_spread


def files_of_components(components: DataFrame, classes: DataFrame, strict: bool) -> DataFrame:
    """component, path: the files of classes (qualified, name, path; a file without classes has null names) that belong to
    components (component: a full name).

    Not strict: by the full name, by the last part of it as a class's name, or by files of that name in any folder (.java
    or .kt, in any case of ASCII letters); a nested component (A$B) also by those of its outer class. Strict: by the full name of the outer class (A of A$B), or the path made of it;
    only where neither exists, by the simple name, if all classes of it share one full name.
    """
    asked = components.select("component").where("component is not null").distinct()
    found = lambda df, left, right: df.join(classes, left == right).select("component", "path")
    if not strict:
        full = asked.select("component", F.explode(F.array_distinct(F.array("component", F.substring_index("component", "$", 1)))).alias("full"))
        last = full.select("component", F.substring_index("full", ".", -1).alias("last")).distinct()
        named = last.select("component", F.explode(F.array(*[F.concat(F.lower("last"), F.lit(end)) for end in (".java", ".kt")])).alias("file"))
        files = classes.where("path like '%/%'").select(F.lower(F.substring_index("path", "/", -1)).alias("file"), "path").distinct()
        by_file = named.join(files, "file").select("component", "path")
        top = full.where("full not like '%.%'").select("component", F.concat("full", F.lit(".java")).alias("file"))
        by_file = by_file.unionByName(found(top, F.col("file"), F.col("path")))
        return found(full, F.col("full"), F.col("qualified")).unionByName(found(last, F.col("last"), F.col("name"))).unionByName(by_file).distinct()
    asked = asked.withColumn("full", F.substring_index("component", "$", 1))
    asked = asked.withColumns({"simple": F.substring_index("full", ".", -1), "source": F.translate("full", ".", "/")})
    spelled = asked.select("component", F.explode(F.array(*[F.concat("source", F.lit(end)) for end in (".java", ".kt")])).alias("file"))
    sure = found(asked, F.col("full"), F.col("qualified")).unionByName(found(spelled, F.col("file"), F.col("path"))).distinct()
    single = classes.groupBy("name").agg(F.min("qualified").alias("a"), F.max("qualified").alias("b")).where("a = b").select("name")
    rest = asked.join(sure.select("component").distinct(), "component", "left_anti")
    loose = rest.join(classes.join(single, "name", "left_semi"), F.col("simple") == F.col("name")).select("component", "path")
    return sure.unionByName(loose.distinct())


def like_prefix(column: Column, term: str) -> Column:
    """Whether a text begins with the term in any case of ASCII letters; _ and % stand for one sign and any signs."""
    return F.lower(column).like(term.lower() + "%")


def search(symbols: dict[str, DataFrame], term: str, most: int = 50) -> DataFrame:
    """kind, name, id of the first so many symbols (name, id) of each kind that begin with the term; a top-k, not a sort."""
    parts = [df.where(like_prefix(F.col("name"), term)).orderBy("name", "id").limit(most).select(F.lit(kind).alias("kind"), "name", "id") for kind, df in symbols.items()]
    return reduce(DataFrame.unionByName, parts)


def relations(classes: DataFrame) -> DataFrame:
    """qualified, relation (parent, interface, subclass), other for classes (qualified, name, extends, implements).
    Subclasses name their parent in full or by its simple name; a class is not its own subclass."""
    up = classes.where("extends is not null").select("qualified", F.lit("parent").alias("relation"), F.col("extends").alias("other"))
    sides = classes.select("qualified", F.lit("interface").alias("relation"), F.explode("implements").alias("other"))
    below = classes.where("extends is not null").select(F.col("qualified").alias("other"), "extends")
    # One equi-join on both spellings instead of an OR.
    spelled = classes.select("qualified", F.explode(F.array_distinct(F.array("qualified", "name"))).alias("extends"))
    down = spelled.join(below, "extends").where("qualified <> other").select("qualified", F.lit("subclass").alias("relation"), "other")
    return reduce(DataFrame.unionByName, [up, sides, down]).distinct()


def taxonomy(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """Add taxonomy and confirmed to calls (call, method, receiver, arity). entries: place, method, taxonomy, exact,
    prefix, leaf (any of them null), arities (null: any).

    Entries of the method fit if they have no constraint on the receiver, if the receiver meets one of them, or if the
    receiver is unknown; the first by place counts. A known arity that an entry does not list rules it out; an unknown
    one leaves the call unconfirmed. Calls that ask the same are asked once, and entries stand under what they answer to,
    so one equi-join finds the first entry, however many entries a method has.
    """
    request = F.to_json(F.struct("method", "receiver", "arity"))
    asked = calls.where("method is not null").select("method", "receiver", "arity").distinct()
    met = answered(asked.withColumn("request", request), entries)
    keyed = calls.withColumn("request_of_call", F.when(F.col("method").isNotNull(), request))
    return join_spread(keyed, met.withColumnRenamed("request", "request_of_call"), "request_of_call", "left").select(*calls.columns, "best.taxonomy", "best.confirmed")


def answered(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """request and best (place, taxonomy, confirmed), the first entry that fits, for requests (request, method, receiver,
    arity) that any entry fits. Signs: a free entry f, a constraint e, p or l and its value, any entry *."""
    listed = lambda *pairs: F.array_compact(F.array(*pairs))
    sign = lambda kind, value: F.concat(F.lit(kind), value)
    free = F.coalesce("exact", "prefix", "leaf").isNull()
    under = listed(F.lit("*"), F.when(free, "f"), sign("e", F.col("exact")), sign("p", F.col("prefix")), sign("l", F.col("leaf")))
    arities = F.when(F.col("arities").isNull(), F.array(F.lit("any"))).otherwise(F.concat(F.array(F.lit("some")), F.array_compact(F.transform("arities", lambda a: a.cast("string")))))
    stand = entries.select("method", "place", "taxonomy", arities.alias("arities"), F.explode(under).alias("sign")).withColumn("takes", F.explode("arities"))
    stand = stand.groupBy("method", "sign", "takes").agg(F.min(F.struct("place", "taxonomy", (F.col("takes") != "some").alias("confirmed"))).alias("first"))
    receiver = F.col("receiver")
    prefixes = F.transform(F.sequence(F.lit(0), F.length(receiver)), lambda n: F.concat(F.lit("p"), F.substring(receiver, F.lit(1), n)))
    signs = F.when(receiver.isNull(), F.array(F.lit("*"))).otherwise(F.concat(F.array(F.lit("f"), sign("e", receiver), sign("l", F.substring_index(receiver, ".", -1))), prefixes))
    takes = F.array(F.lit("any"), F.coalesce(F.col("arity").cast("string"), F.lit("some")))
    wide = asked.select("request", "method", F.explode(signs).alias("sign"), takes.alias("both")).select("request", "method", "sign", F.explode("both").alias("takes"))
    return wide.join(stand, ["method", "sign", "takes"]).groupBy("request").agg(F.min("first").alias("best"))


def severity_words(text: Column, ladder: tuple[tuple[str, str], ...], otherwise: str = "medium") -> Column:
    """The value of the first pattern that occurs in a text, in any case."""
    out = F.lit(otherwise)
    for pattern, value in reversed(ladder):
        out = F.when(text.rlike(f"(?i){pattern}"), value).otherwise(out)
    return out


def skipped_components(components: DataFrame, skipped: DataFrame) -> DataFrame:
    """component, path: exported components whose source (path without the nested part) is a skipped file, or has
    skipped files below it. Paths are cut into their ancestors once, so the prefix test is an equi-join."""
    wanted = components.where("exported = 'true'").select("component", F.translate(F.substring_index("component", "$", 1), ".", "/").alias("source")).where("source <> ''")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    stem = F.when(F.col("path").endswith(".java"), F.regexp_replace("path", r"\.java$", ""))
    folders = skipped.select("path", F.explode(F.array_distinct(F.array_compact(F.concat(F.filter(above, lambda a: a != F.col("path")), F.array(stem))))).alias("source"))
    return wanted.join(folders, "source").select("component", "path").distinct()


def heads(rows: DataFrame, row_id: str, orders: dict[str, list], most: int) -> DataFrame:
    """queue, row_id, place of the first so many rows in each of several orders; each a top-k, so that only these rows are
    numbered in one task. Orders must tell all rows apart for the same result each time."""
    parts = [rows.orderBy(*by).limit(most).select(F.lit(name).alias("queue"), row_id, F.row_number().over(Window.orderBy(*by)).cast("long").alias("place")) for name, by in orders.items()]
    return reduce(DataFrame.unionByName, parts)


def assets(rows: DataFrame, row_id: str, digest: str, run: str) -> DataFrame:
    """rows with asset, the least row_id of the rows of one digest, and scoped_id, an id that carries the run (none for a
    null one) and the beginning of the digest. Digests with many copies are not dealt to one task; null ones have no asset."""
    first = rows.groupBy(digest).agg(F.min(row_id).alias("asset"))
    scoped = F.concat(F.lit("run_"), F.coalesce(F.col(run), F.lit("none")), F.lit("_"), F.substring(digest, 1, 12))
    return join_spread(rows, first, digest, "left").withColumn("scoped_id", scoped)


def within_files(items: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """items (keys, line, end_line) with within: whether their file (keys unique, total lines) is there and holds them."""
    within = (F.col("line") >= 1) & (F.col("line") <= F.col("end_line")) & (F.col("end_line") <= F.col("total"))
    return items.join(files, keys, "left").withColumn("within", F.coalesce(within, F.lit(False))).drop("total")
