"""Source text as tables: comments and strings masked in place, brackets with their partners at any depth, call sites.

A text is cut once into pieces that end with a bracket, comma or semicolon. Depths are running sums over the pieces of a
text; a bracket's partner is the next one of its kind at its depth. Nothing nests in a pattern, so neither depth nor
length is limited. Equal texts are cut once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import join_spread, written

#: Possessive throughout: a run of any length is one step for the matcher.
_TEXT_BLOCK = r'"""(?s:.*?)(?:"""|\z)'
_STRING = r'"(?:[^"\\]++|\\.?+)*+(?:"|\z)'
_CHARACTER = r"'(?:[^'\\]++|\\.?+)*+(?:'|\z)"
_COMMENT = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_SEGMENT = rf"(?s)({_TEXT_BLOCK}|{_STRING}|{_CHARACTER}|{_COMMENT}|[^/\"']++|.)"
_PIECE = r"([^(){},;]*+[(){},;])"
#: A name before a bracket, with the name before its dot.
_NAME = r"(?:([\w$]++)\s*+\.\s*+)?([\w$]++)\s*+\z"


def masked(code: Column, strings: bool = True) -> Column:
    """The text with comments (and strings) as blanks; length and line ends stay. A string or comment that does not end
    goes on to the end of the text."""
    segments = F.regexp_extract_all(code, F.lit(_SEGMENT), F.lit(1))
    comment = lambda s: s.startswith("//") | s.startswith("/*")
    string = lambda s: s.startswith('"') | s.startswith("'")
    hidden = lambda s: comment(s) | string(s) if strings else comment(s)
    return F.array_join(F.transform(segments, lambda s: F.when(hidden(s), F.regexp_replace(s, r"[^\n]", " ")).otherwise(s)), "")


def contents(files: DataFrame, code: str = "code") -> DataFrame:
    """digest, text (without comments) and bare (without strings too) of the different texts of files; nulls are left out."""
    texts = files.select(F.col(code).alias("code")).where("code is not null").withColumn("digest", F.sha2("code", 256))
    return texts.dropDuplicates(["digest"]).select("digest", masked(F.col("code"), False).alias("text"), masked(F.col("code")).alias("bare"))


def pieces(texts: DataFrame) -> DataFrame:
    """digest, i, head, mark, begin, end (offsets from 0, the mark being at end - 1), line (of begin, from 1), paren and
    brace (depths after the mark), and next: a brace that opens with nothing but blanks before it.

    texts: digest and bare. A text is a row, so its pieces are a partition of the windows.
    """
    cut = texts.select("digest", F.posexplode(F.regexp_extract_all("bare", F.lit(_PIECE), F.lit(1))).alias("i", "piece"))
    along = Window.partitionBy("digest").orderBy("i")
    mark = F.substring("piece", -1, 1)
    by = lambda up, down: F.sum(F.when(mark == up, 1).when(mark == down, -1).otherwise(0)).over(along)
    breaks = F.regexp_count("piece", F.lit("\n"))
    cut = cut.withColumns({
        "mark": mark, "head": F.expr("left(piece, length(piece) - 1)"), "end": F.sum(F.length("piece")).over(along), "line": 1 + F.sum(breaks).over(along) - breaks,
        "paren": by("(", ")"), "brace": by("{", "}"), "next": F.when(F.trim(F.lead(F.expr("translate(piece, chr(10) || chr(9) || chr(13), '   ')")).over(along)).isin("{"), F.lead(mark).over(along)),
    })
    after = F.lead("end").over(along)
    return cut.select("digest", "i", "head", "mark", (F.col("end") - F.length("piece")).alias("begin"), "end", "line", "paren", "brace", "next", after.alias("next_end"))


def calls(cut: DataFrame) -> DataFrame:
    """Call sites and headers of methods: digest, name, owner ("" without one), at (offset of the owner or name), line,
    level, begin and end (offsets of what is in the parentheses), arguments (begin, end) by the commas of that depth, and
    body (offset behind a brace that follows; null without one). A parenthesis that is not closed is left out."""
    level = F.col("paren") + F.when(F.col("mark") == ")", 1).otherwise(0)
    inside = cut.where(F.col("mark").isin("(", ")", ",")).withColumn("level", level)
    nth = Window.partitionBy("digest", "level").orderBy("i")
    inside = inside.withColumn("nth", F.sum(F.when(F.col("mark") == "(", 1).otherwise(0)).over(nth)).where("nth > 0")
    is_ = lambda m: F.col("mark") == m
    grouped = inside.groupBy("digest", "level", "nth").agg(
        F.max(F.when(is_("("), F.struct("end", "head", "line"))).alias("o"), F.max(F.when(is_(")"), F.struct("end", "next", "next_end"))).alias("c"),
        F.sort_array(F.collect_list(F.when(is_(","), F.col("end")))).alias("commas"),
    )
    name = lambda i: F.regexp_extract("o.head", _NAME, i)
    found = grouped.where("c is not null").withColumn("whole", name(0)).where("whole <> ''")
    before = F.expr("left(o.head, length(o.head) - length(whole))")
    begin, end = F.col("o.end"), F.col("c.end") - 1
    edges = F.concat(F.array(begin), "commas", F.array(end + 1))
    split = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: F.struct(F.element_at(edges, k).alias("begin"), (F.element_at(edges, k + 1) - 1).alias("end")))
    return found.select(
        "digest", name(2).alias("name"), name(1).alias("owner"), (begin - 1 - F.length("whole")).alias("at"), (F.col("o.line") + F.regexp_count(before, F.lit("\n"))).cast("long").alias("line"),
        "level", begin.alias("begin"), end.alias("end"), split.alias("arguments"), F.when(F.col("c.next") == "{", F.col("c.next_end")).alias("body"),
    )


def blocks(cut: DataFrame) -> DataFrame:
    """digest, body (offset behind an opening brace) and body_end (of its partner); a brace that is not closed is left out."""
    level = F.col("brace") + F.when(F.col("mark") == "}", 1).otherwise(0)
    braces = cut.where(F.col("mark").isin("{", "}")).withColumn("level", level)
    partner = F.lead("end").over(Window.partitionBy("digest", "level").orderBy("i"))
    return braces.withColumn("body_end", partner - 1).where("mark = '{' and body_end is not null").select("digest", F.col("end").alias("body"), "body_end")


def between(text: str, begin: Column, end: Column) -> Column:
    """The part of a text column from offset begin up to end."""
    return F.col(text).substr((begin + 1).cast("int"), (end - begin).cast("int"))


def call_sites(files: DataFrame, code: str = "code") -> DataFrame:
    """The other columns of files (as file) with name, owner, line, level and arguments (their texts without comments) of
    every call site and method header. Null texts have none; equal texts are cut once, repeated rows each have theirs."""
    names = [c for c in files.columns if c != code]
    keyed = files.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("file"), F.sha2(F.col(f"`{code}`"), 256).alias("digest"))
    texts = written(contents(files.select(F.col(f"`{code}`").alias("code"))))
    sites = calls(pieces(texts)).groupBy("digest").agg(F.collect_list(F.struct("name", "owner", "line", "level", "arguments")).alias("sites"))
    listed = texts.join(sites, "digest")
    cut = F.transform("sites", lambda s: s.withField("arguments", F.transform(s["arguments"], lambda a: F.trim(between("text", a["begin"], a["end"])))))
    return join_spread(keyed, written(listed.select("digest", cut.alias("sites"))), "digest").select("file", F.explode("sites").alias("s")).select("file", "s.*")
