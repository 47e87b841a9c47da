"""Source trees as tables: files, classes, methods and call sites.

Files are read and shuffled by Spark; Python only lexes one file's text at a time inside a task.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolution

#: Bytes of an ordinary file, and of one that a manifest component is declared in.
NORMAL_BYTES, COMPONENT_BYTES = 512 * 1024, 2 * 1024 * 1024

_skip = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:.*?)"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_class = re.compile(r"\b(class|interface|enum|object)\s+(\w+)(?:\s*<[^>{]*>)?(?:\s+extends\s+([\w.]+))?")
_method = re.compile(r"(?:\bfun\s+|\b[\w.<>\[\]]+\s+)(\w+)\s*\(([^(){};]*)\)\s*(?:throws\s+[\w.,\s]+)?(?::\s*[\w.<>?]+\s*)?\{")
_call = re.compile(r"(?:\b(\w+)\s*\.\s*)?\b(\w+)\s*\(")
#: Words that look like calls or types but are neither.
_WORDS = frozenset("if for while switch catch return new else do try synchronized throw when super this".split())

SCHEMA = "path string, kind string, name string, class_name string, package string, arity int, receiver string, caller string, start_line int, end_line int"


def mask(source: str) -> str:
    """The source with comments and strings blanked; length and line ends stay."""
    return _skip.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def scan(spark: SparkSession, root: str, components: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, content) of the admitted sources below root, and (path, length) of those that are too large. Files of
    the named component classes may be larger."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{java,kt}").load(root)
    stems = [c.rpartition(".")[2] for c in components or []]
    limit = F.when(F.regexp_extract("path", r"([^/]+)\.\w+$", 1).isin(stems), COMPONENT_BYTES).otherwise(NORMAL_BYTES) if stems else F.lit(NORMAL_BYTES)
    admitted = files.where(F.col("length") <= limit).select("path", F.decode("content", "UTF-8").alias("content"))
    return admitted, files.where(F.col("length") > limit).select("path", "length")


def _span_end(code: str, opening: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, opening):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(code)


def _args(code: str, opening: int) -> int:
    depth, n, empty = 0, 1, True
    for i in range(opening, len(code)):
        c = code[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                break
        elif c == "," and depth == 1:
            n += 1
        empty = empty and (i == opening or c.isspace())
    return 0 if empty else n


def structure_of(path: str, content: str) -> list[tuple]:
    """Rows of SCHEMA for one file: classes, methods and calls; the innermost class holds a method."""
    code = mask(content)
    ends = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect.bisect_left(ends, at) + 1
    package = (re.search(r"^\s*package\s+([\w.]+)", code, re.M) or ["", ""])[1]
    rows, classes, methods = [], [], []
    for m in _class.finditer(code):
        at = code.find("{", m.end())
        stop = _span_end(code, at) if at >= 0 else m.end()
        classes.append((m.start(), stop, m[2]))
        rows.append((path, "class", m[2], m[3], package, None, None, None, line(m.start()), line(stop)))
    holder = lambda spans, at: max((s for s in spans if s[0] < at <= s[1]), default=(0, 0, None))[2]
    for m in _method.finditer(code):
        if m[1] not in _WORDS and code[m.start() : m.start(1)].split()[0] not in ("new", "return", "else"):
            stop = _span_end(code, m.end() - 1)
            methods.append((m.end(), stop, m[1]))
            rows.append((path, "method", m[1], holder(classes, m.start()), package, _args(code, m.end(1) + code[m.end(1) :].index("(")), None, None, line(m.start(1)), line(stop)))
    for m in _call.finditer(code):
        caller = holder(methods, m.start(2))
        if caller and m[2] not in _WORDS:
            rows.append((path, "call", m[2], holder(classes, m.start(2)), package, _args(code, m.end() - 1), m[1], caller, line(m.start(2)), line(m.start(2))))
    return rows


def structure(files: DataFrame) -> DataFrame:
    """Classes, methods and calls of files (path, content) as rows of SCHEMA; a null content has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                found = pd.DataFrame(structure_of(path, content or ""), columns=names)
                yield found.astype({"arity": "Int32", "start_line": "Int32", "end_line": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def call_sites(rows: DataFrame) -> DataFrame:
    """Calls with target method and status: looked up by (class, name, arity), the class being the caller's unless a
    receiver is named; with a receiver other than this, by the receiver's capitalised name."""
    method_id = F.concat_ws("#", "path", "class_name", "name", F.col("start_line").cast("string"))
    methods = rows.where("kind = 'method'").select(method_id.alias("id"), F.col("class_name").alias("owner"), "name", "arity")
    own = F.col("receiver").isNull() | (F.col("receiver") == "this")
    owner = F.when(own, F.col("class_name")).otherwise(F.initcap("receiver"))
    calls = rows.where("kind = 'call'").select("path", "caller", "start_line", "receiver", owner.alias("owner"), "name", "arity")
    return resolution.by_key(calls, methods, ["owner", "name", "arity"], "id")
