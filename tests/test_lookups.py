"""Lookups held against brute force."""

import random

from sightline.operators import lookups
from sightline.plans import registry


def test_entries_answer_like_all_pairs(spark):
    """Many entries of few methods with constraints and arities: each call gets the first entry that fits."""
    draw = random.Random(5)
    maybe = lambda *values: draw.choice([None, *values])
    entries = [(i, draw.choice("ab"), f"t{i}", maybe("p.q.X", "p.Y"), maybe("p.", "", "p.q"), maybe("X", "Y"), draw.choice([None, [], [1], [1, 2]])) for i in range(60, 0, -1)]
    calls = [(i, draw.choice(["a", "b", "c", None]), maybe("p.q.X", "p.Y", "Z", "", "r.X"), maybe(0, 1, 2)) for i in range(400)]
    fits = lambda e, c: e[1] == c[1] and (c[2] is None or not any(x is not None for x in e[3:6]) or c[2] == e[3] or (e[4] is not None and c[2].startswith(e[4])) or c[2].split(".")[-1] == e[5]) and (e[6] is None or c[3] is None or c[3] in e[6])
    want = {}
    for c in calls:
        first = min((e for e in entries if fits(e, c)), default=None)
        want[c[0]] = (None, None) if first is None else (first[2], first[6] is None or c[3] is not None)
    given = spark.createDataFrame(calls, "call int, method string, receiver string, arity int")
    table = spark.createDataFrame(entries, "place int, method string, taxonomy string, exact string, prefix string, leaf string, arities array<int>")
    assert {r["call"]: (r["taxonomy"], r["confirmed"]) for r in lookups.taxonomy(given, table).collect()} == want


def test_calls_that_ask_the_same_are_asked_once(spark):
    """The first entry is found for requests, under the signs that it answers to, not by pairs of calls and entries."""
    entries = spark.range(1, 3000).selectExpr("id AS place", "'m' AS method", "concat('t', id) AS taxonomy", "CAST(NULL AS STRING) AS exact", "concat('p', id % 3) AS prefix", "CAST(NULL AS STRING) AS leaf", "CAST(NULL AS ARRAY<INT>) AS arities")
    asked = spark.createDataFrame([("1", "m", "p2.X", None), ("2", "m", None, 1), ("3", "m", "q", 1)], "request string, method string, receiver string, arity int")
    assert {r["request"]: r["best"]["taxonomy"] for r in lookups.answered(asked, entries).collect()} == {"1": "t2", "2": "t1"}


def test_files_of_nested_components(spark):
    """A nested component has the files of its outer class, by full name, simple name and path."""
    classes = spark.createDataFrame([("a.Out", "Out", "x/1.java"), ("b.Out", "Out", "x/2.java"), (None, None, "y/OUT.kt"), (None, None, "y/out$in.java"), ("a.Other", "Other", "x/3.java"), (None, None, "Top.java")], "qualified string, name string, path string")
    asked = spark.createDataFrame([("a.Out$In",), ("Top$In",)], "component string")
    assert sorted(tuple(r) for r in lookups.files_of_components(asked, classes, strict=False).collect()) == [("Top$In", "Top.java"), *[("a.Out$In", p) for p in ("x/1.java", "x/2.java", "y/OUT.kt", "y/out$in.java")]]


def test_severity_reads_the_texts_of_documents(spark, tmp_path):
    texts = ["Of THE of", "other", "a sch", "x", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["severity"] for r in registry.QUERIES["severity_words"](spark, str(tmp_path)).collect()}
    assert got == {0: "critical", 1: "high", 2: "medium", 3: "low", 4: "low"}
