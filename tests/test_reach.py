"""Scoped reachability against a walk by hand, where some vertices have one edge into them and others several."""

import random

from pyspark.sql import functions as F

from sightline.operators import graph


def test_scopes_over_trees_joins_and_cycles(spark):
    draw = random.Random(11)
    edges = [(i // 2, i) for i in range(1, 60)] + [(draw.randrange(60), draw.randrange(60)) for _ in range(15)] + [(5, 5), (None, 3), (4, None)]
    seeds = [(s, draw.randrange(60)) for s in "abc" for _ in range(2)] + [("d", 0), (None, 1)]
    got = {(r["scope"], r["vertex"]): r["depth"] for r in graph.reach_scoped(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(seeds, "scope string, vertex int")).collect()}
    want = {}
    for scope in "abcd":
        front, depth = {v for s, v in seeds if s == scope}, 0
        while front:
            want |= {(scope, v): depth for v in front}
            front, depth = {b for a, b in edges if a in front and b is not None and (scope, b) not in want}, depth + 1
    assert got == want


def test_large_steps_do_not_go_through_the_driver(spark, monkeypatch):
    """A step with more than FEW rows is joined by shuffle, whatever the size of its file."""
    monkeypatch.setattr(graph, "FEW", 10)
    rows = spark.range(50).select(F.col("id").alias("vertex"))
    plan = lambda n: graph._sized(rows, n).join(spark.range(50), F.col("vertex") == F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(10) and "SortMergeJoin" in plan(11)
