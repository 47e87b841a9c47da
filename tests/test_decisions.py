"""Merges, gate, walks and manifests on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import lattice, protection
from sightline.operators import evaluation, graph


def merged(spark, made, *statuses):
    return spark.createDataFrame([(s,) for s in statuses], "s string").agg(made(F.col("s")).alias("m")).first()["m"]


@pytest.mark.parametrize(
    ("made", "cases"),
    [
        (
            lattice.guard,
            {
                ("present_effective",): "present_effective", ("present_effective", "absent"): "present_bypassable", ("absent",): "absent", ("absent", "unknown"): "unknown",
                ("present_partial", "present_bypassable"): "present_partial", ("present_effective", None): "unknown", ("odd", "present_effective"): "unknown", ("odd", "absent"): "absent",
            },
        ),
        (
            lattice.analysis,
            {("ai_completed",): "ai_completed", ("ai_failed", "ai_completed"): "ai_partial", ("ai_skipped", "ai_incomplete"): "ai_incomplete", ("human_confirmed", "ai_completed"): "human_confirmed", (None, "odd"): "rule_only"},
        ),
        (
            lattice.review,
            {
                ("confirmed", "pending_ai"): "confirmed", ("pending_manual", "pending_ai"): "pending_ai", ("ai_false_positive",): "ai_false_positive", ("manual_false_positive", "manual_false_positive"): "manual_false_positive",
                ("ai_false_positive", "manual_false_positive"): "pending_manual", ("ai_false_positive", None): "pending_manual",
            },
        ),
        (lambda s: lattice.least(s, lattice.AUTHORIZATION), {("protected", None): "unknown", (None,): "unknown", ("strongly_protected", "conditional"): "conditional", ("odd",): "unknown"}),
    ],
)
def test_merges(spark, made, cases):
    assert {statuses: merged(spark, made, *statuses) for statuses in cases} == cases


def test_gate(spark):
    def gate(current, baseline, **tolerances):
        frame = lambda rows: spark.createDataFrame(list(rows.items()), "metric string, value double")
        rows = evaluation.gate(frame(current), frame(baseline), tolerances).collect()
        return {r["metric"].rsplit(".", 1)[1]: r["verdict"] for r in rows}, {r["gate"] for r in rows}

    p, r = "metrics.candidate.precision", "metrics.candidate.recall"
    assert gate({p: 0.8, r: 0.5}, {p: 0.8, r: 0.4})[1] == {"ALLOW"}
    assert gate({p: 0.75}, {p: 0.8}) == ({"precision": "BLOCK", "recall": "SKIP", "f1": "SKIP", "explorer_hit_rate": "SKIP", "conditional_hit_rate": "SKIP"}, {"BLOCK"})
    assert gate({p: 0.75}, {p: 0.8}, precision=0.05)[1] == {"ALLOW"}
    assert gate({r: 0.9}, {p: 0.8})[0]["precision"] == "BLOCK"
    assert gate({p: 0.9}, {"other": 1.0})[1] == {"BLOCK"} and gate({p: 0.9}, {})[1] == {"BLOCK"}


def test_walks_end_where_they_come_back(spark):
    parents = spark.createDataFrame([(50, 30), (30, 31), (31, 30), (1, 1), (2, 3), (3, None), (4, 99), *[(100 + i, 101 + i) for i in range(12)]], "vertex long, parent long")
    got = {r["vertex"]: (r["top"], r["steps"], r["gap"]) for r in graph.walk_up(parents).collect()}
    assert got[50] == (31, 2, "cycle") and got[30] == (31, 1, "cycle") and got[1] == (1, 0, "cycle")
    assert got[2] == (3, 1, None) and got[3] == (3, 0, None) and got[4] == (99, 1, None)
    assert got[100] == (108, 8, "depth_limit") and got[110] == (112, 2, None) and len(got) == parents.count()


def test_globs():
    assert [protection.glob(p) for p in ("/a.b", "/x*", r"\*\.", "a.*z")] == [r"\/a.b", r"\/(?:x)*", r"\*\.", "a(?:.)*z"]


def test_export_from_version_31_on(spark):
    rows = spark.createDataFrame([(1, "activity", None, True, 31), (2, "activity", None, True, 30), (3, "service", None, False, 34), (4, "provider", None, True, 16), (5, "activity", "x", True, 34)], "i int, kind string, stated string, f boolean, sdk int")
    made = protection.exported(F.col("kind"), F.col("stated"), F.col("f"), F.col("sdk"), F.lit(36))["exported"]
    assert {r["i"]: r["e"] for r in rows.select("i", made.alias("e")).collect()} == {1: "conditional", 2: "true", 3: "false", 4: "true", 5: "unknown"}
