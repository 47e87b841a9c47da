"""Findings merged from candidates, worked out by hand."""

from sightline.operators import findings

E = "array<struct<path:string,line:int>>"
SCHEMA = f"n int, auxiliary boolean, component string, component_name string, scope_key string, chain_key string, rule_id string, evidence_level string, deterministic_chain_verified boolean, sources {E}, sinks {E}, propagation_paths {E}, locations {E}, blocking_gaps {E}, dataflow_status string, impact_status string, authorization_status string, guard_status string, analysis_status string"


def row(n, rule="R", level="L2", closed=True, locations=(), authorization="protected", guard="present_effective", analysis="ai_completed", name="a.B", auxiliary=False, sources=(("s", 1),)):
    return (n, auxiliary, "service", name, "x", "y", rule, level, closed, list(sources), [("k", 1)], None, list(locations) if locations is not None else None, None, "verified", "proven", authorization, guard, analysis)


def test_members_add_to_the_primary(spark):
    rows = [
        row(1, "R", locations=[("a", 1), ("b", 2)], authorization="conditional"), row(2, "S", "L3", False, locations=[("b", 2), ("c", 3), ("b", 2)], guard="absent"), row(3, "R", "L3", True, locations=None, analysis="ai_failed", sources=[("t", 9)]),
        row(4, "R", "L3", True, auxiliary=True), row(5, name=None), row(6, name="a.C"),
    ]
    got = {r["component_name"]: r for r in findings.merged(spark.createDataFrame(rows, SCHEMA), "n").collect()}
    assert set(got) == {"a.B", None, "a.C"}
    first = got["a.B"]
    assert (first["primary"], first["n_members"], first["rule_ids"], first["evidence_level"]) == (3, 3, ["R", "S"], "L3")
    assert [tuple(x) for x in first["sources"]] == [("t", 9)] and [tuple(x) for x in first["locations"]] == [("a", 1), ("b", 2), ("c", 3)] and first["blocking_gaps"] == []
    assert (first["authorization_status"], first["guard_status"], first["analysis_status"]) == ("conditional", "present_bypassable", "ai_partial")
    assert first["finding"].startswith("finding_") and len({r["finding"] for r in got.values()}) == 3
    assert findings.merged(spark.createDataFrame(rows, SCHEMA).limit(0), "n").count() == 0


def test_union_keeps_the_first_place_of_each_element(spark):
    rows = spark.createDataFrame([("g", 2, ["b", "a"]), ("g", 1, ["c", "b", None, "c"]), ("h", 1, None), (None, 1, ["z"])], "g string, n int, x array<string>")
    assert {r["g"]: r["x"] for r in findings.united(rows, "g", "n", ["x"]).collect()} == {"g": ["c", "b", None, "a"], None: ["z"]}
