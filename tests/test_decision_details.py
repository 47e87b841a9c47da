"""Bases that analyses name, contradictions and severities, worked out by hand."""

from pyspark.sql import functions as F

from sightline.operators import decision

GAP = "array<struct<code:string,critical:boolean,claim_impact:string>>"
SCHEMA = (
    "n int, verdict string, flaw_holds boolean, refutation_basis array<string>, deterministic_facts struct<value_flow_reaches_sink_argument:boolean,sender_reachable:boolean,guard_status:string,authorization_status:string>, "
    "guard_status string, authorization_status string, exported boolean, provider_exported boolean, target_registered boolean, target_fixed boolean, argument_constant boolean, call_site_exists boolean, "
    f"blocking_gaps {GAP}, ai_blocking_gaps {GAP}, coverage_gaps {GAP}, evidence_level string, chain_verified boolean, dataflow_status string, analysis_status string, rule_id string, severity_hint string, impact_status string, "
    "evidence_decision string"
)
NAMES = [f.split(" ")[0] for f in SCHEMA.replace("value_flow_reaches_sink_argument:boolean,sender_reachable:boolean,guard_status:string,authorization_status:string", "").replace("code:string,critical:boolean,claim_impact:string", "").split(", ")]
BASE = dict.fromkeys(NAMES) | {"evidence_level": "L2", "chain_verified": True, "dataflow_status": "verified", "authorization_status": "unprotected", "guard_status": "absent", "severity_hint": "high", "impact_status": "proven", "deterministic_facts": (None, None, None, None)}


def table(spark, *changes):
    return spark.createDataFrame([tuple(({**BASE, **c} | {"n": i})[k] for k in NAMES) for i, c in enumerate(changes)], SCHEMA)


def test_bases_need_facts_for_every_one_of_them(spark):
    sink = {"refutation_basis": ["in_process_terminus"], "deterministic_facts": (False, None, None, None)}
    cases = [
        (sink, ["in_process_terminus"]), ({**sink, "refutation_basis": ["in_process_terminus", "constant_sink_argument"]}, []),
        ({**sink, "refutation_basis": ["in_process_terminus", " ", None, "constant_sink_argument"], "argument_constant": True}, ["in_process_terminus", "constant_sink_argument"]),
        ({**sink, "deterministic_facts": None}, []), ({"refutation_basis": ["fixed_local_target"], "target_fixed": True}, []), ({"refutation_basis": ["fixed_local_target"], "target_fixed": True, "target_registered": False}, []),
        ({"refutation_basis": ["fixed_local_target"], "target_fixed": True, "target_registered": True}, ["fixed_local_target"]), ({"refutation_basis": ["made_up"]}, []), ({"refutation_basis": None}, []),
        ({"refutation_basis": ["non_exported_provider"], "exported": False}, ["non_exported_provider"]), ({"refutation_basis": ["guard_fail_closed"], "guard_status": "present_effective"}, ["guard_fail_closed"]),
        ({"refutation_basis": ["no_real_call_site"], "call_site_exists": False}, ["no_real_call_site"]), ({"refutation_basis": ["sender_unreachable"]}, []),
    ]
    got = table(spark, *[c for c, _ in cases]).select("n", decision.confirmed_bases().alias("b")).orderBy("n").collect()
    assert [r["b"] for r in got] == [w for _, w in cases]


def test_an_analysis_at_odds_with_itself_gets_no_grade(spark):
    none = F.array().cast("array<string>")
    cases = [
        ({}, ("high", "proven_flow_and_boundary")), ({"verdict": "refutes_candidate", "flaw_holds": True}, ("pending", "critical_gap")), ({"verdict": "refutes_candidate", "flaw_holds": False}, ("high", "proven_flow_and_boundary")),
        ({"ai_blocking_gaps": [("X", None, None)]}, ("pending", "critical_gap")), ({"ai_blocking_gaps": [("X", False, None)]}, ("high", "proven_flow_and_boundary")), ({"evidence_level": None}, ("informational", "surface_only")),
        ({"rule_id": "PROVIDER_CALLER_CHECK_MISSING"}, ("high", "calibrated_ceiling")), ({"impact_status": None, "dataflow_status": "interprocedural"}, ("medium", "impact_potential")),
    ]
    got = table(spark, *[c for c, _ in cases]).select("n", decision.severity(decision.conflict(none)).alias("s")).orderBy("n").collect()
    assert [tuple(r["s"]) for r in got] == [w for _, w in cases]
