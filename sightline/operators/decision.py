"""Routing, refutation, disposition, severity, evidence decisions and review states: expressions over candidate columns.

A candidate row has the columns named in the functions; gaps are arrays of struct(code, critical, claim_impact,
affects_positive_proof, affects_negative_proof), a null array being none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lattice import SEVERITY

c = F.col
PROTECTED = ("protected", "strongly_protected")
UNREACHABLE = ("not_reachable", "unreachable", "internal_only", "not_exported")
TERMINAL_REVIEW = ("confirmed", "manual_false_positive")
#: Premises of a rule, one of which being false refutes it; verdicts of an analysis against a candidate; gaps
#: of targets that only a run shows; codes of severities, bases and gaps.
PREMISES = ("rule_predicate_satisfied", "rule_premise_valid", "rule_precondition_verified")
REFUTING = ("negative", "refutation", "refuted", "refutes_candidate")
#: Impact ceilings of closed chains by rule.
CEILING = {"SERVICE_BINDER_CALLER_CHECK_MISSING": "high", "PROVIDER_CALLER_CHECK_MISSING": "high", "PROVIDER_UNAUTHORIZED_QUERY": "medium"}
LOW_IF_UNREGISTERED = ("ACTIVITY_EXTERNAL_ROUTE_INJECTION", "ACTIVITY_INTENT_TO_SENSITIVE_SINK", "SERVICE_IPC_INPUT_TO_SINK")
UNDECIDABLE_GAPS = (
    "ROUTE_TARGET_RESOLUTION_UNVERIFIED", "SYMBOL_TARGET_AMBIGUOUS", "BINDER_RETURN_TYPE_AMBIGUOUS", "BINDER_RETURN_TYPE_UNRESOLVED",
    "BINDER_IMPLEMENTATION_AMBIGUOUS", "BINDER_IMPLEMENTATION_UNRESOLVED", "BINDER_DISPATCH_TARGET_UNRESOLVED",
)


def yes(condition: Column) -> Column:
    """Null as false."""
    return F.coalesce(condition, F.lit(False))


def cascade(cases: list[tuple[Column, str | Column]], otherwise: str | Column) -> Column:
    """The value of the first case that holds; null conditions do not hold."""
    first, *rest = cases
    return reduce(lambda made, case: made.when(*case), rest, F.when(*first)).otherwise(otherwise)


def blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def has_critical(gaps: str) -> Column:
    """Whether a gap is critical; one that does not say so is."""
    return yes(F.exists(gaps, lambda g: F.coalesce(g["critical"], F.lit(True))))


def has_code(gaps: str, code: str) -> Column:
    return yes(F.exists(gaps, lambda g: g["code"] == code))


def precheck() -> Column:
    """Reads auxiliary, evidence_level, reachability_status, authorization_status, component_name; struct(eligible, route, reason)."""
    made = lambda eligible, route, reason: F.struct(F.lit(eligible).alias("eligible"), F.lit(route).alias("route"), F.lit(reason).alias("reason"))
    level, reach = c("evidence_level"), c("reachability_status")
    return cascade(
        [
            (yes(c("auxiliary")), made(False, "none", "AUXILIARY_CANDIDATE")),
            (level == "L2", made(True, "l2_review", "L2_REVIEW_ELIGIBLE")),
            (blank(level) | (level != "L1"), made(False, "none", "EVIDENCE_LEVEL_UNKNOWN")),
            (~blank(reach) & ~reach.isin("reachable", "conditional"), made(False, "none", "L1_UNREACHABLE")),
            (c("authorization_status").isin(*PROTECTED), made(False, "none", "L1_PROTECTED")),
            (F.trim(F.coalesce("component_name", F.lit(""))) == "", made(False, "none", "L1_COMPONENT_NAME_MISSING")),
        ],
        made(True, "l1_triage", "L1_TRIAGE_ELIGIBLE"),
    )


def refutation_bases() -> Column:
    """The deterministic reasons against a candidate, as an array in fixed order without nulls."""
    local = r"\bLocalBroadcastManager\b|\bEventBus\b"
    no_sinks = F.coalesce(F.size("sinks"), F.lit(0)) <= 0
    tests = [
        ("strong_permission", c("authorization_status").isin(*PROTECTED)),
        ("effective_guard", c("guard_status") == "present_effective"),
        ("not_reachable", c("reachability_status").isin(*UNREACHABLE)),
        ("sender_unreachable", ~c("sender_reachable")),
        ("in_process_terminus", (c("flow_kind") == "control_to_sink") & ~has_code("blocking_gaps", "CONTROL_SCOPE_UNRESOLVED")),
        ("rule_premise_refuted", reduce(lambda a, b: a | b, [yes(~c(p)) for p in PREMISES])),
        ("no_real_sink", yes(~c("real_sink_verified")) | (yes(c("evidence_level") == "L2") & no_sinks & ~yes(c("chain_verified")))),
        ("local_broadcast_intra_process", F.exists("sinks", lambda s: yes(s["receiver_text"].rlike(local))) | yes(c("input_control") == "local_broadcast_isolated")),
    ]
    return F.filter(F.array(*[F.when(yes(test), F.lit(code)) for code, test in tests]), lambda b: b.isNotNull())


def risk() -> Column:
    return F.greatest(F.coalesce("risk_score", F.lit(0)), F.coalesce("review_priority", F.lit(0)), F.lit(0))


def disposition(least_risk: int = 80) -> Column:
    """What the funnel makes of a candidate; explorer candidates go by their validation."""
    level = c("evidence_level")
    explored = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ("validated", "explorer_promoted", "partially_validated", "explorer_partial"))), F.coalesce("validation", F.lit(""))), F.lit("explorer_unverified"))
    return cascade(
        [
            (c("origin") == "explorer", explored),
            (F.size(refutation_bases()) > 0, "deterministically_refuted"),
            (has_critical("coverage_gaps"), "coverage_insufficient"),
            ((level == "L2") & yes(c("chain_verified")), "deterministically_promoted_l2"),
            (blank(level) | (level != "L1"), "coverage_insufficient"),
            (c("authorization_status").isin("unprotected", "conditional") & yes(c("high_value")) & (risk() >= least_risk), "high_risk_uncertain"),
        ],
        "exposure_only",
    )


def uncertain() -> Column:
    """Whether a closed chain still leaves something open."""
    return (
        blank(c("authorization_status")) | c("authorization_status").isin("unknown", "conditional") | blank(c("guard_status")) | c("guard_status").isin("unknown", "present_partial")
        | blank(c("impact_status")) | c("impact_status").isin("unknown", "potential") | has_critical("blocking_gaps")
    )


def requires_ai(funnel: Column) -> Column:
    """Whether a candidate with this disposition needs an analysis at all."""
    level = c("evidence_level")
    return yes(
        F.when(yes(c("guard_blocked")), False)
        .when(yes(c("origin") == "explorer") & (funnel != "explorer_promoted"), False)
        .when(level == "L1", funnel.isin("high_risk_uncertain", "coverage_insufficient"))
        .when(blank(level) | (level != "L2") | (funnel == "deterministically_refuted"), False)
        .when(~yes(c("chain_verified")), True)
        .otherwise(uncertain())
    )


def undecidable() -> Column:
    """Whether no context could settle a candidate: only gaps about targets known at run time, and no fact to look at."""
    critical = F.filter(F.coalesce("blocking_gaps", F.array()), lambda g: F.coalesce(g["critical"], F.lit(True)))
    only = (F.size(critical) > 0) & F.forall(critical, lambda g: yes(g["code"].isin(*UNDECIDABLE_GAPS)))
    facts = yes(F.size("sinks") > 0) | c("sender_reachable").isNotNull() | c("call_site_exists").isNotNull()
    return ~yes(c("chain_verified")) & only & ~facts


def demotion() -> Column:
    """Why a flow counts as unproven: scope_unresolved, bulk_statistics_consumer or null."""
    return F.when(yes(c("chain_verified")), None).when((c("flow_kind") == "control_to_sink") & has_code("blocking_gaps", "CONTROL_SCOPE_UNRESOLVED"), "scope_unresolved").when(c("consumer_semantics") == "statistics", "bulk_statistics_consumer")


def coverage_allows(gaps: str, claim: str, explicit: Column | None = None) -> Column:
    """Whether gaps leave room for a claim (positive_proof or negative_proof). A stated completeness wins; gaps without
    an impact count if they are critical."""
    impact = lambda g: g["claim_impact"]
    stops = lambda g: yes(g[f"affects_{claim}"]) | yes(impact(g).isin(claim, "both")) | (impact(g).isNull() & F.coalesce(g["critical"], F.lit(True)))
    found = ~yes(F.exists(gaps, stops))
    return found if explicit is None else F.coalesce(explicit, found)


def confirmed_bases() -> Column:
    """The bases that an analysis names against a candidate (refutation_basis: an array), if deterministic facts confirm
    every one of them, else an empty array. An unknown basis, a fact that is missing, or no facts at all confirm nothing.

    Reads deterministic_facts (a struct of value_flow_reaches_sink_argument, sender_reachable, guard_status and
    authorization_status), guard_status, exported, provider_exported, target_registered, target_fixed, argument_constant,
    call_site_exists. Coverage is asked elsewhere: see refuting.
    """
    fact = lambda name: c("deterministic_facts").getField(name)
    tests = {
        "in_process_terminus": ~fact("value_flow_reaches_sink_argument"), "sender_unreachable": ~fact("sender_reachable"),
        "guard_fail_closed": yes(fact("guard_status") == "present_effective") | yes(c("guard_status") == "present_effective"),
        "non_exported_provider": yes(fact("authorization_status").isin(*PROTECTED)) | yes(~c("exported")) | yes(~c("provider_exported")),
        "fixed_local_target": yes(c("target_registered")) & yes(c("target_fixed")), "constant_sink_argument": c("argument_constant"), "no_real_call_site": ~c("call_site_exists"),
    }
    named = F.filter(F.coalesce("refutation_basis", F.array().cast("array<string>")), lambda b: ~blank(F.trim(b)))
    holds = lambda b: reduce(lambda a, x: a | x, [(b == code) & yes(test) for code, test in tests.items()])
    sound = c("deterministic_facts").isNotNull() & F.forall(named, holds)
    return F.when(sound, named).otherwise(F.array().cast("array<string>"))


def refuting(negative: Column) -> Column:
    """The bases against a candidate that count: the deterministic ones as far as coverage allows the negative proof (else
    only what the platform's meaning settles), and without any those that an analysis names and facts confirm."""
    bases = refutation_bases()
    allowed = F.when(negative, bases).otherwise(F.filter(bases, lambda b: b == "local_broadcast_intra_process"))
    return F.when((F.size(allowed) == 0) & negative, confirmed_bases()).otherwise(allowed)


def conflict(bases: Column) -> Column:
    """Whether an analysis contradicts itself: it refutes and yet says that the flaw holds, with no basis to settle it. That
    is a critical gap of its own (AI_VERDICT_FLAW_CONFLICT)."""
    return yes(c("verdict").isin(*REFUTING)) & yes(c("flaw_holds")) & (F.size(bases) == 0)


def severity(conflicting: Column | None = None) -> Column:
    """struct(severity, reason). The order of the cases matters; hints count only at the end and are capped where the
    impact is only potential. Gaps of the chain, of coverage and of the analysis count alike (ai_blocking_gaps), and so
    does an analysis at odds with itself. A null evidence_level counts as L1."""
    verified, flow, rule = yes(c("chain_verified")), F.coalesce("dataflow_status", F.lit("not_proven")), c("rule_id")
    auth, guard = F.coalesce("authorization_status", F.lit("unknown")), F.coalesce("guard_status", F.lit("unknown"))
    hint = F.when(c("severity_hint").isin(*[s for s in SEVERITY if s != "informational"]), c("severity_hint")).otherwise("pending")
    capped = F.when(flow.isin("intraprocedural", "interprocedural"), "medium").otherwise("pending")
    ceiling = F.try_element_at(F.create_map(*[F.lit(x) for pair in CEILING.items() for x in pair]), F.coalesce(rule, F.lit("")))
    open_ = has_critical("blocking_gaps") | has_critical("ai_blocking_gaps") | has_critical("coverage_gaps") | (F.lit(False) if conflicting is None else conflicting)
    made = lambda value, reason: F.struct((F.lit(value) if isinstance(value, str) else value).alias("severity"), F.lit(reason).alias("reason"))
    return cascade(
        [
            (c("evidence_decision") == "ai_false_positive", made("informational", "refuted_by_analysis_and_facts")),
            (c("evidence_decision") == "deterministically_refuted", made("informational", "refuted_by_facts")),
            (c("evidence_decision") == "blocked", made("pending", "guard_blocks_chain")),
            (F.coalesce("evidence_level", F.lit("L1")) == "L1", made("informational", "surface_only")),
            (open_, made("pending", "critical_gap")),
            (flow == "not_proven", made("pending", "dataflow_not_proven")),
            (c("analysis_status").isin("ai_failed", "ai_skipped") & ~verified, made("pending", "analysis_not_done")),
            (guard == "present_effective", made("informational", "effective_guard")),
            (auth.isin(*PROTECTED), made("informational", "protected")),
            (auth == "unknown", made("pending", "authorization_unknown")),
            (guard.isin("unknown", "present_partial"), made("pending", "guard_not_proven")),
            (verified & ceiling.isNotNull(), made(ceiling, "calibrated_ceiling")),
            (verified & yes(~c("target_registered")) & rule.isin(*LOW_IF_UNREGISTERED), made("low", "calibrated_ceiling")),
            ((F.coalesce("impact_status", F.lit("potential")) == "potential") & hint.isin("critical", "high"), made(capped, "impact_potential")),
        ],
        made(hint, "proven_flow_and_boundary"),
    )


def evidence_decision(bases: Column) -> Column:
    """What the evidence says, given the deterministic bases against the candidate (only those that coverage allows)."""
    verdict, refutes = c("verdict"), yes(c("verdict").isin(*REFUTING))
    valid, partly = blank(c("contract_failure")), blank(c("joint_failure"))
    likely = yes(c("flaw_holds")) & yes(c("entry_reachable"))
    proven = c("dataflow_status").isin("intraprocedural", "interprocedural", "verified")
    return cascade(
        [
            (yes(c("guard_blocked")) & ~refutes, "blocked"),
            (valid & refutes & (F.size(bases) > 0), "ai_false_positive"),
            (F.size(bases) > 0, "deterministically_refuted"),
            (refutes & yes(c("flaw_holds")), "unresolved"),
            (partly & likely & yes(verdict.isin("supports_candidate", "positive", "supported")) & yes(c("propagates")) & yes(c("takes_effect")) & yes(c("confidence") == "high") & yes(proven), "supported"),
            (partly & likely, "ai_likely_supported"),
            (partly & yes(~c("flaw_holds")) & ~has_critical("blocking_gaps"), "ai_likely_false_positive"),
            (~valid, "unresolved"),
            (c("evidence_level") == "L1", "exposure_only"),
            (yes(c("chain_verified")) & yes(proven) & ~blank(c("entry_method_id")), "supported"),
        ],
        "unresolved",
    )


def ai_open() -> Column:
    """Whether a required analysis is still to be done. Without a stated need, only a failed one is."""
    status = F.coalesce("analysis_status", F.lit("rule_only"))
    needed = F.coalesce(c("ai_required"), status.isin("ai_failed", "ai_skipped", "ai_incomplete", "ai_budget_deferred"))
    return needed & ~status.isin("ai_completed", "completed", "human_confirmed")


def review_state() -> Column:
    """struct(status, reason). Final decisions of people stay; a false positive needs a deterministic basis."""
    decided, made = c("evidence_decision"), lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    kept = F.struct(c("review_status").alias("status"), F.lit("preserved_manual_decision").alias("reason"))
    return cascade(
        [
            (c("review_status").isin(*TERMINAL_REVIEW), kept),
            ((decided == "ai_false_positive") & (F.size("false_positive_basis") > 0), made("ai_false_positive", "ai_refutation_with_deterministic_basis")),
            (ai_open(), made("pending_ai", "required_ai_analysis_not_completed")),
            (decided == "ai_likely_supported", made("pending_manual", "ai_likely_supported_needs_confirmation")),
            (decided == "ai_likely_false_positive", made("pending_manual", "ai_likely_false_positive_needs_confirmation")),
        ],
        made("pending_manual", "automatic_analysis_requires_manual_review"),
    )


def contracted(state: Column) -> Column:
    """A state in which an analysis that broke its contract even in parts is to be done again; final decisions stay."""
    again = F.struct(F.lit("pending_ai").alias("status"), F.lit("ai_evidence_contract_not_satisfied").alias("reason"))
    return F.when(~blank(c("joint_failure")) & ~yes(c("review_status").isin(*TERMINAL_REVIEW)), again).otherwise(state)
