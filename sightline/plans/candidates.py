"""The funnel over candidates: routes, refutation, disposition, identity, groups, severity, decisions, review states.

Orders are read as candidates: every field is an expression that Spark and DuckDB read alike, over o_orderkey and
o_custkey. A candidate has at most one gap of each kind and one sink, which is enough to tell all cases apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lattice
from ..operators import decision
from ..operators.tables import read
from .base import query


def pick(on: str, *values: str | None) -> str:
    """SQL that chooses a value (None is null) by a number."""
    arms = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE ({on}) % {len(values)} {arms} END"


K, C = "o_orderkey", "o_custkey"
FIELDS = {
    "auxiliary": f"{K} % 17 = 0",
    "component": pick(K, "activity", "service", "receiver", "provider"),
    "component_name": f"CASE WHEN {C} % 11 = 0 THEN NULL WHEN {C} % 13 = 0 THEN ' ' ELSE 'com.app.C' || CAST({C} % 5 AS VARCHAR(9)) END",
    "origin": f"CASE WHEN {K} % 10 = 3 THEN 'explorer' ELSE 'rule' END",
    "validation": pick(C, "validated", "partially_validated", "unverified", "pending", None),
    "rule_id": pick(f"{K} + {C}", "SERVICE_BINDER_CALLER_CHECK_MISSING", "PROVIDER_UNAUTHORIZED_QUERY", "ACTIVITY_EXTERNAL_ROUTE_INJECTION", "WEAK_CIPHER_ECB", "LOG_SENSITIVE_DATA"),
    "evidence_level": pick(f"{K} + 3 * {C}", "L1", "L2", "L2", "L1", "L2", "L2", "L3", None),
    "reachability_status": pick(C, "reachable", "conditional", None, "", "reachable", "not_exported", "reachable", "reachable", "unreachable"),
    "authorization_status": pick(f"{C} + {K} % 3", "unprotected", "conditional", "unprotected", "unknown", "protected", None, "unprotected", "strongly_protected", "conditional"),
    "guard_status": pick(f"{K} % 13 + {C}", "absent", "absent", "unknown", "present_partial", "absent", "present_bypassable", "present_effective", None, "absent"),
    "dataflow_status": pick(f"{K} % 7 + {C} % 5", "not_proven", "intraprocedural", "interprocedural", "verified", "verified", None),
    "impact_status": pick(f"{K} + {C} % 4", "potential", "proven", "proven", "unknown", None, "proven"),
    "analysis_status": pick(f"{K} % 11 + {C} % 3", "ai_completed", "ai_failed", "ai_skipped", "ai_incomplete", "rule_only", "human_confirmed", None, "ai_completed"),
    "severity_hint": pick(f"{K} % 23", "high", "critical", "medium", "low", "informational", "odd", None),
    "chain_verified": f"CASE {K} % 5 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END",
    "target_registered": f"CASE {C} % 3 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END",
    "flow_kind": pick(f"{C} % 31", "source_to_sink", "control_to_sink", "source_to_sink", "capability_effect", "return_disclosure", "source_to_sink", "source_to_sink"),
    "consumer_semantics": pick(f"{K} % 29", "statistics", None, None, None, None),
    "input_control": pick(f"{K} % 41", "local_broadcast_isolated", *[None] * 19),
    "sender_reachable": f"CASE {K} % 37 WHEN 0 THEN FALSE WHEN 1 THEN TRUE ELSE NULL END",
    "call_site_exists": f"CASE {K} % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END",
    "rule_premise_valid": f"CASE {C} % 43 WHEN 0 THEN FALSE ELSE NULL END",
    "rule_predicate_satisfied": f"CASE {C} % 53 WHEN 1 THEN FALSE WHEN 2 THEN TRUE ELSE NULL END",
    "rule_precondition_verified": f"CASE {K} % 61 WHEN 1 THEN FALSE WHEN 2 THEN TRUE ELSE NULL END",
    "ai_gap": pick(f"{K} % 83", *[None] * 6, "HARM_NOT_PROVEN"),
    "ai_gap_critical": f"CASE {C} % 4 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END",
    "named_basis": pick(f"{K} % 89 + {C}", None, "in_process_terminus", "sender_unreachable", "guard_fail_closed", "non_exported_provider", "fixed_local_target", "constant_sink_argument", "no_real_call_site", "made_up"),
    "second_basis": pick(f"{C} % 97", None, None, None, "constant_sink_argument", ""),
    "has_facts": f"{K} % 7 > 0",
    "reaches_argument": f"CASE {C} % 5 WHEN 0 THEN FALSE WHEN 1 THEN TRUE ELSE NULL END",
    "fact_guard": pick(f"{K} % 11", "present_effective", "absent", None),
    "fact_authorization": pick(f"{K} % 13", "protected", None, "unknown"),
    "exported": f"CASE {K} % 9 WHEN 0 THEN FALSE ELSE TRUE END",
    "provider_exported": f"CASE {C} % 17 WHEN 0 THEN FALSE ELSE NULL END",
    "target_fixed": f"{C} % 2 = 0",
    "argument_constant": f"CASE {K} % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END",
    "real_sink_verified": f"CASE {K} % 47 WHEN 0 THEN FALSE WHEN 1 THEN TRUE ELSE NULL END",
    "receiver_text": pick(f"{K} % 53", *["this"] * 5, "LocalBroadcastManager.get(x)", "EventBusUtils", "EventBus", None, None),
    "high_value": f"{C} % 2 = 0",
    "guard_blocked": f"{K} % 59 = 0",
    "risk_score": f"CASE WHEN {K} % 6 = 0 THEN NULL ELSE {C} % 100 END",
    "review_priority": f"{K} % 90",
    "gap": pick(f"{K} % 19 + {C} % 7", None, None, "CONTROL_SCOPE_UNRESOLVED", None, "SYMBOL_TARGET_AMBIGUOUS", "DATAFLOW_LIMIT", None, None),
    "gap_critical": f"CASE {K} % 4 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END",
    "coverage_gap": pick(f"{C} % 61", "FILE_SKIPPED", *[None] * 6),
    "coverage_critical": f"CASE {K} % 3 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END",
    "coverage_impact": pick(f"{K}", None, "positive_proof", "negative_proof", "both"),
    "negative_complete": f"CASE {C} % 9 WHEN 0 THEN FALSE WHEN 1 THEN TRUE ELSE NULL END",
    "verdict": pick(f"{K} % 67 + {C}", "refutes_candidate", "supports_candidate", "supported", "unresolved", None),
    "flaw_holds": f"CASE ({K} + {C}) % 4 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END",
    "entry_reachable": f"({K} + {C}) % 3 > 0",
    "propagates": f"{K} % 2 = 0",
    "takes_effect": f"{C} % 3 > 0",
    "confidence": pick(f"{K} % 71", "high", "high", "medium", None),
    "contract_failure": pick(f"{K} % 73", None, None, None, "INVALID_EVIDENCE_REFS", "AI_ANALYSIS_INCOMPLETE", ""),
    "joint_failure": pick(f"{K} % 73", None, None, None, None, "AI_ANALYSIS_INCOMPLETE", ""),
    "entry_method_id": pick(f"{C} % 5", "m", None, ""),
    "ai_required": f"CASE {C} % 4 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END",
    "review_status": pick(f"{K} % 79", "confirmed", "manual_false_positive", "pending_manual", None, None, None, None),
}
#: One reading of the fields in SQL. Text comparisons with LIKE stand for the patterns of the rules.
SQL = f"c AS (SELECT {K} AS candidate, {C} AS customer, " + ", ".join(f"{sql} AS {name}" for name, sql in FIELDS.items()) + " FROM orders)"
_TRUE = "coalesce({}, FALSE)".format
_GAP, _COVER = "(gap IS NOT NULL AND coalesce(gap_critical, TRUE))", "(coverage_gap IS NOT NULL AND coalesce(coverage_critical, TRUE))"
_NEGATIVE = "coalesce(negative_complete, NOT (coverage_gap IS NOT NULL AND (coalesce(coverage_impact IN ('negative_proof', 'both'), FALSE) OR (coverage_impact IS NULL AND coalesce(coverage_critical, TRUE)))))"
_POSITIVE = _NEGATIVE[_NEGATIVE.index("NOT (") : -1].replace("'negative_proof'", "'positive_proof'")
_BASES = f"""list_filter([
    CASE WHEN authorization_status IN ('protected', 'strongly_protected') THEN 'strong_permission' END,
    CASE WHEN guard_status = 'present_effective' THEN 'effective_guard' END,
    CASE WHEN reachability_status IN ('not_reachable', 'unreachable', 'internal_only', 'not_exported') THEN 'not_reachable' END,
    CASE WHEN sender_reachable = FALSE THEN 'sender_unreachable' END,
    CASE WHEN flow_kind = 'control_to_sink' AND coalesce(gap, '') <> 'CONTROL_SCOPE_UNRESOLVED' THEN 'in_process_terminus' END,
    CASE WHEN rule_premise_valid = FALSE OR rule_predicate_satisfied = FALSE OR rule_precondition_verified = FALSE THEN 'rule_premise_refuted' END,
    CASE WHEN real_sink_verified = FALSE OR (evidence_level = 'L2' AND receiver_text IS NULL AND NOT coalesce(chain_verified, FALSE)) THEN 'no_real_sink' END,
    CASE WHEN receiver_text IN ('LocalBroadcastManager.get(x)', 'EventBus') OR input_control = 'local_broadcast_isolated' THEN 'local_broadcast_intra_process' END
], lambda b: b IS NOT NULL)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate table: the fields as columns, gaps and sinks as arrays."""
    rows = read(spark, sf_dir, "orders").select(F.col(K).alias("candidate"), F.col(C).alias("customer"), *[F.expr(sql).alias(name) for name, sql in FIELDS.items()])
    kind = "array<struct<code:string,critical:boolean,claim_impact:string,affects_positive_proof:boolean,affects_negative_proof:boolean>>"
    none, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")

    def gaps(code: str, critical: str, impact) -> F.Column:
        one = F.struct(F.col(code).alias("code"), F.col(critical).alias("critical"), impact.alias("claim_impact"), flag.alias("affects_positive_proof"), flag.alias("affects_negative_proof"))
        return F.when(F.col(code).isNotNull(), F.array(one)).cast(kind)

    return rows.withColumns({
        "blocking_gaps": gaps("gap", "gap_critical", none),
        "coverage_gaps": gaps("coverage_gap", "coverage_critical", F.col("coverage_impact")),
        "ai_blocking_gaps": gaps("ai_gap", "ai_gap_critical", none),
        "refutation_basis": F.when(F.col("named_basis").isNotNull(), F.array("named_basis", "second_basis")),
        "deterministic_facts": F.when(F.col("has_facts"), F.struct(F.col("reaches_argument").alias("value_flow_reaches_sink_argument"), "sender_reachable", F.col("fact_guard").alias("guard_status"), F.col("fact_authorization").alias("authorization_status"))),
        "sinks": F.when(F.col("receiver_text").isNotNull(), F.array(F.struct("receiver_text"))),
    })


@query(f"""
    WITH {SQL}, r AS (SELECT candidate, CASE
        WHEN auxiliary THEN 'none|AUXILIARY_CANDIDATE' WHEN evidence_level = 'L2' THEN 'l2_review|L2_REVIEW_ELIGIBLE'
        WHEN evidence_level IS NULL OR evidence_level <> 'L1' THEN 'none|EVIDENCE_LEVEL_UNKNOWN'
        WHEN reachability_status IN ('not_exported', 'unreachable') THEN 'none|L1_UNREACHABLE'
        WHEN authorization_status IN ('protected', 'strongly_protected') THEN 'none|L1_PROTECTED'
        WHEN trim(coalesce(component_name, '')) = '' THEN 'none|L1_COMPONENT_NAME_MISSING' ELSE 'l1_triage|L1_TRIAGE_ELIGIBLE' END AS pair FROM c)
    SELECT candidate, split_part(pair, '|', 1) <> 'none' AS eligible, split_part(pair, '|', 1) AS route, split_part(pair, '|', 2) AS reason FROM r
""")
def candidate_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT6: which candidates an analysis may see, by which route and why."""
    return candidates(spark, sf_dir).select("candidate", decision.precheck().alias("r")).select("candidate", "r.*")


@query(f"WITH {SQL} SELECT candidate, array_to_string({_BASES}, ',') AS bases FROM c")
def refutation_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN3: deterministic reasons against each candidate."""
    return candidates(spark, sf_dir).select("candidate", F.array_join(decision.refutation_bases(), ",").alias("bases"))


_DISPOSITION = f"""CASE
        WHEN origin = 'explorer' THEN CASE validation WHEN 'validated' THEN 'explorer_promoted' WHEN 'partially_validated' THEN 'explorer_partial' ELSE 'explorer_unverified' END
        WHEN len({_BASES}) > 0 THEN 'deterministically_refuted' WHEN {_COVER} THEN 'coverage_insufficient'
        WHEN evidence_level = 'L2' AND coalesce(chain_verified, FALSE) THEN 'deterministically_promoted_l2'
        WHEN evidence_level IS NULL OR evidence_level <> 'L1' THEN 'coverage_insufficient'
        WHEN authorization_status IN ('unprotected', 'conditional') AND high_value AND greatest(coalesce(risk_score, 0), review_priority) >= 80 THEN 'high_risk_uncertain'
        ELSE 'exposure_only' END"""
_UNCERTAIN = f"""(authorization_status IS NULL OR authorization_status IN ('unknown', 'conditional') OR guard_status IS NULL OR guard_status IN ('unknown', 'present_partial')
        OR impact_status IS NULL OR impact_status IN ('unknown', 'potential') OR {_GAP})"""
_REQUIRES = f"""CASE WHEN guard_blocked THEN FALSE WHEN origin = 'explorer' AND disposition <> 'explorer_promoted' THEN FALSE
        WHEN evidence_level = 'L1' THEN disposition IN ('high_risk_uncertain', 'coverage_insufficient') WHEN evidence_level IS NULL OR evidence_level <> 'L2' OR disposition = 'deterministically_refuted' THEN FALSE
        WHEN NOT coalesce(chain_verified, FALSE) THEN TRUE ELSE {_UNCERTAIN} END"""
_UNDECIDABLE = f"""(NOT coalesce(chain_verified, FALSE) AND gap = 'SYMBOL_TARGET_AMBIGUOUS' AND {_GAP} AND receiver_text IS NULL AND sender_reachable IS NULL AND call_site_exists IS NULL)"""
_DEMOTION = """CASE WHEN coalesce(chain_verified, FALSE) THEN NULL WHEN flow_kind = 'control_to_sink' AND gap = 'CONTROL_SCOPE_UNRESOLVED' THEN 'scope_unresolved'
        WHEN consumer_semantics = 'statistics' THEN 'bulk_statistics_consumer' END"""


@query(f"""
    WITH {SQL}, d AS (SELECT *, {_DISPOSITION} AS disposition FROM c)
    SELECT candidate, disposition, {_REQUIRES} AS requires_ai, coalesce({_UNDECIDABLE}, FALSE) AS undecidable, {_DEMOTION} AS demotion,
           greatest(coalesce(risk_score, 0), review_priority, 0)::BIGINT AS risk FROM d
""")
def funnel_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN2, FN4, SP40: disposition, need of an analysis, demotion and risk of each candidate."""
    rows = candidates(spark, sf_dir).withColumn("disposition", decision.disposition())
    return rows.select(
        "candidate", "disposition", decision.requires_ai(F.col("disposition")).alias("requires_ai"), decision.undecidable().alias("undecidable"), decision.demotion().alias("demotion"), decision.risk().cast("long").alias("risk")
    )


@query(f"""WITH {SQL} SELECT candidate, {_POSITIVE} AS allows_positive, {_NEGATIVE} AS allows_negative FROM c""")
def coverage_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN7: which claims the coverage of each candidate allows."""
    return candidates(spark, sf_dir).select(
        "candidate", decision.coverage_allows("coverage_gaps", "positive_proof").alias("allows_positive"), decision.coverage_allows("coverage_gaps", "negative_proof", F.col("negative_complete")).alias("allows_negative")
    )


_CONFLICT = "(coalesce(verdict = 'refutes_candidate', FALSE) AND flaw_holds AND len(bases) = 0)"
_AI_GAP = "(ai_gap IS NOT NULL AND coalesce(ai_gap_critical, TRUE))"
_SEVERITY_PAIR = f"""CASE WHEN decision = 'ai_false_positive' THEN 'informational|refuted_by_analysis_and_facts' WHEN decision = 'deterministically_refuted' THEN 'informational|refuted_by_facts' WHEN decision = 'blocked' THEN 'pending|guard_blocks_chain'
        WHEN coalesce(evidence_level, 'L1') = 'L1' THEN 'informational|surface_only' WHEN {_GAP} OR {_AI_GAP} OR {_COVER} OR coalesce({_CONFLICT}, FALSE) THEN 'pending|critical_gap'
        WHEN coalesce(dataflow_status, 'not_proven') = 'not_proven' THEN 'pending|dataflow_not_proven' WHEN analysis_status IN ('ai_failed', 'ai_skipped') AND NOT coalesce(chain_verified, FALSE) THEN 'pending|analysis_not_done'
        WHEN guard_status = 'present_effective' THEN 'informational|effective_guard' WHEN authorization_status IN ('protected', 'strongly_protected') THEN 'informational|protected'
        WHEN coalesce(authorization_status, 'unknown') = 'unknown' THEN 'pending|authorization_unknown' WHEN coalesce(guard_status, 'unknown') IN ('unknown', 'present_partial') THEN 'pending|guard_not_proven'
        WHEN chain_verified AND rule_id = 'SERVICE_BINDER_CALLER_CHECK_MISSING' THEN 'high|calibrated_ceiling' WHEN chain_verified AND rule_id = 'PROVIDER_UNAUTHORIZED_QUERY' THEN 'medium|calibrated_ceiling'
        WHEN chain_verified AND target_registered = FALSE AND rule_id = 'ACTIVITY_EXTERNAL_ROUTE_INJECTION' THEN 'low|calibrated_ceiling'
        WHEN coalesce(impact_status, 'potential') = 'potential' AND severity_hint IN ('high', 'critical') THEN CASE WHEN dataflow_status IN ('intraprocedural', 'interprocedural') THEN 'medium' ELSE 'pending' END || '|impact_potential'
        ELSE CASE WHEN severity_hint IN ('critical', 'high', 'medium', 'low') THEN severity_hint ELSE 'pending' END || '|proven_flow_and_boundary' END"""
_SEVERITY = f"split_part({_SEVERITY_PAIR}, '|', 1)"
_CONFIRMED = """coalesce(CASE {0} WHEN 'in_process_terminus' THEN NOT reaches_argument WHEN 'sender_unreachable' THEN NOT sender_reachable
        WHEN 'guard_fail_closed' THEN coalesce(fact_guard = 'present_effective', FALSE) OR coalesce(guard_status = 'present_effective', FALSE)
        WHEN 'non_exported_provider' THEN coalesce(fact_authorization = 'protected', FALSE) OR NOT exported OR coalesce(NOT provider_exported, FALSE)
        WHEN 'fixed_local_target' THEN target_registered AND target_fixed WHEN 'constant_sink_argument' THEN argument_constant WHEN 'no_real_call_site' THEN NOT call_site_exists ELSE FALSE END, FALSE)""".format
_SECOND = "coalesce(second_basis, '')"
_NAMED = f"CASE WHEN named_basis IS NOT NULL AND has_facts AND {_CONFIRMED('named_basis')} AND ({_SECOND} = '' OR {_CONFIRMED('second_basis')}) THEN CASE WHEN {_SECOND} = '' THEN [named_basis] ELSE [named_basis, second_basis] END ELSE [] END"
_ALLOWED = f"CASE WHEN {_NEGATIVE} THEN CASE WHEN len({_BASES}) > 0 THEN {_BASES} ELSE {_NAMED} END ELSE list_filter({_BASES}, lambda b: b = 'local_broadcast_intra_process') END"
_REFUTES = "coalesce(verdict = 'refutes_candidate', FALSE)"
_PROVEN = "coalesce(dataflow_status IN ('intraprocedural', 'interprocedural', 'verified'), FALSE)"
_DECISION = f"""CASE WHEN guard_blocked AND NOT {_REFUTES} THEN 'blocked' WHEN coalesce(contract_failure, '') = '' AND {_REFUTES} AND len(bases) > 0 THEN 'ai_false_positive'
        WHEN len(bases) > 0 THEN 'deterministically_refuted' WHEN {_REFUTES} AND flaw_holds THEN 'unresolved'
        WHEN coalesce(joint_failure, '') = '' AND flaw_holds AND entry_reachable AND verdict IN ('supports_candidate', 'supported') AND propagates AND takes_effect AND confidence = 'high' AND {_PROVEN} THEN 'supported'
        WHEN coalesce(joint_failure, '') = '' AND flaw_holds AND entry_reachable THEN 'ai_likely_supported' WHEN coalesce(joint_failure, '') = '' AND NOT flaw_holds AND NOT {_GAP} THEN 'ai_likely_false_positive'
        WHEN coalesce(contract_failure, '') <> '' THEN 'unresolved' WHEN evidence_level = 'L1' THEN 'exposure_only'
        WHEN chain_verified AND {_PROVEN} AND coalesce(entry_method_id, '') <> '' THEN 'supported' ELSE 'unresolved' END"""
_OPEN = "(coalesce(ai_required, coalesce(analysis_status, 'rule_only') IN ('ai_failed', 'ai_skipped', 'ai_incomplete', 'ai_budget_deferred')) AND coalesce(analysis_status, 'rule_only') NOT IN ('ai_completed', 'human_confirmed'))"
_REVIEW = f"""CASE WHEN review_status IN ('confirmed', 'manual_false_positive') THEN review_status || '|preserved_manual_decision'
        WHEN decision = 'ai_false_positive' THEN 'ai_false_positive|ai_refutation_with_deterministic_basis' WHEN {_OPEN} THEN 'pending_ai|required_ai_analysis_not_completed'
        WHEN decision = 'ai_likely_supported' THEN 'pending_manual|ai_likely_supported_needs_confirmation' WHEN decision = 'ai_likely_false_positive' THEN 'pending_manual|ai_likely_false_positive_needs_confirmation'
        ELSE 'pending_manual|automatic_analysis_requires_manual_review' END"""
_DECIDED = f"b AS (SELECT *, {_ALLOWED} AS bases FROM c), d AS (SELECT *, {_DECISION} AS decision FROM b)"


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with false_positive_basis and evidence_decision."""
    negative = decision.coverage_allows("coverage_gaps", "negative_proof", F.col("negative_complete"))
    rows = candidates(spark, sf_dir).withColumn("bases", decision.refuting(negative))
    rows = rows.withColumn("evidence_decision", decision.evidence_decision(F.col("bases")))
    return rows.withColumn("false_positive_basis", F.when(F.col("evidence_decision") == "ai_false_positive", F.col("bases")).otherwise(F.array().cast("array<string>")))


@query(f"WITH {SQL}, {_DECIDED} SELECT candidate, decision AS evidence_decision, CASE WHEN decision = 'ai_false_positive' THEN array_to_string(bases, ',') ELSE '' END AS basis FROM d")
def evidence_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN11, FN12, FN13: what evidence, coverage and an analysis together say about each candidate."""
    return decided(spark, sf_dir).select("candidate", "evidence_decision", F.array_join("false_positive_basis", ",").alias("basis"))


@query(f"WITH {SQL}, {_DECIDED} SELECT candidate, {_SEVERITY} AS severity, split_part({_SEVERITY_PAIR}, '|', 2) AS reason FROM d")
def finding_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN10: severity after the evidence decision, and why."""
    return decided(spark, sf_dir).select("candidate", decision.severity(decision.conflict(F.col("bases"))).alias("s")).select("candidate", "s.*")


@query(f"""WITH {SQL}, {_DECIDED}, r AS (SELECT *, {_REVIEW} AS pair FROM d)
    SELECT candidate, CASE WHEN coalesce(joint_failure, '') <> '' AND coalesce(review_status, '') NOT IN ('confirmed', 'manual_false_positive') THEN 'pending_ai' ELSE split_part(pair, '|', 1) END AS status,
           CASE WHEN coalesce(joint_failure, '') <> '' AND coalesce(review_status, '') NOT IN ('confirmed', 'manual_false_positive') THEN 'ai_evidence_contract_not_satisfied' ELSE split_part(pair, '|', 2) END AS reason FROM r
""")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN14: the one review state of each candidate."""
    return decided(spark, sf_dir).select("candidate", decision.contracted(decision.review_state()).alias("s")).select("candidate", "s.*")


@query(f"""WITH {SQL}, {_DECIDED}, r AS (SELECT *, coalesce(review_status, split_part({_REVIEW}, '|', 1)) AS status, {_SEVERITY} AS severity FROM d)
    SELECT component, component_name, count(*) AS n_members,
           ['unprotected', 'conditional', 'unknown', 'protected', 'strongly_protected'][min(CASE coalesce(authorization_status, 'unknown') WHEN 'unprotected' THEN 1 WHEN 'conditional' THEN 2 WHEN 'unknown' THEN 3 WHEN 'protected' THEN 4 ELSE 5 END)] AS authorization_status,
           CASE WHEN bool_or(coalesce(guard_status, 'unknown') = 'unknown') THEN 'unknown' WHEN bool_or(guard_status = 'present_partial') THEN 'present_partial' WHEN bool_or(guard_status = 'present_bypassable') THEN 'present_bypassable'
                WHEN bool_or(guard_status = 'absent') AND bool_or(guard_status = 'present_effective') THEN 'present_bypassable' WHEN bool_or(guard_status = 'absent') THEN 'absent' ELSE 'present_effective' END AS guard_status,
           CASE WHEN bool_or(analysis_status IN ('ai_failed', 'ai_skipped', 'ai_incomplete')) AND bool_or(analysis_status IN ('ai_completed', 'human_confirmed')) THEN 'ai_partial'
                WHEN bool_or(analysis_status = 'ai_failed') THEN 'ai_failed' WHEN bool_or(analysis_status = 'ai_incomplete') THEN 'ai_incomplete' WHEN bool_or(analysis_status = 'ai_skipped') THEN 'ai_skipped'
                WHEN bool_or(analysis_status = 'human_confirmed') THEN 'human_confirmed' WHEN bool_or(analysis_status = 'ai_completed') THEN 'ai_completed' ELSE 'rule_only' END AS analysis_status,
           CASE WHEN bool_or(status = 'confirmed') THEN 'confirmed' WHEN bool_or(status = 'pending_ai') THEN 'pending_ai' WHEN bool_or(status = 'pending_manual') THEN 'pending_manual'
                WHEN bool_and(status = 'ai_false_positive') THEN 'ai_false_positive' WHEN bool_and(status = 'manual_false_positive') THEN 'manual_false_positive' ELSE 'pending_manual' END AS review_status,
           CASE WHEN count(DISTINCT decision) = 1 THEN min(decision) ELSE 'mixed' END AS evidence_decision,
           max(CASE coalesce(dataflow_status, 'not_proven') WHEN 'not_proven' THEN 0 WHEN 'intraprocedural' THEN 1 WHEN 'interprocedural' THEN 2 ELSE 3 END) AS best_flow
    FROM r WHERE NOT auxiliary GROUP BY ALL
""")
def status_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3 to AG7: the statuses of the members of each component merged."""
    rows = decided(spark, sf_dir).where(~F.col("auxiliary")).withColumn("status", F.coalesce("review_status", decision.review_state()["status"]))
    flows = ("not_proven", "intraprocedural", "interprocedural", "verified")
    return rows.groupBy("component", "component_name").agg(
        F.count(F.lit(1)).alias("n_members"), lattice.least(F.col("authorization_status"), lattice.AUTHORIZATION).alias("authorization_status"),
        lattice.guard(F.col("guard_status")).alias("guard_status"), lattice.analysis(F.col("analysis_status")).alias("analysis_status"),
        lattice.review(F.col("status")).alias("review_status"), lattice.one_or_mixed(F.col("evidence_decision"), "unresolved").alias("evidence_decision"),
        lattice.rank(lattice.strongest(F.col("dataflow_status"), flows), flows).alias("best_flow"),
    )
