"""Control states from findings, evidence and attestations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..rules.dimensions import CONTROLS
from ..functions.text import lit
from .dims import method_case
from .evidence import ORDER

BY_METHOD = (
    "CASE {m} WHEN 'machine' THEN 'VERIFIED_MACHINE' WHEN 'configuration' THEN 'VERIFIED_SYSTEM' "
    "WHEN 'human_attestation' THEN 'ATTESTED_HUMAN' ELSE 'MISSING_EVIDENCE' END"
)


def evidence_state(method: str = "verification_method", present: str = "evidence_present",
                   expired: str = "expiry_detected") -> str:
    """State of one piece of evidence as SQL text; ``present`` null means no evidence."""
    return (
        f"CASE WHEN {present} IS NULL THEN 'MISSING_EVIDENCE' WHEN {expired} THEN 'EXPIRED_EVIDENCE' "
        f"WHEN NOT {present} THEN 'MISSING_EVIDENCE' ELSE {BY_METHOD.format(m=method)} END"
    )


def report_states(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(workspace, control key, state) with the report's own keys.

    Findings use the mapped id, evidence the bare one; both can occur for one control. Present
    evidence wins and its last row counts; otherwise a finding; otherwise the first evidence row.
    """
    order = F.struct("file", F.coalesce("line", F.lit(-1)).alias("line"), "type", "snippet")
    framework = (
        "CASE WHEN contains(control_id, '-') THEN substring_index(control_id, '-', 1) "
        "ELSE get(compliance_frameworks_affected, 0) END"
    )
    bare = "CASE WHEN contains(control_id, '-') THEN substring(control_id, locate('-', control_id) + 1) ELSE control_id END"
    method = method_case("fw", "ctrl")
    from_findings = (
        findings.filter("control_id != 'UNKNOWN'").withColumn("ord", order)
        .withColumns({"fw": F.expr(framework), "ctrl": F.expr(bare)}).filter("fw IS NOT NULL")
        .withColumn("state", F.expr(
            f"CASE WHEN {method} IS NULL OR control_pass_fail_status = 'FAIL' THEN 'MISSING_EVIDENCE' "
            f"WHEN {method} = 'machine' THEN 'VERIFIED_MACHINE' WHEN {method} = 'configuration' THEN 'VERIFIED_SYSTEM' END"))
        .filter("state IS NOT NULL")
        .groupBy("workspace", "control_id").agg(F.max_by("state", "ord").alias("finding_state"))
    )
    known = evidence.withColumn("method", F.expr(method_case("framework", "control_id"))).filter("method IS NOT NULL")
    place = F.struct(ORDER[0], "evidence_source", *ORDER[1:])
    from_evidence = (
        known.withColumns({"state": F.expr(evidence_state("method")), "place": place})
        .groupBy("workspace", "control_id").agg(
            F.expr("max_by(state, place) FILTER (WHERE evidence_present)").alias("present_state"),
            F.expr("min_by(state, place)").alias("first_state"))
    )
    return from_findings.join(from_evidence, ["workspace", "control_id"], "full").select(
        "workspace", "control_id", F.coalesce("present_state", "finding_state", "first_state").alias("state"))


def states_map(states: DataFrame) -> DataFrame:
    """One map per workspace; its keys are bounded by the catalogue."""
    return states.groupBy("workspace").agg(
        F.expr("map_from_entries(array_sort(collect_list(struct(control_id, state))))").alias("control_states"))


def resolve_states(workspaces: DataFrame, findings: DataFrame, evidence: DataFrame, attestations: DataFrame,
                   as_of: str) -> DataFrame:
    """Exactly one state for every catalogue control of every workspace.

    Valid evidence counts by its verification method, then a valid human attestation; evidence or
    attestations that have run out leave the control expired; all else is missing.
    """
    rows = "array(" + ", ".join(
        f"named_struct('framework', {lit(c[0])}, 'control_id', {lit(c[1])}, 'verification_method', {lit(c[4])})"
        for c in CONTROLS) + ")"
    grid = workspaces.select("workspace").distinct().selectExpr("workspace", f"inline({rows})")
    seen = evidence.groupBy("workspace", "framework", "control_id").agg(
        F.expr("bool_or(evidence_present AND NOT expiry_detected)").alias("valid_evidence"),
        F.expr("bool_or(expiry_detected)").alias("expired_evidence"))
    # one row per catalogue control at most, so this side is bounded
    attested = attestations.filter(" OR ".join(
        f"(framework = {lit(c[0])} AND control_id = {lit(c[1])})" for c in CONTROLS)).groupBy(
        "framework", "control_id").agg(F.max("expires_at").alias("attested_until"))
    failing = findings.filter("control_pass_fail_status = 'FAIL'").groupBy("workspace", "control_id").agg(
        F.count(F.lit(1)).alias("open_findings")).withColumnRenamed("control_id", "control_key")
    grid = grid.withColumn("control_key", F.concat_ws("-", "framework", "control_id"))
    now = f"timestamp'{as_of}'"
    return (
        grid.join(seen, ["workspace", "framework", "control_id"], "left")
        .join(F.broadcast(attested), ["framework", "control_id"], "left")
        .join(failing, ["workspace", "control_key"], "left")
        .selectExpr(
            "workspace", "framework", "control_id", "verification_method",
            f"""CASE WHEN valid_evidence THEN {BY_METHOD.format(m='verification_method')}
                     WHEN attested_until IS NOT NULL AND NOT {now} > attested_until THEN 'ATTESTED_HUMAN'
                     WHEN expired_evidence OR attested_until IS NOT NULL THEN 'EXPIRED_EVIDENCE'
                     ELSE 'MISSING_EVIDENCE' END AS state""",
            "coalesce(open_findings, 0) AS open_findings")
    )
