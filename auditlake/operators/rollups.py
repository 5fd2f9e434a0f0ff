"""Dashboard roll-ups as aggregations per workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import lit
from ..rules.dimensions import CONTROL_STATES, FRAMEWORKS, SEVERITY_WEIGHTS

SATISFIED = "('VERIFIED_MACHINE', 'VERIFIED_SYSTEM', 'ATTESTED_HUMAN')"


def percent(part: str, whole: str, empty: int) -> str:
    """Rounded half up; ``empty`` when there is nothing to count."""
    return f"CASE WHEN {whole} > 0 THEN cast(floor({part} / {whole} * 100 + 0.5D) AS int) ELSE {empty} END"


def framework_coverage(standards: DataFrame, states: DataFrame, evidence: DataFrame, findings: DataFrame,
                       normalised: bool = False) -> DataFrame:
    """Coverage per (workspace, standard).

    The plain variant takes the text before the first dash of a control key as its framework, so
    keys of dashed frameworks and bare keys with a dash fall out, and bare keys without one are
    counted for the first standard. ``normalised`` resolves the key against the framework names.
    """
    names = "array(" + ", ".join(lit(f) for f in FRAMEWORKS) + ")"
    if normalised:
        framework = f"get(filter({names}, f -> startswith(control_id, concat(f, '-'))), 0)"
    else:
        framework = (
            "CASE WHEN contains(control_id, '-') THEN substring_index(control_id, '-', 1) "
            "ELSE coalesce(get(filter(standards, f -> contains(control_id, f)), 0), standards[0]) END"
        )
    # one short array per workspace; states and evidence are per-control rows
    from_states = states.join(standards, "workspace").selectExpr(
        "workspace", f"{framework} AS standard", f"int(state IN {SATISFIED}) AS satisfied")
    from_evidence = evidence.selectExpr(
        "workspace", "framework AS standard", "int(evidence_present AND NOT expiry_detected) AS satisfied")
    stated = from_states.unionByName(from_evidence).groupBy("workspace", "standard").agg(
        F.count(F.lit(1)).alias("total"), F.sum("satisfied").alias("satisfied"))
    known = states.select("workspace").union(evidence.select("workspace")).distinct()
    # findings are counted before the anti join, so only counts are shuffled
    fallback = (
        findings.select("workspace", F.explode("compliance_frameworks_affected").alias("standard"),
                        F.expr("int(control_pass_fail_status = 'PASS')").alias("satisfied"))
        .groupBy("workspace", "standard").agg(F.count(F.lit(1)).alias("total"), F.sum("satisfied").alias("satisfied"))
        .join(known, "workspace", "left_anti")
    )
    rows = standards.select("workspace", F.explode("standards").alias("standard"))
    return rows.join(stated.unionByName(fallback), ["workspace", "standard"], "left").selectExpr(
        "workspace", "standard", "coalesce(total, 0) AS total", "coalesce(satisfied, 0) AS satisfied",
        f"least(100, greatest(0, {percent('satisfied', 'total', 100)})) AS coverage")


def readiness(workspaces: DataFrame, states: DataFrame, evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts of the five states and the overall percentage; nothing at all is zero percent."""
    from_evidence = evidence.selectExpr(
        "workspace",
        "CASE WHEN evidence_present AND NOT expiry_detected THEN 'VERIFIED_SYSTEM' "
        "WHEN expiry_detected THEN 'EXPIRED_EVIDENCE' ELSE 'MISSING_EVIDENCE' END AS state")
    from_findings = findings.selectExpr(
        "workspace", "CASE control_pass_fail_status WHEN 'PASS' THEN 'VERIFIED_MACHINE' WHEN 'FAIL' THEN 'MISSING_EVIDENCE' END AS state")

    def tally(rows: DataFrame) -> DataFrame:
        return rows.groupBy("workspace").agg(*[F.expr(f"count_if(state = '{s}')").alias(s.lower()) for s in CONTROL_STATES])

    stated = tally(states.select("workspace", "state").unionByName(from_evidence))
    counts = stated.unionByName(tally(from_findings).join(stated.select("workspace"), "workspace", "left_anti"))
    names = [s.lower() for s in CONTROL_STATES]
    filled = workspaces.select("workspace").distinct().join(counts, "workspace", "left").na.fill(0, names)
    good = "(verified_machine + verified_system + attested_human)"
    return filled.selectExpr("workspace", *names, f"{percent(good, '(' + ' + '.join(names) + ')', 0)} AS readiness_percent")


CONTROL = "coalesce(nullif(control_id, ''), 'UNKNOWN')"
FRAMEWORK = "coalesce(get(compliance_frameworks_affected, 0), 'UNKNOWN')"


def _grouped(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"control": F.expr(CONTROL), "framework": F.expr(FRAMEWORK)})


def control_drilldown(findings: DataFrame) -> DataFrame:
    """Attributes of the first finding and the size of each (control, first framework) group."""
    first = F.min_by(F.struct(
        "control_category", "auditor_explanation", "evidence_hash", "control_pass_fail_status",
        "compliance_frameworks_affected"), "position")
    return (
        _grouped(findings).groupBy("workspace", "control", "framework")
        .agg(first.alias("f"), F.count(F.lit(1)).alias("findings_count"))
        .selectExpr(
            "workspace", "control AS control_id", "framework", "f.control_category AS control_category",
            "f.auditor_explanation AS description", "f.evidence_hash AS evidence_hash",
            "CASE WHEN f.control_pass_fail_status = 'PASS' THEN 'VERIFIED_MACHINE' ELSE 'MISSING_EVIDENCE' END AS state",
            "CASE WHEN lower(f.control_category) LIKE '%system%' OR lower(f.control_category) LIKE '%config%' "
            "THEN 'system' ELSE 'machine' END AS verification_method", "findings_count")
    )


def control_members(findings: DataFrame) -> DataFrame:
    """The findings of every drill-down group as rows, so that no group is collected into one value."""
    return _grouped(findings).selectExpr(
        "workspace", "control AS control_id", "framework", "position", "id", "file", "line", "snippet", "severity")


def control_evidence_view(findings: DataFrame) -> DataFrame:
    """Counts per (control, joined frameworks)."""
    return (
        findings.withColumns({
            "control": F.expr(CONTROL), "frameworks": F.array_join("compliance_frameworks_affected", ",")})
        .groupBy("workspace", "control", "frameworks")
        .agg(F.min_by(F.struct("control_category", "control_pass_fail_status", F.expr(FRAMEWORK).alias("framework")),
                      "position").alias("f"), F.count(F.lit(1)).alias("findings_count"))
        .selectExpr(
            "workspace", "control AS control_id", "frameworks", "f.framework AS framework",
            "f.control_category AS control_category",
            "CASE WHEN f.control_pass_fail_status = 'PASS' THEN 'VERIFIED_MACHINE' ELSE 'MISSING_EVIDENCE' END AS state",
            "f.control_pass_fail_status != 'FAIL' AS evidence_present", "findings_count")
    )


def control_state_tallies(view: DataFrame) -> DataFrame:
    return view.groupBy("workspace").pivot("state", CONTROL_STATES).agg(F.count(F.lit(1))).na.fill(0)


def compliance_summary(findings: DataFrame) -> DataFrame:
    """Failures, passes, pass rate, distinct frameworks, status at eighty percent."""
    counts = findings.groupBy("workspace").agg(
        F.count(F.lit(1)).alias("evidence_gaps"),
        F.expr("count_if(control_pass_fail_status = 'FAIL')").alias("control_failures"))
    names = (
        findings.select("workspace", F.explode("compliance_frameworks_affected").alias("framework")).distinct()
        .groupBy("workspace").agg(F.count(F.lit(1)).alias("frameworks_covered"))
    )
    rate = percent("(evidence_gaps - control_failures)", "evidence_gaps", 100)
    return counts.join(names, "workspace", "left").selectExpr(
        "workspace", "control_failures", "evidence_gaps - control_failures AS controls_verified",
        f"{rate} AS pass_rate", "coalesce(frameworks_covered, 0) AS frameworks_covered", "evidence_gaps",
        f"CASE WHEN {rate} >= 80 THEN 'Audit Ready' ELSE 'Evidence Review Required' END AS audit_status")


def severity_histogram(findings: DataFrame) -> DataFrame:
    """All four buckets for every workspace, empty ones included, from one aggregation."""
    counts = findings.groupBy("workspace").agg(
        *[F.expr(f"count_if(severity = '{s}')").alias(s) for s in SEVERITY_WEIGHTS])
    buckets = ", ".join(f"'{s.capitalize()}', {s}" for s in SEVERITY_WEIGHTS)
    return counts.selectExpr("workspace", f"stack({len(SEVERITY_WEIGHTS)}, {buckets}) AS (severity, findings)")


def framework_rank(framework: str = "framework") -> str:
    """Sort key: the fixed order, unknown names last."""
    names = "array(" + ", ".join(lit(f) for f in FRAMEWORKS) + ")"
    return f"CASE WHEN array_contains({names}, {framework}) THEN array_position({names}, {framework}) ELSE {len(FRAMEWORKS) + 1} END"


def findings_preview(findings: DataFrame, k: int = 6) -> DataFrame:
    """First findings of each report; positions are dense, so this is a filter and not a sort."""
    return findings.filter(F.col("position") <= k)


def newest(ledger: DataFrame, k: int) -> DataFrame:
    return ledger.orderBy(F.desc("created_at"), F.desc("id")).limit(k)
