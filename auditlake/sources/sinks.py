"""Sinks: report documents, CSV and SARIF results. The ledger is in ``ledger``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.evidence import ORDER
from ..operators.finalize import EMPTY_ROOT, merkle_roots, severity_metrics, standards, with_position
from ..operators.states import report_states, states_map

PART_ROWS = 10_000
VERSION = "1.0"


def report_documents(workspaces: DataFrame, findings: DataFrame, evidence: DataFrame, scan_time: str,
                     part_rows: int = PART_ROWS) -> DataFrame:
    """Nested report documents, ``parts`` per workspace.

    A document holds at most ``part_rows`` findings and evidence rows, so a workspace of any size is
    written whole without one task holding all of it; every part repeats the small header.
    """
    step = f"cast((position - 1) div {part_rows} AS int)"
    placed = with_position(evidence, ["workspace"], [F.col(c) for c in (ORDER[0], "evidence_source", *ORDER[1:])])
    finding = F.struct(
        "position", "id", "type", "file", "line", "snippet", "severity", "confidence", "evidence_hash",
        "compliance_frameworks_affected", "control_id", "control_category", "control_pass_fail_status",
        "required_evidence_missing", "auditor_explanation", "control_state")
    finding_parts = findings.groupBy("workspace", F.expr(step).alias("part")).agg(
        F.sort_array(F.collect_list(finding)).alias("found"))
    item = F.struct("position", "control_id", "framework", "evidence_type", "evidence_present", "evidence_source",
                    "expiry_detected")
    evidence_parts = placed.groupBy("workspace", F.expr(step).alias("part")).agg(
        F.sort_array(F.collect_list(item)).alias("proof"))
    last = [t.groupBy("workspace").agg(F.max("position").alias(n)) for t, n in ((findings, "f_last"), (placed, "e_last"))]
    parts = f"greatest(1, cast(ceil(greatest(coalesce(f_last, 0), coalesce(e_last, 0)) / {part_rows}) AS int))"
    header = (
        workspaces.select("workspace").distinct()
        .join(last[0], "workspace", "left").join(last[1], "workspace", "left").withColumn("parts", F.expr(parts))
        .join(standards(findings), "workspace", "left")
        .join(states_map(report_states(findings, placed)), "workspace", "left")
        .join(severity_metrics(findings), "workspace", "left")
        .join(merkle_roots(findings), "workspace", "left")
        .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("critical", "high", "medium", "low", "risk_score")}
    zero["merkle_root"] = F.coalesce("merkle_root", F.lit(EMPTY_ROOT))
    default = "array('DPDP', 'GDPR', 'HIPAA', 'ISO27001', 'NIST-CSF', 'PCI-DSS', 'SOC2')"
    # joined by (workspace, part): the parts of one large workspace go to many tasks
    keys = ["workspace", "part"]
    return header.withColumns(zero).join(finding_parts, keys, "left").join(evidence_parts, keys, "left").selectExpr(
        "workspace", "part", "parts", f"'{VERSION}' AS report_version",
        f"named_struct('name', element_at(split(workspace, '/'), -1), 'path', workspace, "
        f"'commit', cast(NULL AS string), 'scan_time', '{scan_time}') AS project",
        f"coalesce(standards, {default}) AS standards",
        "transform(coalesce(found, array()), f -> struct(f.id, f.type, f.file, f.line, f.snippet, f.severity, f.confidence, "
        "f.evidence_hash, f.compliance_frameworks_affected, f.control_id, f.control_category, f.control_pass_fail_status, "
        "f.required_evidence_missing, f.auditor_explanation, f.control_state)) AS findings",
        "transform(coalesce(proof, array()), e -> struct(e.control_id, e.framework, e.evidence_type, e.evidence_present, "
        "e.evidence_source, e.expiry_detected)) AS system_evidence",
        "coalesce(control_states, map()) AS control_states",
        "transform(coalesce(found, array()), f -> f.evidence_hash) AS evidence_hashes",
        "struct(cast(critical AS int) AS critical, cast(high AS int) AS high, cast(medium AS int) AS medium, "
        "cast(low AS int) AS low, cast(risk_score AS int) AS risk_score) AS metrics",
        "merkle_root", "'' AS agent_signature", "'auditlake-1' AS agent_version")


def write_report_json(documents: DataFrame, path: str) -> None:
    documents.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def csv_rows(findings: DataFrame) -> DataFrame:
    return findings.selectExpr(
        "id AS ID", "type AS Type", "file AS File",
        "CASE WHEN line IS NULL OR line = 0 THEN '' ELSE cast(line AS string) END AS Line",
        "severity AS Severity", "confidence AS Confidence", "control_id AS `Control ID`",
        "control_category AS `Control Category`",
        "array_join(compliance_frameworks_affected, ', ') AS `Compliance Frameworks`")


def write_findings_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.mode("errorifexists").option("header", True).option("escape", '"').option(
        "emptyValue", "").csv(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """SARIF result fields per finding, and the result object as JSON."""
    rows = findings.selectExpr(
        "workspace", "id", "coalesce(nullif(control_id, ''), type) AS rule_id",
        "CASE lower(severity) WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'low' THEN 'note' "
        "ELSE 'warning' END AS level",
        "CASE WHEN snippet IS NULL OR snippet = '' THEN type ELSE substring(snippet, 1, 500) END AS message",
        "replace(file, '\\\\', '/') AS uri", "coalesce(nullif(line, 0), 1) AS start_line", "confidence",
        "compliance_frameworks_affected AS frameworks")
    result = (
        "to_json(named_struct('ruleId', rule_id, 'level', level, 'message', named_struct('text', message), "
        "'locations', array(named_struct('physicalLocation', named_struct("
        "'artifactLocation', named_struct('uri', uri), "
        "'region', named_struct('startLine', start_line, 'startColumn', 1)))), "
        "'properties', named_struct('confidence', confidence, 'compliance_frameworks', frameworks)))"
    )
    return rows.withColumn("result", F.expr(result))
