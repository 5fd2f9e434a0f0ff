"""Configuration evidence: every match of the collectors' rules, credited to controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import ODD_CASE, any_rlike, has_any, lit, match_lines
from ..rules import needles as N, practice as P
from .detect import guard
from .dims import control_pairs

ITEM = (
    "struct<collector:int,rule_no:int,match_no:int,control_no:int,framework:string,control_id:string,"
    "evidence_data:map<string,string>>"
)
COLLECTORS = {
    "F1": (P.LOGGING_EVIDENCE, control_pairs("Logging", "log")),
    "F2": (P.RETENTION_EVIDENCE, control_pairs("Retention")),
    "F3": (P.ENCRYPTION_EVIDENCE, control_pairs("Encryption")),
    "F4": (P.MFA_EVIDENCE, control_pairs("Access Control", "access")),
}
CLOUD_SETTINGS = [
    (P.AWS_CLOUDTRAIL, P.AWS_CLOUDTRAIL_CONTROLS, {"provider": "aws", "service": "cloudtrail"}),
    (P.AWS_S3_ENCRYPTION, P.AWS_S3_CONTROLS, {"provider": "aws", "service": "s3", "encryption": "enabled"}),
    (P.AWS_IAM_MFA, P.AWS_MFA_CONTROLS, {"provider": "aws", "service": "iam", "mfa": "enabled"}),
]
ORDER = ["collector", "rule_no", "match_no", "control_no"]


def _staged(files: DataFrame) -> DataFrame:
    kept = f"NOT {has_any('path', N.PRACTICE_EXCLUDED_PARTS)}"
    return files.filter(kept).withColumns(
        {"lc": F.lower("content"), "odd_case": F.expr(has_any("content", ODD_CASE))})


def _matches(rules: list[tuple[str, str]]) -> str:
    """Array of (rule_no, match_no, pattern, key, match, line_no) over all rules of a collector."""
    parts = []
    for no, (pattern, key) in enumerate(rules):
        row = (
            f"named_struct('rule_no', {no}, 'match_no', i, 'pattern', {lit(pattern)}, 'key', {lit(key)}, "
            f"'match', m.match, 'line_no', m.line_no)"
        )
        kind = "array<struct<rule_no:int,match_no:int,pattern:string,key:string,match:string,line_no:int>>"
        parts.append(
            f"CASE WHEN {guard([pattern])} THEN transform({match_lines('content', pattern)}, (m, i) -> {row}) "
            f"ELSE cast(array() AS {kind}) END")
    return f"concat({', '.join(parts)})"


def _pairs(pairs: list[tuple[str, str]]) -> str:
    return "array(" + ", ".join(
        f"named_struct('framework', {lit(f)}, 'control_id', {lit(c)})" for f, c in pairs) + ")"


def collect(files: DataFrame, ids: list[str]) -> DataFrame:
    """All evidence rows of the named collectors, with the order in which they were found."""
    parts = []
    for ordinal, key in enumerate(["F1", "F2", "F3", "F4"]):
        if key in ids:
            rules, pairs = COLLECTORS[key]
            data = "map('pattern', m.pattern, 'match', m.match, 'line_number', cast(m.line_no AS string))"
            parts.append(
                f"flatten(transform({_matches(rules)}, m -> transform({_pairs(pairs)}, (c, k) -> "
                f"named_struct('collector', {ordinal}, 'rule_no', m.rule_no, 'match_no', m.match_no, 'control_no', k, "
                f"'framework', c.framework, 'control_id', c.control_id, 'evidence_data', {data}))))")
    if "F6" in ids:
        for no, (patterns, pairs, data) in enumerate(CLOUD_SETTINGS):
            details = "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in data.items()) + ")"
            parts.append(
                f"CASE WHEN ext = '.tf' AND {guard(patterns)} AND {any_rlike('content', patterns)} "
                f"THEN transform({_pairs(pairs)}, (c, k) -> named_struct('collector', 5, 'rule_no', {no}, 'match_no', 0, "
                f"'control_no', k, 'framework', c.framework, 'control_id', c.control_id, 'evidence_data', {details})) END")
    arrays = ", ".join(f"coalesce(cast({p} AS array<{ITEM}>), cast(array() AS array<{ITEM}>))" for p in parts)
    return (
        _staged(files).select("workspace", F.col("path").alias("evidence_source"), F.expr(f"concat({arrays})").alias("items"))
        .selectExpr("workspace", "evidence_source", "inline_outer(items)")
        .filter("control_id IS NOT NULL")
        .selectExpr("workspace", "control_id", "framework", "'config_proof' AS evidence_type", "true AS evidence_present",
                    "evidence_source", "evidence_data", "false AS expiry_detected", *ORDER)
    )


def backup_signals(files: DataFrame) -> DataFrame:
    """Backup settings; the catalogue has no control for them."""
    return (
        _staged(files).select("workspace", "path", F.expr(_matches(P.BACKUP_SIGNALS)).alias("found"))
        .selectExpr("workspace", "path", "inline_outer(found)").filter("key IS NOT NULL")
        .selectExpr("workspace", "path AS evidence_source", "key AS signal", "match", "line_no")
    )


def collect_evidence(files: DataFrame) -> DataFrame:
    """First row per (control, framework, source) in collector order, as a combinable aggregate."""
    rows = collect(files, ["F1", "F2", "F3", "F4", "F6"])
    order = F.struct(*ORDER)
    return rows.groupBy("workspace", "control_id", "framework", "evidence_source").agg(
        F.first("evidence_type").alias("evidence_type"),
        F.first("evidence_present").alias("evidence_present"),
        F.min_by("evidence_data", order).alias("evidence_data"),
        F.first("expiry_detected").alias("expiry_detected"),
        *[F.expr(f"min(struct({', '.join(ORDER)})).{c}").alias(c) for c in ORDER],
    )
