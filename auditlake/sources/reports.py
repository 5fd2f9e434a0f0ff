"""Report documents: reading with a fixed schema, checking constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas

HEX64 = r"'^[0-9a-fA-F]{64}\\z'"


def read_reports(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """One row per document, one document per file or per line; other text is kept in ``_corrupt_record``."""
    return spark.read.schema(schemas.REPORTS).option("multiLine", not one_per_line).option("mode", "PERMISSIVE").json(path)


def validate_report(reports: DataFrame) -> DataFrame:
    """``valid`` and the list of broken constraints."""
    checks = {
        "not a report document": "_corrupt_record IS NOT NULL",
        "report_version missing": "report_version IS NULL",
        "project missing": "project IS NULL OR project.name IS NULL OR project.path IS NULL OR project.scan_time IS NULL",
        "standards missing": "standards IS NULL",
        "findings missing": "findings IS NULL",
        "metrics missing": "metrics IS NULL",
        "merkle_root is not 64 hex digits": f"merkle_root IS NULL OR NOT merkle_root RLIKE {HEX64}",
        "agent_signature is not hex": r"agent_signature IS NULL OR NOT agent_signature RLIKE '^[0-9a-fA-F]+\\z'",
        "agent_version missing": "agent_version IS NULL",
        "finding severity unknown":
            "exists(findings, f -> f.severity IS NULL OR f.severity NOT IN ('critical', 'high', 'medium', 'low'))",
        "finding confidence outside 0..1":
            "exists(findings, f -> f.confidence IS NULL OR f.confidence < 0 OR f.confidence > 1)",
        "finding evidence_hash is not 64 hex digits":
            f"exists(findings, f -> f.evidence_hash IS NULL OR NOT f.evidence_hash RLIKE {HEX64})",
    }
    errors = ", ".join(f"CASE WHEN {test} THEN '{message}' END" for message, test in checks.items())
    return reports.withColumn("errors", F.expr(f"filter(array({errors}), e -> e IS NOT NULL)")).withColumn(
        "valid", F.expr("size(errors) = 0"))
