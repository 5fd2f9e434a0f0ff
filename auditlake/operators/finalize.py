"""Findings made final: controls, order, ids, hashes, roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import lit
from ..rules.dimensions import FRAMEWORKS, SEVERITY_WEIGHTS
from ..session import durable
from .dims import finding_type_controls

EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # fixed value: SHA-256 of nothing
FAN = 10  # levels of the tree folded per round: chunks of 2^10 leaves


def enrich_controls(findings: DataFrame) -> DataFrame:
    """Control columns by finding type; unmapped types get the UNKNOWN defaults."""
    dim = finding_type_controls(findings.sparkSession).selectExpr(
        "type", "control_id AS c_id", "control_category AS c_category", "evidence_type AS c_evidence",
        "frameworks AS c_frameworks", "auditor_explanation AS c_explanation")
    return findings.join(F.broadcast(dim), "type", "left").selectExpr(
        *findings.columns,
        "coalesce(c_frameworks, array()) AS compliance_frameworks_affected",
        "coalesce(c_id, 'UNKNOWN') AS control_id",
        "coalesce(c_category, 'Unknown') AS control_category",
        "'FAIL' AS control_pass_fail_status",
        "CASE WHEN c_id IS NULL THEN 'Unknown evidence requirement' "
        "ELSE concat('Missing ', c_evidence, ' for ', c_id) END AS required_evidence_missing",
        "coalesce(c_explanation, 'No compliance mapping available for this finding type.') AS auditor_explanation",
        "CASE WHEN c_id IS NOT NULL THEN 'MISSING_EVIDENCE' END AS control_state",
    )


def with_position(df: DataFrame, groups: list[str], order: list[Column], name: str = "position", cut: bool = True, few: bool = False) -> DataFrame:
    """Dense 1-based position of each row in its group, without a task per group.

    Rows are range-partitioned by group and order, so a group with a third of all rows lies in many
    partitions. The order inside a partition is written down durably, and a table with one count per
    (group, partition) gives the offsets. The input is cut off first: finding the ranges samples it,
    which would otherwise run everything behind it (a whole scan, say) a second time. ``cut`` is false for rows whose
    keys are cheap to make twice; ``few`` says that the groups are few, so that the offsets are broadcast and rows stay where they are.
    """
    keys = [F.col(g) for g in groups] + order
    ordered = (durable(df) if cut else df).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = durable(ordered.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.expr("shiftright(_at, 33)"))
    counts = placed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        placed.join(F.broadcast(offsets) if few else offsets, [*groups, "_part"])
        .withColumn(name, F.expr("_at - _first + _before + 1"))
        .drop("_at", "_part", "_first", "_before")
    )


def report_order(columns: list[str]) -> list[Column]:
    """File, line (none first), type, snippet; then the rest, so that equal keys are equal rows."""
    detector = [F.col("detector")] if "detector" in columns else []
    return [F.col("file"), F.coalesce("line", F.lit(-1)), F.col("type"), F.col("snippet"),
            F.col("severity"), F.col("confidence"), *detector, F.to_json("metadata")]


def finding_id(position: str) -> str:
    return f"concat('F', CASE WHEN {position} < 1000 THEN lpad({position}, 3, '0') ELSE cast({position} AS string) END)"


def assign_ids(findings: DataFrame) -> DataFrame:
    return with_position(findings, ["workspace"], report_order(findings.columns)).withColumn("id", F.expr(finding_id("position")))


def json_string(expr: str) -> str:
    """JSON string with everything outside printable ASCII written as escapes."""
    plain = lit(r"^[ !#-\[\]-~]*\z")
    unit = f"regexp_replace(lower(hex(encode(c, 'UTF-16BE'))), '(.{{4}})', {lit(r'\\u$1')})"
    short = " ".join(
        f"WHEN {lit(raw)} THEN {lit('\\' + esc)}"
        for raw, esc in (('"', '"'), ("\\", "\\"), ("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")))
    escaped = (
        f"array_join(transform(regexp_extract_all({expr}, '(?s).', 0), "
        f"c -> CASE c {short} ELSE IF(c RLIKE '[ -~]', c, {unit}) END), '')"
    )
    return f"concat('\"', CASE WHEN {expr} RLIKE {plain} THEN {expr} ELSE {escaped} END, '\"')"


def json_number(expr: str) -> str:
    """A double from 0 to 1 as JSON has it: plain down to 0.0001, then with an exponent of two digits."""
    text = f"cast({expr} AS string)"
    parts = f"split({text}, 'E-')"
    mantissa = f"regexp_replace({parts}[0], '[.]0$', '')"
    return (
        f"CASE WHEN NOT contains({text}, 'E-') THEN {text} WHEN {expr} >= 1e-4D THEN concat('0.000', replace({mantissa}, '.', '')) "
        f"ELSE concat({mantissa}, 'e-', IF(length({parts}[1]) < 2, concat('0', {parts}[1]), {parts}[1])) END"
    )


def canonical_json() -> str:
    """Payload of the evidence hash: six fields, sorted keys, no spaces, ASCII."""
    line = "coalesce(cast(line AS string), 'null')"
    return (
        f"concat('{{\"confidence\":', {json_number('confidence')}, ',\"file\":', {json_string('file')}, "
        f"',\"line\":', {line}, ',\"severity\":', {json_string('severity')}, ',\"snippet\":', {json_string('snippet')}, "
        f"',\"type\":', {json_string('type')}, '}}')"
    )


def evidence_hash(findings: DataFrame) -> DataFrame:
    return findings.withColumn("evidence_hash", F.expr(f"sha2({canonical_json()}, 256)"))


def finalize(findings: DataFrame) -> DataFrame:
    """Enriched, numbered and hashed findings."""
    return evidence_hash(enrich_controls(assign_ids(findings)))


def fold(nodes: str, levels: str, stop_at_root: str) -> str:
    """Fold an array of binary nodes ``levels`` times; a lone last node is paired with itself."""
    pair = "unhex(sha2(concat(a[2 * i], coalesce(get(a, 2 * i + 1), a[2 * i])), 256))"
    up = f"transform(sequence(0, cast((size(a) + 1) div 2 AS int) - 1), i -> {pair})"
    return (
        f"aggregate(sequence(1, {levels}), {nodes}, (a, _) -> "
        f"CASE WHEN size(a) = 1 AND {stop_at_root} THEN a ELSE {up} END)[0]"
    )


def merkle_root(hashes: DataFrame, groups: list[str], position: str = "position", leaf: str = "evidence_hash", fan: int = FAN) -> DataFrame:
    """Root per group from leaves with dense 1-based positions.

    Each round folds chunks of 2^fan neighbouring nodes by exactly ``fan`` levels, keyed by (group,
    chunk), so no task or array holds more than one chunk however large a group is. The first chunk
    is also folded to its own root, which counts once a group has no other. The highest position
    says how many rounds there are: one for groups of up to 2^fan leaves.
    """
    cells = (
        hashes.select(*groups, (F.col(position) - 1).alias("at"), F.unhex(leaf).alias("node"))
        .withColumn("root", F.col("node"))
    )
    # a first chunk with a single cell is a group already folded to one node: its root is carried on
    alone = "(at = 0 AND size(cells) = 1)"
    nodes = "transform(cells, x -> x.node)"
    last = hashes.agg(F.max(position)).first()[0] or 1
    while True:
        cells = (
            cells.groupBy(*groups, F.expr(f"shiftright(at, {fan})").alias("at"))
            .agg(F.array_sort(F.collect_list(F.struct("at", "node", "root"))).alias("cells"))
            .select(*groups, "at",
                    F.expr(f"CASE WHEN {alone} THEN cells[0].root ELSE {fold(nodes, str(fan), 'false')} END").alias("node"),
                    F.expr(f"CASE WHEN {alone} THEN cells[0].root WHEN at = 0 THEN {fold(nodes, str(fan), 'true')} END").alias("root"))
        )
        last = (last + (1 << fan) - 1) >> fan
        if last <= 1:
            return cells.select(*groups, F.lower(F.hex("root")).alias("merkle_root"))


def merkle_roots(findings: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """Root per workspace; given workspaces without findings get the root of nothing."""
    roots = merkle_root(findings, ["workspace"])
    if workspaces is None:
        return roots
    return workspaces.select("workspace").distinct().join(roots, "workspace", "left").withColumn(
        "merkle_root", F.coalesce("merkle_root", F.lit(EMPTY_ROOT)))


VERIFIED = "Compliance evidence report verified"


def verify_merkle(reports: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, expected_root, valid, message) per report, from all of its documents.

    ``keys`` tell reports apart: by default the workspace, so a report in parts is checked as a whole; where there is
    none, each document is a report. Findings are put in order by position, not gathered: no task holds a whole report.
    Parts (``part``, ``parts``) that are missing or there twice make a report incomplete, and its parts must declare
    the same root. A null list of findings is an empty one.
    """
    if keys is None:
        keys = ["workspace"] if "workspace" in reports.columns else ["report"]
        reports = reports if keys == ["workspace"] else durable(reports.withColumn("report", F.monotonically_increasing_id()))
    found = reports.select(*keys, F.explode("findings").alias("f")).select(
        *keys, "f.file", F.coalesce("f.line", F.lit(-1)).alias("line"), "f.type", "f.id", F.lower("f.evidence_hash").alias("hash"))
    placed = with_position(found, keys, [F.col(c) for c in ("file", "line", "type", "id", "hash")])
    good = F.coalesce(F.col("hash").rlike(r"^[0-9a-f]{64}\z"), F.lit(False))
    bad = placed.where(~good).groupBy(*keys).agg(F.min(F.struct("position", F.coalesce("hash", F.lit("")).alias("hash"))).alias("first_bad"))
    roots = merkle_root(placed.withColumn("hash", F.when(good, F.col("hash"))), keys, leaf="hash").withColumnRenamed("merkle_root", "expected_root")
    declared = F.lower("merkle_root")
    whole = (
        (F.count("part") == F.max("parts")) & (F.count_distinct("part") == F.max("parts")) & (F.min("parts") == F.max("parts"))
        if {"part", "parts"} <= {*reports.columns} else F.lit(True)
    )
    heads = reports.groupBy(*keys).agg(F.min(declared).alias("low"), F.max(declared).alias("high"), whole.alias("whole"))
    message = (
        F.when(F.col("first_bad").isNotNull(), F.concat(F.lit("Invalid evidence hash: "), F.col("first_bad.hash")))
        .when(~F.coalesce("whole", F.lit(False)), "Report is incomplete")
        .when(F.col("low").eqNullSafe(F.col("high")) & (F.col("low") == F.col("expected_root")), VERIFIED).otherwise("Merkle root mismatch")
    )
    return (
        heads.join(roots, keys, "left").join(bad, keys, "left")
        .withColumn("expected_root", F.coalesce("expected_root", F.lit(EMPTY_ROOT))).withColumn("message", message)
        .withColumn("valid", F.col("message") == VERIFIED).drop("low", "high", "whole", "first_bad")
    )


def severity_metrics(findings: DataFrame) -> DataFrame:
    weight = "CASE severity " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in SEVERITY_WEIGHTS.items()) + " END"
    return findings.groupBy("workspace").agg(
        *[F.expr(f"count_if(severity = '{s}')").alias(s) for s in SEVERITY_WEIGHTS],
        F.expr(f"least(100, sum({weight}))").alias("risk_score"),
    )


def standards(findings: DataFrame) -> DataFrame:
    """Sorted union of the supported frameworks and those seen; only distinct names are collected."""
    supported = "array(" + ", ".join(lit(f) for f in FRAMEWORKS) + ")"
    seen = findings.select("workspace", F.explode_outer("compliance_frameworks_affected").alias("framework")).distinct()
    return seen.groupBy("workspace").agg(
        F.expr(f"array_sort(array_union({supported}, collect_set(framework)))").alias("standards"))


def scan_statistics(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files, unreadable files and findings per workspace; files are counted, not findings."""
    by_files = files.groupBy("workspace").agg(
        F.count(F.lit(1)).alias("files_scanned"), F.expr("count_if(content IS NULL)").alias("files_unreadable"))
    by_findings = findings.groupBy("workspace").agg(F.count(F.lit(1)).alias("total_findings"))
    return by_files.join(by_findings, "workspace", "left").select(
        "workspace", "files_scanned", "files_unreadable", F.coalesce("total_findings", F.lit(0)).alias("total_findings"))
