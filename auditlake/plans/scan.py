"""Whole-workspace plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import gates as G
from ..functions.text import lit
from ..operators.detect import Piece, rows_of, scanned
from ..operators.detectors import BUILDERS, pieces_for, with_tools
from ..operators.evidence import collect_evidence
from ..operators.finalize import finalize
from ..operators.ignore import IGNORE_FILE, PATTERNS, apply_ignore
from ..operators.practice import bit, file_bits, missing_locks, practice_gaps
from ..operators.states import report_states
from ..session import durable


def file_facts(files: DataFrame, validation: str = "disabled", extra: list[Piece] | None = None, excluded_names: tuple[str, ...] = (),
               ids: list[str] | None = None) -> DataFrame:
    """What one pass over the contents says of each file: (workspace, path, hits, name, flags, patterns).

    hits: of all per-file detectors; flags: bits of practices and workspace kinds; patterns: those of an ignore file.
    """
    skip = G.excluded_path("split(path, '/')", extra_names=excluded_names)
    patterns = f"CASE WHEN path = {lit(IGNORE_FILE)} THEN {PATTERNS} END"
    return scanned(files, pieces_for(list(BUILDERS) if ids is None else ids, validation) + list(extra or []), skip,
                   {"name": "name", "flags": file_bits(), "patterns": patterns})


def scan_workspaces(files: DataFrame, ignore: DataFrame | bool = False, validation: str = "disabled",
                    extra: list[Piece] | None = None, excluded_names: tuple[str, ...] = ()) -> DataFrame:
    """Raw findings of all detectors. Overlapping detectors each keep their row.

    Contents are read once for all rules, flags and ignore patterns, and Python sources once more for their symbols. What the
    pass finds, a row per file without its content, is written to the shared folder; all that looks at whole
    trees (lock files, practices, workspace kinds, ignore patterns) works on those rows. ``ignore``: a table
    (workspace, pattern), or True for the ignore files among ``files``; they apply to the per-file rules.
    """
    facts = durable(file_facts(files, validation, extra, excluded_names))
    hit = facts.where("size(hits) > 0")
    if ignore is not False and ignore is not None:
        own = facts.where("patterns IS NOT NULL").select("workspace", F.explode("patterns").alias("pattern")).distinct()
        hit = apply_ignore(hit, own if ignore is True else ignore)
    return (
        with_tools(rows_of(hit), tools_of(facts))
        .unionByName(missing_locks(facts))
        .unionByName(practice_gaps(files, bits=facts))
    )


def tools_of(flagged: DataFrame) -> DataFrame:
    """Workspaces with the README of a security tool, from rows with ``flags``."""
    return flagged.where(bit("security_tool")).select("workspace").distinct().withColumn("tool_readme", F.lit(True))


def report_findings(files: DataFrame, ignore: DataFrame | bool = False, validation: str = "disabled") -> DataFrame:
    """Findings with controls, ids and hashes."""
    return finalize(scan_workspaces(files, ignore, validation))


def report_tables(files: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, evidence and states as durable tables.

    Roll-ups read each of them several times; contents are scanned once for each.
    """
    kept = durable(findings)
    proof = durable(collect_evidence(files))
    return kept, proof, durable(report_states(kept, proof))
