"""Workspace flags: kinds of workspace and evidence of practices, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import gates as G
from ..functions.prefilter import mark
from ..functions.text import any_rlike, has_any, java, lit, one_of
from ..rules import needles as N, practice as P
from .detect import candidate, marked, scanned
from .symbols import symbol_flags

KEPT = f"NOT {has_any('rooted', N.PRACTICE_EXCLUDED_PARTS)}"


def _npm(names: list[str]) -> str:
    parsed = "from_json(content, 'dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>')"
    keys = (
        f"concat(coalesce(map_keys({parsed}.dependencies), array()), coalesce(map_keys({parsed}.devDependencies), array()))"
    )
    return f"(path = 'package.json' AND exists({keys}, k -> {one_of('lower(k)', names)}))"


def _manifest(names: list[str], words: list[str]) -> str:
    return f"({one_of('path', names)} AND {mark(words)})"


def _config(exts: list[str], patterns: list[str]) -> str:
    return f"({one_of('ext', exts)} AND {KEPT} AND {candidate(patterns)} AND {any_rlike('content', patterns)})"


def _routes(exts: list[str], patterns: list[str], test: str) -> str:
    found = " OR ".join(f"exists(regexp_extract_all(content, {lit(java(p))}, 1), r -> {test})" for p in patterns)
    return f"({one_of('ext', exts)} AND {KEPT} AND {candidate(patterns)} AND ({found}))"


FILE_FLAGS = {
    "consent_by_dependency": f"({_npm(P.CONSENT_NPM)} OR {_manifest(P.CONSENT_PY_FILES, P.CONSENT_PY)})",
    "consent_by_route": (
        f"({one_of('ext', ['.py', '.js', '.ts', '.jsx', '.tsx'])} AND {KEPT} AND {candidate(P.CONSENT_ROUTES)}"
        f" AND {any_rlike('content', P.CONSENT_ROUTES)})"),
    "consent_by_schema": (
        f"(NOT {has_any('rooted', N.SCHEMA_EXCLUDED_PARTS)} AND ((ext = '.sql' AND {mark(P.CONSENT_SCHEMA)})"
        f" OR (contains(name, 'migration') AND endswith(name, '.py') AND {mark(['consent'])}"
        f" AND {mark(P.CONSENT_MIGRATION_WORDS)})))"),
    "portability_by_route": _routes(
        [".py", ".js", ".ts"], P.PORTABILITY_ROUTES, has_any("lower(r)", P.PORTABILITY_ROUTE_WORDS)),
    "access_logging_by_config": _config(P.CONFIG_EXTS, P.ACCESS_LOG_CONFIG),
    "retention_by_config": _config(P.CONFIG_EXTS + [".py"], P.RETENTION_CONFIG),
    "erasure_by_route": _routes(
        [".py", ".js", ".ts"], P.ERASURE_ROUTES,
        f"{has_any('lower(r)', P.ERASURE_WORDS)} AND {has_any('lower(r)', P.ERASURE_ROUTE_SUBJECTS)}"),
    "encryption_by_dependency": f"({_npm(P.ENCRYPTION_NPM)} OR {_manifest(P.ENCRYPTION_PY_FILES, P.ENCRYPTION_PY)})",
    "encryption_by_config": _config(P.CONFIG_EXTS, P.ENCRYPTION_CONFIG),
    "security_tool": G.readme_flag(N.SECURITY_TOOL_README, "lc", marked),
    "educational": G.readme_flag(N.EDUCATIONAL_README, "lc", marked),
    "web_application": G.web_file("lc", G.excluded_path("split(path, '/')"), marked),
}
NAME_FLAGS = {"security_tool": N.SECURITY_TOOL_NAMES, "educational": N.EDUCATIONAL_NAMES}
SYMBOL_FLAGS = ["consent_by_symbol", "portability_by_symbol", "access_logging_by_symbol", "erasure_by_symbol"]


def file_bits() -> str:
    """All file flags of one file as the bits of a long."""
    return "(" + " | ".join(f"CASE WHEN {test} THEN {1 << k}L ELSE 0L END" for k, test in enumerate(FILE_FLAGS.values())) + ")"


def bit(flag: str, bits: str = "flags") -> str:
    return f"(({bits} & {1 << list(FILE_FLAGS).index(flag)}L) != 0L)"


def flag(name: str) -> str:
    """A flag of a workspace from the bits of its files together."""
    return f"({bit(name)} OR {has_any(G.workspace_name(), NAME_FLAGS[name])})" if name in NAME_FLAGS else bit(name)


def flags_of(files: DataFrame) -> DataFrame:
    """(workspace, path, flags) of every file."""
    return scanned(files, [], more={"flags": file_bits()}).drop("hits")


def workspace_flags(files: DataFrame, flags: list[str] | None = None, bits: DataFrame | None = None) -> DataFrame:
    """One row per workspace. File flags are the bits of all its files, one map-side-combined aggregation; symbol flags
    are added only if asked for, because they need Python. ``bits``: (workspace, flags) per file, if they are there already."""
    flags = list(FILE_FLAGS) + SYMBOL_FLAGS if flags is None else flags
    by_file = [f for f in flags if f in FILE_FLAGS]
    out = (flags_of(files) if bits is None else bits).groupBy("workspace").agg(F.bit_or("flags").alias("flags"))
    out = out.select("workspace", *(F.expr(flag(f)).alias(f) for f in by_file))
    if set(flags) & set(SYMBOL_FLAGS):
        out = out.join(symbol_flags(files), "workspace", "left")
        out = out.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in SYMBOL_FLAGS})
    return out.select("workspace", *flags)


# (finding type, text, severity, flags of which one must hold)
PRACTICE_GAPS = [
    ("D39", "dpdp_missing_consent", "No consent handling mechanisms found", "high",
     ["consent_by_dependency", "consent_by_route", "consent_by_symbol", "consent_by_schema"]),
    ("D39", "dpdp_missing_access_logging", "No access logging for personal data found", "medium",
     ["access_logging_by_symbol", "access_logging_by_config"]),
    ("D39", "dpdp_missing_retention", "No data retention policies found", "medium", ["retention_by_config"]),
    ("D39", "dpdp_missing_right_to_erasure", "No right to erasure mechanisms found", "medium",
     ["erasure_by_route", "erasure_by_symbol"]),
    ("D39", "dpdp_missing_data_portability", "No data portability mechanisms found", "medium",
     ["portability_by_route", "portability_by_symbol"]),
    ("D40", "gdpr_missing_encryption", "No encryption mechanisms found", "high",
     ["encryption_by_dependency", "encryption_by_config"]),
]


def needed_flags(ids: tuple[str, ...] = ("D39", "D40")) -> list[str]:
    return ["educational", "web_application", *dict.fromkeys(f for g in PRACTICE_GAPS if g[0] in ids for f in g[4])]


def practice_gaps(files: DataFrame, ids: tuple[str, ...] = ("D39", "D40"), bits: DataFrame | None = None) -> DataFrame:
    """Findings for web applications, not teaching material, that show no sign of a practice."""
    return gaps_of(workspace_flags(files, needed_flags(ids), bits), ids)


def gaps_of(flags: DataFrame, ids: tuple[str, ...] = ("D39", "D40")) -> DataFrame:
    """The findings of ``practice_gaps`` from the flags of workspaces."""
    gaps = [g for g in PRACTICE_GAPS if g[0] in ids]
    rows = ", ".join(
        f"CASE WHEN NOT ({' OR '.join(g[4])}) THEN named_struct('detector', {lit(g[0])}, 'type', {lit(g[1])}, "
        f"'snippet', {lit(g[2])}, 'severity', {lit(g[3])}) END" for g in gaps)
    return (
        flags.filter("web_application AND NOT educational")
        .selectExpr("workspace", f"inline(array_compact(array({rows})))")
        .selectExpr("workspace", "detector", "type", "'.' AS file", "cast(NULL AS int) AS line", "snippet", "severity",
                    "0.7D AS confidence", "cast(map() AS map<string,string>) AS metadata")
    )


LOCK_OF = "map(" + ", ".join(f"{lit(m)}, {lit(k)}" for m, k in N.LOCK_FILES.items()) + ")"


def missing_locks(files: DataFrame) -> DataFrame:
    """Root manifests without their lock file: an anti join of path columns only."""
    manifests = (
        files.filter(one_of("path", list(N.LOCK_FILES))).select("workspace", "path").distinct()
        .withColumn("lock_file", F.expr(f"{LOCK_OF}[path]"))
    )
    locks = files.filter(one_of("path", list(N.LOCK_FILES.values()))).select("workspace", F.col("path").alias("lock_file"))
    return lock_findings(manifests.join(locks, ["workspace", "lock_file"], "left_anti"))


def lock_findings(missing: DataFrame) -> DataFrame:
    """Findings for (workspace, path, lock_file)."""
    return missing.selectExpr(
        "workspace", "'D14' AS detector", "'missing_dependency_lock' AS type", "path AS file", "cast(NULL AS int) AS line",
        "concat('Missing ', lock_file, ' for ', path) AS snippet", "'low' AS severity", "0.8D AS confidence",
        "map('dependency_file', path, 'lock_file', lock_file, 'control_id', 'SOC2-CC8.1') AS metadata")


