"""Registered queries: one per operator, with the DuckDB statement that checks it where SQL can say it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import gates as G
from ..functions.text import ODD_CASE, has_any, java, lit, near, split_lines, stems
from ..operators import (
    detectors as DT, ensemble as EN, evidence as EV, finalize as FN, ignore as IG, ledger as LG, practice as PR, remediate as RM,
    rollups as RU, roots as RO, states as ST, symbols as SY, user_rules as UR, validate as VA,
)
from ..operators.dims import select_controls
from ..rules import dimensions as D, needles as N, practice as P, secrets as S
from ..session import durable, shared_dir, spread
from ..sources import files as SF, ledger as LS, reports as RP, sinks as SK
from ..streaming.scan_stream import scan_stream, settled_findings
from . import oracle as O
from .corpus import corpus, tables
from .scan import report_findings, report_tables, scan_workspaces

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BASE = ["D5", "D6", "D9", "D12", "D17", "D37"]
AS_OF = "1999-06-30 00:00:00"
q = O.q


def query(key: str, sql: str | None = None):
    def add(build: Query) -> Query:
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build
    return add


# --- detectors ---------------------------------------------------------------------------------
DETECTOR_NAMES = {
    "D1": "py_secrets", "D2": "code_secrets", "D3": "php_array_secrets", "D4": "java_secrets", "D5": "config_secrets",
    "D6": "iac_public_acl", "D7": "private_keys", "D8": "cloud_secrets", "D9": "terraform", "D10": "containers",
    "D11": "api_logging_gap", "D12": "database", "D13": "cicd", "D15": "frontend_storage", "D16": "config_security",
    "D17": "weak_encryption", "D18": "injection", "D19": "weak_auth", "D20": "missing_logging",
    "D21": "command_injection", "D22": "xss", "D23": "debug_mode", "D24": "cookies", "D25": "advanced_secrets",
    "D26": "auth_security", "D27": "insecure_config", "D28": "access_control", "D29": "logging_security",
    "D30": "encryption_security", "D31": "supply_chain", "D32": "xxe", "D33": "ssrf", "D34": "deserialization",
    "D35": "path_traversal", "D36": "race_condition", "D37": "crypto_misuse",
}
FINDING_COLUMNS = ["workspace", "file", "type", "line", "snippet", "severity"]


def shown(findings: DataFrame) -> DataFrame:
    return findings.select(
        *FINDING_COLUMNS, F.round("confidence", 6).alias("confidence"),
        F.expr("coalesce(metadata['issue'], metadata['weak_cipher'], metadata['secret_type'], '')").alias("label"))


for _id, _name in DETECTOR_NAMES.items():
    query(f"{_id.lower()}_{_name}", O.detector_sql(_id))(
        lambda spark, sf, key=_id: shown(DT.scan_files(corpus(spark, sf), [key])))


@query("d14_missing_lock", O.detector_sql("D14"))
def d14(spark, sf):
    return shown(PR.missing_locks(corpus(spark, sf)))


# --- corpus, paths, lines ------------------------------------------------------------------------
def write_tree(files: DataFrame, root: str) -> None:
    """Each file at root/workspace/path; in configuration files a byte that is no text comes first."""
    def write(batches):
        for batch in batches:
            store, base = SF._open(root)
            for row in zip(batch["workspace"], batch["path"], batch["content"], strict=True):
                workspace, path, content = (v.as_py() for v in row)
                place = f"{base}/{workspace}/{path}"
                store.create_dir(place.rsplit("/", 1)[0])
                with store.open_output_stream(place) as out:
                    out.write(b"\xff" * path.endswith(".conf") + content.encode())
            yield batch.select(["path"])

    files.select("workspace", "path", "content").mapInArrow(write, "path STRING").count()


@query("a1_read_files", f"""WITH {O.CORPUS}, one AS (SELECT workspace, path, min(content) AS content FROM every_file GROUP BY ALL)
SELECT workspace, path, sha256(content) AS content_hash, (1 + len(regexp_extract_all(content, chr(10))))::BIGINT AS n_lines FROM one""")
def a1(spark, sf):
    """The corpus written as a tree, dot files and undecodable bytes included, and read again."""
    root = landing(spark, "tree")
    write_tree(corpus(spark, sf).groupBy("workspace", "path").agg(F.min("content").alias("content")), root)
    return SF.read_files(spark, root).selectExpr(
        "workspace", "path", "sha2(content, 256) AS content_hash", "cast(length(content) - length(replace(content, '\n', '')) + 1 AS bigint) AS n_lines")


@query("a2_files_from_table", """
SELECT source AS workspace, 'doc' || doc_id::VARCHAR || '.txt' AS path, 'doc' || doc_id::VARCHAR || '.txt' AS name, '.txt' AS ext,
  length(text) AS characters, sha256(text) AS content_hash FROM documents""")
def a2(spark, sf):
    files = SF.files_from_table(tables(spark, sf, "documents"), "source", "concat('doc', doc_id, '.txt')", "text")
    return files.select("workspace", "path", "name", "ext", F.length("content").cast("bigint").alias("characters"),
                        F.sha2("content", 256).alias("content_hash"))


@query("a3_path_attributes", f"WITH {O.CORPUS} SELECT workspace, path, name, ext, len(string_split(path, '/')) AS depth FROM every_file")
def a3(spark, sf):
    return corpus(spark, sf).select("workspace", "path", "name", "ext", F.size(F.split("path", "/")).cast("bigint").alias("depth"))


@query("a4_explode_lines", f"WITH {O.CORPUS},{O.line_table('every_file', 'every_line', 'workspace, path')} SELECT workspace, path, line_no, line FROM every_line")
def a4(spark, sf):
    return SF.explode_lines(corpus(spark, sf)).withColumn("line_no", F.col("line_no").cast("bigint"))


def few(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The findings of six detectors, for queries about sinks and documents that read them many times."""
    files = corpus(spark, sf)
    return files, DT.scan_files(files, BASE)


def everything(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All findings of all detectors under the ignore patterns."""
    files = corpus(spark, sf)
    return files, scan_workspaces(files, True)


DIM_ROWS = [(t, c, k, e, f, d, x) for t, c, k, e, f, d, x in D.FINDING_TYPE_CONTROLS]


def enriched(found: str) -> str:
    """Statement head: ``found`` and its controls."""
    return found + f""",
dim AS (SELECT * FROM {O.values(DIM_ROWS, "d(dtype, d_id, d_category, d_evidence, d_frameworks, d_description, d_explanation)")}),
enriched AS MATERIALIZED (SELECT f.*, coalesce(d_frameworks, []) AS frameworks, coalesce(d_id, 'UNKNOWN') AS control_id,
  coalesce(d_category, 'Unknown') AS control_category, 'FAIL' AS status,
  CASE WHEN d_id IS NULL THEN 'Unknown evidence requirement' ELSE 'Missing ' || d_evidence || ' for ' || d_id END AS required_evidence_missing,
  coalesce(d_explanation, 'No compliance mapping available for this finding type.') AS auditor_explanation,
  CASE WHEN d_id IS NULL THEN NULL ELSE 'MISSING_EVIDENCE' END AS control_state
  FROM found f LEFT JOIN dim ON dtype = type)"""


def js(expr: str) -> str:
    bs = "chr(92)"
    return (
        f"'\"' || coalesce(array_to_string(list_transform(string_split({expr}, ''), lambda c: CASE WHEN c = '\"' THEN {bs} || '\"' WHEN c = {bs} THEN {bs} || {bs} "
        f"WHEN c = chr(8) THEN {bs} || 'b' WHEN c = chr(9) THEN {bs} || 't' WHEN c = chr(10) THEN {bs} || 'n' WHEN c = chr(12) THEN {bs} || 'f' WHEN c = chr(13) THEN {bs} || 'r' WHEN c >= ' ' AND c <= '~' THEN c ELSE {bs} || 'u' || lpad(lower(to_hex(unicode(c))), 4, '0') END), ''), '') || '\"'"
    )


def numbered(found: str, last: str = "label") -> str:
    """Statement head: ``enriched`` with positions, ids and hashes. ``last``: what orders findings that are equal in all else."""
    return enriched(found) + f""",
numbered AS MATERIALIZED (SELECT *, 'F' || CASE WHEN position < 1000 THEN lpad(position::VARCHAR, 3, '0') ELSE position::VARCHAR END AS id,
  sha256('{{"confidence":' || confidence::VARCHAR || ',"file":' || {js('file')} || ',"line":' || coalesce(line::VARCHAR, 'null') || ',"severity":' || {js('severity')}
    || ',"snippet":' || {js('snippet')} || ',"type":' || {js('type')} || '}}') AS evidence_hash
  FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY file, coalesce(line, -1), type, snippet, severity, confidence, {last}) AS position FROM enriched))"""


FOUND = f"{O.HEAD},\n{O.TOOL},\nfound AS MATERIALIZED (\n{O.detector_union(BASE)}\n)"
ENRICHED, NUMBERED = enriched(FOUND), numbered(FOUND)


# --- gates -----------------------------------------------------------------------------------------
FRAMES = {"near10": (9, 10), "near5": (4, 5), "near3": (2, 3)}


def assignments(spark: SparkSession, sf: str, frames: tuple[str, ...] = ()) -> DataFrame:
    """Every line with an assignment to a secret-like name. ``frames``: the neighbourhoods wanted.

    Substring tests of the file and of the line go before the pattern, and names and values are cut out where lines are rows of an
    array: later conditions on them then don't evaluate the patterns again.
    """
    files = corpus(spark, sf).withColumns({"lc": F.lower("content"), "rooted": F.expr("concat('/', path)")})
    p, words = lit(java(S.ASSIGNMENT)), stems([S.ASSIGNMENT])
    files = files.withColumns({"test_file": F.expr(G.test_file()), "odd_case": F.expr(has_any("content", ODD_CASE))})
    files = files.withColumn("lines", F.expr(f"CASE WHEN odd_case OR {has_any('lc', words)} THEN {split_lines('content')} END"))
    found = f"filter(transform(lines, (l, i) -> struct(i + 1 AS no, l)), x -> (odd_case OR {has_any('lower(x.l)', words)}) AND x.l RLIKE {p})"
    near_by = "".join(f", {near('x.no', *FRAMES[n])} AS {n}" for n in frames)
    cut = f"transform({found}, x -> struct(x.no, x.l AS line, regexp_extract(x.l, {p}, 1) AS var, regexp_extract(x.l, {p}, 2) AS value{near_by}))"
    kept = ", ".join(f"x.{c}" for c in ("no", "line", "var", "value", *frames))
    hits = f"transform({cut}, x -> struct({kept}, {G.unquote('x.value')} AS clean))"
    return files.selectExpr("workspace", "path", "name", "ext", "test_file", f"inline_outer({hits})").filter("no IS NOT NULL").selectExpr(
        "workspace", "path", "name", "ext", "test_file", "cast(no AS bigint) AS line_no", "line", *frames, "var", "value", "clean")


ALL_LINES = O.line_table("tested", "every_line", "workspace, path, name, ext, test_file")
ASSIGN = f"""WITH {O.CORPUS}, tested AS (SELECT *, {O.TEST_FILE} AS test_file FROM every_file),{ALL_LINES},
framed AS (SELECT *, {', '.join(f"string_agg(line, chr(10)) OVER (PARTITION BY workspace, path ORDER BY line_no ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING) AS {n}" for (b, a), n in O.FRAMES.items())} FROM every_line),
a AS (SELECT *, {O.group('line', S.ASSIGNMENT, 1)} AS var, {O.group('line', S.ASSIGNMENT, 2)} AS value,
  trim({O.group('line', S.ASSIGNMENT, 2)}, {q(chr(39) + chr(34))}) AS clean FROM framed WHERE {O.rx('line', S.ASSIGNMENT)})"""


@query("b1_exclude_paths", f"WITH {O.CORPUS} SELECT workspace, path FROM every_file WHERE NOT {O.EXCLUDED}")
def b1(spark, sf):
    return DT.not_excluded(corpus(spark, sf)).select("workspace", "path")


PATTERNS = f"""{O.line_table("(SELECT * FROM every_file WHERE path = '.scanignore')", 'il', 'workspace').strip().removeprefix(',')},
pats AS (SELECT DISTINCT workspace, {O.trimmed('line')} AS p FROM il WHERE {O.trimmed('line')} != '' AND NOT starts_with({O.trimmed('line')}, '#')),
cut1 AS (SELECT workspace, CASE WHEN starts_with(p, '**/') THEN substring(p, 4) ELSE p END AS p FROM pats),
cut AS (SELECT workspace, CASE WHEN starts_with(p, '/') THEN substring(p, 2) ELSE p END AS p FROM cut1),
kept_files AS (SELECT workspace, path FROM every_file f WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.workspace = f.workspace
  AND (strpos(f.path, p) > 0 OR f.name = p OR (strpos(p, '*') > 0 AND (f.path GLOB p OR f.name GLOB p)))))"""


@query("b2_ignore_patterns", f"WITH {O.CORPUS}, {PATTERNS} SELECT workspace, path FROM kept_files")
def b2(spark, sf):
    files = corpus(spark, sf)
    return IG.apply_ignore(files, IG.ignore_patterns(files)).select("workspace", "path")


@query("b3_is_detector_code", f"WITH {O.CORPUS} SELECT workspace, path, {O.DETECTOR_CODE} AS detector_code FROM every_file")
def b3(spark, sf):
    files = corpus(spark, sf).withColumns({"lc": F.lower("content"), "rooted": F.expr("concat('/', path)")})
    return files.selectExpr("workspace", "path", f"{G.is_detector_code()} AS detector_code")


@query("b4_is_pattern_definition", f"{O.HEAD} SELECT workspace, path, line_no, line FROM lines WHERE {O.DEFINITION}")
def b4(spark, sf):
    files = DT.not_excluded(corpus(spark, sf)).withColumn("lc", F.lower("content"))
    lines = files.selectExpr("workspace", "path", f"{G.pattern_context()} AS pattern_context", f"posexplode({split_lines('content')}) AS (at, line)")
    return lines.filter(G.is_pattern_definition("line")).selectExpr("workspace", "path", "cast(at + 1 AS bigint) AS line_no", "line")


@query("b5_has_secret_keyword", f"{ASSIGN} SELECT workspace, path, line_no, var, {O.keyword('var')} AS has_keyword FROM a")
def b5(spark, sf):
    return assignments(spark, sf).selectExpr("workspace", "path", "line_no", "var", f"{G.has_secret_keyword('var')} AS has_keyword")


@query("b6_looks_like_secret", f"{ASSIGN} SELECT workspace, path, line_no, clean, {O.secretive('clean')} AS secret FROM a")
def b6(spark, sf):
    return assignments(spark, sf).selectExpr("workspace", "path", "line_no", "clean", f"{G.looks_like_secret('clean')} AS secret")


@query("b7_is_test_data", f"{ASSIGN} SELECT workspace, path, line_no, clean, {O.test_data('clean')} AS test_data FROM a")
def b7(spark, sf):
    return assignments(spark, sf).selectExpr("workspace", "path", "line_no", "clean", f"{G.is_test_data('clean')} AS test_data")


VARIANTS = {"py": N.COMMENTS_PY, "code": N.COMMENTS_CODE, "markup": N.COMMENTS_MARKUP, "frontend": N.COMMENTS_FRONTEND}


@query("b8_is_comment", f"{O.HEAD} SELECT workspace, path, line_no, {', '.join(f'{O.comment(p)} AS {k}_comment' for k, p in VARIANTS.items())} FROM lines WHERE {O.comment(N.COMMENTS_MARKUP)}")
def b8(spark, sf):
    lines = SF.explode_lines(DT.not_excluded(corpus(spark, sf)))
    return lines.filter(G.is_comment("line", N.COMMENTS_MARKUP)).selectExpr(
        "workspace", "path", "cast(line_no AS bigint) AS line_no", *[f"{G.is_comment('line', p)} AS {k}_comment" for k, p in VARIANTS.items()])


@query("b9_is_placeholder_line", f"{O.HEAD} SELECT workspace, path, line_no, {O.CODE_PLACEHOLDER} AS code_placeholder, {O.CONFIG_PLACEHOLDER} AS config_placeholder FROM lines WHERE {O.has('upper(line)', N.CODE_PLACEHOLDER_WORDS)}")
def b9(spark, sf):
    lines = SF.explode_lines(DT.not_excluded(corpus(spark, sf)))
    return lines.filter(has_any("upper(line)", N.CODE_PLACEHOLDER_WORDS)).selectExpr(
        "workspace", "path", "cast(line_no AS bigint) AS line_no", f"{G.is_code_placeholder_line('line')} AS code_placeholder",
        f"{G.is_config_placeholder_line('line')} AS config_placeholder")


@query("b10_is_env_reference", f"{ASSIGN} SELECT workspace, path, line_no, value, (strpos(value, '${{') > 0 OR starts_with(value, '$')) AS env_reference FROM a")
def b10(spark, sf):
    return assignments(spark, sf).selectExpr("workspace", "path", "line_no", "value", f"{G.is_env_reference('value')} AS env_reference")


@query("b11_is_placeholder_value", f"{ASSIGN} SELECT workspace, path, line_no, clean, ({O.within('upper(clean)', N.CODE_PLACEHOLDER_VALUES)} OR {O.within('lower(clean)', N.CODE_NULL_VALUES)}) AS placeholder FROM a")
def b11(spark, sf):
    return assignments(spark, sf).selectExpr("workspace", "path", "line_no", "clean", f"{G.is_placeholder_value('clean')} AS placeholder")


@query("b12_adjust_confidence", f"""{ASSIGN} SELECT workspace, path, line_no, round(confidence, 6) AS confidence FROM (
  SELECT *, {O.code_confidence('clean', O.comment(N.COMMENTS_MARKUP))} AS confidence FROM (SELECT *, lower(name) AS lname FROM a)) WHERE confidence >= 0.4""")
def b12(spark, sf):
    score = G.code_confidence("clean", DT.TEST_LIKE, DT.EXAMPLE_LIKE, G.is_comment("line", N.COMMENTS_MARKUP))
    # as a generator's output, so that the condition doesn't compute the score a second time
    rows = assignments(spark, sf).withColumn("lname", F.lower("name")).selectExpr("workspace", "path", "line_no", f"inline(array(named_struct('confidence', {score})))")
    return rows.filter("confidence >= 0.4D").select("workspace", "path", "line_no", F.round("confidence", 6).alias("confidence"))


@query("b13_near_context", f"{ASSIGN} SELECT workspace, path, line_no, sha256(near10) AS near10, sha256(near5) AS near5, sha256(near3) AS near3 FROM a")
def b13(spark, sf):
    return assignments(spark, sf, ("near10", "near5", "near3")).select("workspace", "path", "line_no", *[F.sha2(c, 256).alias(c) for c in ("near10", "near5", "near3")])


WS = "lower(list_last(string_split(workspace, '/')))"
NPM = "(path = 'package.json' AND len(list_intersect(list_transform(list_concat(coalesce(json_keys(TRY_CAST(content AS JSON), '$.dependencies'), []), coalesce(json_keys(TRY_CAST(content AS JSON), '$.devDependencies'), [])), lambda k: lower(k)), [{names}])) > 0)"


def npm(names):
    return NPM.replace("{names}", ", ".join(q(n) for n in names))


KEPT = f"NOT {O.has('rooted', N.PRACTICE_EXCLUDED_PARTS)}"


def routes(patterns, test):
    found = " OR ".join(f"len(list_filter(regexp_extract_all(content, {q(p.replace(chr(92) + '/', '/'))}, 1, 'i'), lambda r: {test})) > 0" for p in patterns)
    return f"({O.within('ext', ['.py', '.js', '.ts'])} AND {KEPT} AND ({found}))"


def conf(exts, patterns):
    return f"({O.within('ext', exts)} AND {KEPT} AND {O.any_rx('content', patterns)})"


FLAG_SQL = {
    "consent_by_dependency": f"({npm(P.CONSENT_NPM)} OR ({O.within('path', P.CONSENT_PY_FILES)} AND {O.has('lc', P.CONSENT_PY)}))",
    "consent_by_route": f"({O.within('ext', ['.py', '.js', '.ts', '.jsx', '.tsx'])} AND {KEPT} AND {O.any_rx('content', [p.replace(chr(92) + '/', '/') for p in P.CONSENT_ROUTES])})",
    "consent_by_schema": f"(NOT {O.has('rooted', N.SCHEMA_EXCLUDED_PARTS)} AND ((ext = '.sql' AND {O.has('lc', P.CONSENT_SCHEMA)}) OR (strpos(name, 'migration') > 0 AND ends_with(name, '.py') AND {O.has('lc', ['consent'])} AND {O.has('lc', P.CONSENT_MIGRATION_WORDS)})))",
    "portability_by_route": routes(P.PORTABILITY_ROUTES, O.has("lower(r)", P.PORTABILITY_ROUTE_WORDS)),
    "access_logging_by_config": conf(P.CONFIG_EXTS, P.ACCESS_LOG_CONFIG),
    "retention_by_config": conf(P.CONFIG_EXTS + [".py"], P.RETENTION_CONFIG),
    "erasure_by_route": routes(P.ERASURE_ROUTES, f"{O.has('lower(r)', P.ERASURE_WORDS)} AND {O.has('lower(r)', P.ERASURE_ROUTE_SUBJECTS)}"),
    "encryption_by_dependency": f"({npm(P.ENCRYPTION_NPM)} OR ({O.within('path', P.ENCRYPTION_PY_FILES)} AND {O.has('lc', P.ENCRYPTION_PY)}))",
    "encryption_by_config": conf(P.CONFIG_EXTS, P.ENCRYPTION_CONFIG),
    "security_tool": f"({O.within('path', N.README_NAMES)} AND {O.has('lc', N.SECURITY_TOOL_README)})",
    "educational": f"({O.within('path', N.README_NAMES)} AND {O.has('lc', N.EDUCATIONAL_README)})",
    "web_application": f"(({O.within('path', N.WEB_MANIFESTS)} AND {O.has('lc', N.WEB_FRAMEWORKS)}) OR {O.within('path', N.WEB_ENTRY_FILES)} OR (NOT {O.EXCLUDED} AND {O.within('ext', N.WEB_CODE_EXTS)} AND {O.has('lc', N.WEB_USER_DATA)}))",
}
# of the corpus, two seeds are Python that parses; what they name is stated here, not parsed
SYM, SYM2 = "starts_with(content, 'import consent_lib')", "starts_with(content, 'def g(request)')"
FLAG_SQL |= {
    "consent_by_symbol": f"({SYM} OR {SYM2})", "portability_by_symbol": SYM, "access_logging_by_symbol": SYM,
    "erasure_by_symbol": f"({SYM} OR {SYM2})",
}
SYMBOL_ROWS = O.values([
    ("sym", "import", "consent_lib", 1, ""), ("sym", "from", "consents", 2, ""), ("sym", "decorator", "audit_trail", 3, ""),
    ("sym", "call", "export_user_data", 5, "impor"), ("sym", "call", "delete_user", 6, "mport"), ("sym", "class", "AuditMiddleware", 7, ""),
    ("sym2", "call", "info", 2, "de"), ("sym2", "call", "erase_personal_data", 3, "def"), ("sym2", "call", "check_consent", 4, "def "),
], "s(seed, kind, symbol, lineno, nearby)")


def flag_sql(flag: str) -> str:
    named = f" OR {O.has(WS, PR.NAME_FLAGS[flag])}" if flag in PR.NAME_FLAGS else ""
    return f"(bool_or({FLAG_SQL[flag]}){named})"


FLAG_KEYS = {
    "b14_is_security_tool": "security_tool", "b15_is_educational": "educational", "b16_is_web_application": "web_application",
    "e1_consent_by_dependency": "consent_by_dependency", "e2_consent_by_route": "consent_by_route",
    "e3_consent_by_symbol": "consent_by_symbol", "e4_consent_by_schema": "consent_by_schema",
    "e5_portability_by_route": "portability_by_route", "e6_portability_by_symbol": "portability_by_symbol",
    "e7_access_logging_by_symbol": "access_logging_by_symbol", "e8_access_logging_by_config": "access_logging_by_config",
    "e9_retention_by_config": "retention_by_config", "e10_erasure_by_route": "erasure_by_route",
    "e11_erasure_by_symbol": "erasure_by_symbol", "e12_encryption_by_dependency": "encryption_by_dependency",
    "e13_encryption_by_config": "encryption_by_config",
}
for _key, _flag in FLAG_KEYS.items():
    query(_key, f"WITH {O.CORPUS} SELECT workspace, {flag_sql(_flag)} AS {_flag} FROM every_file GROUP BY workspace" if _flag in FLAG_SQL else None)(
        lambda spark, sf, flag=_flag: PR.workspace_flags(corpus(spark, sf), [flag]))


GAP_FLAGS = ["educational", "web_application", *dict.fromkeys(f for g in PR.PRACTICE_GAPS if g[0] == "D39" for f in g[4])]


@query("d39_dpdp_gaps", f"""WITH {O.CORPUS}, w AS (SELECT workspace, {', '.join(f'{flag_sql(f)} AS {f}' for f in GAP_FLAGS)} FROM every_file GROUP BY workspace)
SELECT workspace, detector, type, '.' AS file, NULL::INT AS line, snippet, severity, 0.7::DOUBLE AS confidence FROM (
""" + "\nUNION ALL ".join(f"SELECT workspace, 'D39' AS detector, {q(t)} AS type, {q(x)} AS snippet, {q(level)} AS severity FROM w WHERE web_application AND NOT educational AND NOT ({' OR '.join(flags)})" for d, t, x, level, flags in PR.PRACTICE_GAPS if d == "D39") + ")")
def d39(spark, sf):
    return PR.practice_gaps(corpus(spark, sf), ("D39",)).drop("metadata")


@query("d40_gdpr_gaps", f"""WITH {O.CORPUS}, w AS (SELECT workspace, {', '.join(f'{flag_sql(f)} AS {f}' for f in ('educational', 'web_application', 'encryption_by_dependency', 'encryption_by_config'))} FROM every_file GROUP BY workspace)
SELECT workspace, '.' AS file, 'gdpr_missing_encryption' AS type, 'No encryption mechanisms found' AS snippet, 'high' AS severity, 0.7::DOUBLE AS confidence
FROM w WHERE web_application AND NOT educational AND NOT (encryption_by_dependency OR encryption_by_config)""")
def d40(spark, sf):
    return PR.practice_gaps(corpus(spark, sf), ("D40",)).select("workspace", "file", "type", "snippet", "severity", "confidence")


@query("d38_scan_workspace")
def d38(spark, sf):
    files = corpus(spark, sf)
    return scan_workspaces(files, True).select(
        *FINDING_COLUMNS, "detector", "confidence", F.to_json("metadata").alias("metadata"))


_counted = "\nUNION ALL ".join(f"SELECT '{k}' AS detector, * FROM (\n{O.detector_union([k])}\n)" for k in [f"D{i}" for i in range(1, 38) if i != 14])


def gap_rows(detector: str) -> str:
    return f"SELECT workspace, file, type, NULL::INT AS line, snippet, severity, confidence, '' AS label FROM ({ORACLES[detector]})"


@query("d38_scan_findings", f"""{O.HEAD_CTX},
{O.TOOL}, {PATTERNS},
found AS ({_counted})
SELECT detector, workspace, file, type, line, snippet, severity, round(confidence, 6) AS confidence, label FROM found
WHERE EXISTS (SELECT 1 FROM kept_files k WHERE k.workspace = found.workspace AND k.path = found.file)
UNION ALL SELECT 'D14', workspace, file, type, line, snippet, severity, confidence, label FROM ({O.detector_sql("D14")})
UNION ALL SELECT 'D39', * FROM ({gap_rows("d39_dpdp_gaps")})
UNION ALL SELECT 'D40', * FROM ({gap_rows("d40_gdpr_gaps")})""")
def d38_findings(spark, sf):
    """All findings of all detectors under the ignore patterns, with the label of each."""
    files = corpus(spark, sf)
    found = scan_workspaces(files, True)
    label = F.expr("coalesce(metadata['issue'], metadata['weak_cipher'], metadata['secret_type'], '')").alias("label")
    return found.select("detector", *FINDING_COLUMNS, F.round("confidence", 6).alias("confidence"), label)


@query("d38_detector_counts", f"{O.HEAD_CTX},\n{O.TOOL}\nSELECT detector, type, severity, count(*) AS findings, count(DISTINCT workspace || '/' || file) AS files FROM (\n{_counted}\n) GROUP BY ALL")
def d38_counts(spark, sf):
    found = DT.scan_files(corpus(spark, sf))
    return found.groupBy("detector", "type", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("workspace", "file").alias("files"))


ALL = f"""{O.HEAD_CTX},
{O.TOOL}, {PATTERNS},
found AS MATERIALIZED (SELECT * FROM (
{_counted}
) f WHERE EXISTS (SELECT 1 FROM kept_files k WHERE k.workspace = f.workspace AND k.path = f.file)
UNION ALL SELECT 'D14', workspace, file, type, line, snippet, severity, confidence, label FROM ({O.detector_sql("D14")})
UNION ALL SELECT 'D39', * FROM ({gap_rows("d39_dpdp_gaps")})
UNION ALL SELECT 'D40', * FROM ({gap_rows("d40_gdpr_gaps")}))"""
ALL_ENRICHED, ALL_NUMBERED = enriched(ALL), numbered(ALL, "detector, label")


# --- system evidence ------------------------------------------------------------------------------
def marks(pattern: str) -> str:
    """Rows (workspace, path, m, line_no, k) of every match, from marks put around the matches."""
    marked = f"regexp_replace(content, {q('(' + pattern + ')')}, chr(1) || '\\1' || chr(2), 'gi')"
    cut = f"(SELECT workspace, path, unnest(parts[2:]) AS piece, generate_subscripts(parts[2:], 1) AS k, parts FROM (SELECT *, string_split({marked}, chr(1)) AS parts FROM every_file WHERE {KEPT} AND {O.rx('content', pattern)}))"
    return f"(SELECT workspace, path, k, split_part(piece, chr(2), 1) AS m, 1 + len(regexp_extract_all(array_to_string(parts[1:k], ''), chr(10))) AS line_no FROM {cut})"


def evidence_sql(key: str) -> str:
    rules, pairs = EV.COLLECTORS[key]
    ordinal = list(EV.COLLECTORS).index(key)
    controls = O.values([(f, c, i) for i, (f, c) in enumerate(pairs)], "c(framework, control_id, control_no)")
    return "\nUNION ALL ".join(
        f"SELECT workspace, control_id, framework, path AS evidence_source, m AS matched, line_no::VARCHAR AS line_number, {q(p)} AS pattern, "
        f"{ordinal} AS collector, {i} AS rule_no, (k - 1) AS match_no, control_no FROM {marks(p)} CROSS JOIN {controls}"
        for i, (p, _) in enumerate(rules))


def aws_sql() -> str:
    return "\nUNION ALL ".join(
        f"SELECT workspace, control_id, framework, path AS evidence_source, NULL AS matched, NULL AS line_number, NULL AS pattern, 5 AS collector, {i} AS rule_no, 0 AS match_no, control_no "
        f"FROM every_file CROSS JOIN {O.values([(f, c, n) for n, (f, c) in enumerate(pairs)], 'c(framework, control_id, control_no)')} WHERE ext = '.tf' AND {KEPT} AND {O.any_rx('content', patterns)}"
        for i, (patterns, pairs, _) in enumerate(EV.CLOUD_SETTINGS))


EVIDENCE_SHOWN = "workspace, control_id, framework, evidence_source, matched, line_number, pattern"


def evidence_shown(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("workspace", "control_id", "framework", "evidence_source", "evidence_data['match'] AS matched",
                           "evidence_data['line_number'] AS line_number", "evidence_data['pattern'] AS pattern")


for _id, _name in {"F1": "logging_evidence", "F2": "retention_evidence", "F3": "encryption_evidence", "F4": "mfa_evidence"}.items():
    query(f"{_id.lower()}_{_name}", f"WITH {O.CORPUS} SELECT {EVIDENCE_SHOWN} FROM (\n{evidence_sql(_id)}\n)")(
        lambda spark, sf, key=_id: evidence_shown(EV.collect(corpus(spark, sf), [key])))


@query("f5_backup_signals", f"WITH {O.CORPUS} " + "\nUNION ALL ".join(
    f"SELECT workspace, path AS evidence_source, {q(k)} AS signal, m AS match, line_no::INT AS line_no FROM {marks(p)}" for p, k in P.BACKUP_SIGNALS))
def f5(spark, sf):
    return EV.backup_signals(corpus(spark, sf))


@query("f6_aws_evidence", f"WITH {O.CORPUS} SELECT workspace, control_id, framework, evidence_source, rule_no FROM (\n{aws_sql()}\n)")
def f6(spark, sf):
    return EV.collect(corpus(spark, sf), ["F6"]).select("workspace", "control_id", "framework", "evidence_source", "rule_no")


EVIDENCE_CTE = f"""proof AS MATERIALIZED (SELECT * FROM (
{chr(10).join(evidence_sql(k) + chr(10) + 'UNION ALL ' for k in EV.COLLECTORS)}{aws_sql()}
) QUALIFY row_number() OVER (PARTITION BY workspace, control_id, framework, evidence_source ORDER BY collector, rule_no, match_no, control_no) = 1)"""


@query("f7_collect_evidence", f"WITH {O.CORPUS}, {EVIDENCE_CTE} SELECT {EVIDENCE_SHOWN} FROM proof")
def f7(spark, sf):
    return evidence_shown(EV.collect_evidence(corpus(spark, sf)))


@query("f8_match_line_number", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no::INT AS line_no, m AS matched, count(*) AS matches FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[a-z]*tion[a-z]*', 0)) AS m FROM l) GROUP BY ALL""")
def f8(spark, sf):
    from ..functions.text import match_lines
    docs = spread(tables(spark, sf, "documents"), "doc_id").select("doc_id", F.expr(match_lines("text", "[a-z]*tion[a-z]*", "")).alias("found"))
    return docs.selectExpr("doc_id", "inline_outer(found)").filter("match IS NOT NULL").groupBy(
        "doc_id", "line_no", F.col("match").alias("matched")).agg(F.count(F.lit(1)).alias("matches"))


# --- finalisation ---------------------------------------------------------------------------------
@query("g1_enrich_controls", f"{ALL_ENRICHED} SELECT workspace, file, line, type, snippet, array_to_string(frameworks, ',') AS frameworks, control_id, control_category, status AS control_pass_fail_status, required_evidence_missing, auditor_explanation, control_state FROM enriched")
def g1(spark, sf):
    _, found = everything(spark, sf)
    return FN.enrich_controls(found).select(
        "workspace", "file", "line", "type", "snippet", F.array_join("compliance_frameworks_affected", ",").alias("frameworks"),
        "control_id", "control_category", "control_pass_fail_status", "required_evidence_missing", "auditor_explanation", "control_state")


@query("g2_assign_ids", f"{ALL_NUMBERED} SELECT workspace, id, position, file, line, type, snippet FROM numbered")
def g2(spark, sf):
    _, found = everything(spark, sf)
    return FN.assign_ids(found).select("workspace", "id", "position", "file", "line", "type", "snippet")


@query("g3_evidence_hash", f"{ALL_NUMBERED} SELECT workspace, file, line, type, evidence_hash FROM numbered")
def g3(spark, sf):
    _, found = everything(spark, sf)
    return FN.evidence_hash(found).select("workspace", "file", "line", "type", "evidence_hash")


MERKLE = """tree AS (
  SELECT workspace, 0 AS level, position - 1 AS i, unhex(evidence_hash) AS node, count(*) OVER (PARTITION BY workspace) AS n FROM numbered
  UNION ALL
  SELECT workspace, level + 1, i // 2, unhex(sha256(node || coalesce(nxt, node))), (n + 1) // 2
  FROM (SELECT *, lead(node) OVER (PARTITION BY workspace ORDER BY i) AS nxt FROM tree WHERE n > 1) WHERE i % 2 = 0)"""


@query("g4_merkle_root", f"{ALL_NUMBERED.replace('WITH ', 'WITH RECURSIVE ', 1)}, {MERKLE} SELECT workspace, lower(hex(node)) AS merkle_root FROM tree WHERE n = 1")
def g4(spark, sf):
    _, found = everything(spark, sf)
    return FN.merkle_roots(FN.evidence_hash(FN.assign_ids(found)))


@query("g4_growing_roots", ORACLES["g4_merkle_root"])
def g4_growing(spark, sf):
    """The same roots from three batches: the first 5 findings of each workspace, the next 35, and all others."""
    _, found = everything(spark, sf)
    leaves = durable(FN.evidence_hash(FN.assign_ids(found)).select("workspace", "position", "evidence_hash"))
    state = RO.no_roots(spark)
    for first, last in ((1, 5), (6, 40), (41, None)):
        batch = leaves.where(F.col("position") >= first) if last is None else leaves.where(F.col("position").between(first, last))
        state = durable(RO.append_leaves(state, batch.withColumn("position", F.col("position") - (first - 1))))
    return RO.state_roots(state)


def documents(spark: SparkSession, sf: str, part_rows: int = SK.PART_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    files, found = few(spark, sf)
    final = FN.finalize(found)
    return files, final, SK.report_documents(files, final, EV.collect_evidence(files), "2024-01-01T00:00:00+00:00", part_rows)


# what is done to a workspace's report, by two letters of its name
DAMAGE = "(ascii(substring(workspace, 4, 1)) + ascii(right(workspace, 1))) % {}"


def on_first_finding(kind: int, kinds: int, field: str, value):
    """The first finding of reports of one kind, with a field changed."""
    hit = F.expr(f"{DAMAGE.format(kinds)} = {kind}")
    return F.transform("findings", lambda f: F.when(hit & (f["id"] == "F001"), f.withField(field, F.lit(value))).otherwise(f))


@query("g5_verify_merkle", f"""{NUMBERED}, {EVIDENCE_CTE},
sized AS (
  SELECT workspace, coalesce(f.n, 0) AS n, greatest(coalesce(f.n, 0), coalesce(p.n, 0)) > 4 AS several, {DAMAGE.format(4)} AS kind
  FROM (SELECT DISTINCT workspace FROM every_file) w LEFT JOIN (SELECT workspace, count(*) AS n FROM numbered GROUP BY 1) f USING (workspace)
  LEFT JOIN (SELECT workspace, count(*) AS n FROM proof GROUP BY 1) p USING (workspace)),
judged AS (
  SELECT workspace, CASE WHEN kind = 1 AND n > 0 THEN 'Merkle root mismatch' WHEN kind = 2 AND n > 0 THEN 'Invalid evidence hash: xyz'
    WHEN kind = 3 AND several THEN 'Report is incomplete' ELSE 'Compliance evidence report verified' END AS message FROM sized)
SELECT workspace, message = 'Compliance evidence report verified' AS valid, message FROM judged""")
def g5(spark, sf):
    """Reports in parts of four rows; a quarter each with a changed hash, a malformed hash, and the last part missing."""
    _, _, docs = documents(spark, sf, 4)
    docs = docs.withColumn("findings", on_first_finding(1, 4, "evidence_hash", "0" * 64)).withColumn("findings", on_first_finding(2, 4, "evidence_hash", "xyz"))
    docs = docs.filter(f"NOT ({DAMAGE.format(4)} = 3 AND parts > 1 AND part = parts - 1)")
    return FN.verify_merkle(docs).select("workspace", "valid", "message")


@query("g6_severity_metrics", f"{ALL} SELECT workspace, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, least(100, sum(CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 5 END))::BIGINT AS risk_score FROM found GROUP BY workspace")
def g6(spark, sf):
    _, found = everything(spark, sf)
    return FN.severity_metrics(found).withColumn("risk_score", F.col("risk_score").cast("bigint"))


CATALOGUE = O.values([(c[0], c[1], c[2], c[3], c[4], c[6], c[7], c[8]) for c in D.CONTROLS],
                     "k(framework, control_id, control_category, control_type, verification_method, review_days, expiry_days, description)")
STATES_CTE = f"""catalogue AS (SELECT * FROM {CATALOGUE}),
fstates AS (SELECT DISTINCT workspace, control_id, 'MISSING_EVIDENCE' AS state FROM enriched WHERE control_id != 'UNKNOWN'),
estates AS (SELECT p.workspace, p.control_id, CASE verification_method WHEN 'machine' THEN 'VERIFIED_MACHINE' WHEN 'configuration' THEN 'VERIFIED_SYSTEM' ELSE 'ATTESTED_HUMAN' END AS state
  FROM proof p JOIN catalogue c ON c.framework = p.framework AND c.control_id = p.control_id
  QUALIFY row_number() OVER (PARTITION BY p.workspace, p.control_id ORDER BY collector DESC, evidence_source DESC, rule_no DESC, match_no DESC, control_no DESC) = 1),
states AS MATERIALIZED (SELECT workspace, control_id, coalesce(e.state, f.state) AS state FROM fstates f FULL JOIN estates e USING (workspace, control_id))"""


@query("g7_report_states", f"{ALL_ENRICHED}, {EVIDENCE_CTE}, {STATES_CTE} SELECT workspace, control_id, state FROM states")
def g7(spark, sf):
    files, found = everything(spark, sf)
    return ST.report_states(FN.enrich_controls(found), EV.collect_evidence(files))


@query("g8_evidence_state", f"""WITH catalogue AS (SELECT * FROM {CATALOGUE}), e AS (
  SELECT o_orderkey, (o_orderkey % 21)::INT AS n, CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_totalprice > 100000 END AS present, o_orderstatus = 'F' AS expired FROM orders),
c AS (SELECT *, row_number() OVER () - 1 AS n FROM catalogue)
SELECT o_orderkey, framework, control_id, CASE WHEN present IS NULL THEN 'MISSING_EVIDENCE' WHEN expired THEN 'EXPIRED_EVIDENCE' WHEN NOT present THEN 'MISSING_EVIDENCE'
  WHEN verification_method = 'machine' THEN 'VERIFIED_MACHINE' WHEN verification_method = 'configuration' THEN 'VERIFIED_SYSTEM' ELSE 'ATTESTED_HUMAN' END AS state FROM e JOIN c USING (n)""")
def g8(spark, sf):
    rows = pairs_from(tables(spark, sf, "orders"), "o_orderkey").selectExpr(
        "o_orderkey", "framework", "control_id", "CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_totalprice > 100000 END AS evidence_present",
        "o_orderstatus = 'F' AS expiry_detected")
    return LG.lookup_controls(rows).selectExpr("o_orderkey", "framework", "control_id", f"{ST.evidence_state()} AS state")


def pairs_from(df: DataFrame, key: str) -> DataFrame:
    """Give every row a catalogue control, in turn."""
    frameworks = "array(" + ", ".join(lit(c[0]) for c in D.CONTROLS) + ")"
    ids = "array(" + ", ".join(lit(c[1]) for c in D.CONTROLS) + ")"
    return df.withColumns({"framework": F.expr(f"{frameworks}[cast({key} % 21 AS int)]"), "control_id": F.expr(f"{ids}[cast({key} % 21 AS int)]")})


def attestations(spark: SparkSession, sf: str) -> DataFrame:
    roles = "array(" + ", ".join(lit(r) for r in D.ROLES) + ")"
    return pairs_from(tables(spark, sf, "orders"), "o_custkey").selectExpr(
        "o_orderkey AS request_id", "control_id", "framework", f"{roles}[cast(o_orderkey % 5 AS int)] AS role", "o_orderpriority AS scope",
        "concat('I attest order ', o_orderkey) AS attestation_text", "cast(1 + o_orderkey % 400 AS int) AS expiry_days",
        "transform(sequence(1, cast(1 + o_orderkey % 3 AS int)), i -> concat('doc-', (o_orderkey * i) % 1100)) AS evidence_upload_ids",
        "sha2(cast(o_custkey AS string), 256) AS signer_public_key", "sha2(concat('sig', o_orderkey), 256) AS signature", "o_orderdate AS ts")


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf, "documents").selectExpr("concat('doc-', doc_id) AS upload_id", "sha2(text, 256) AS content_hash")


CONTROL_LIST = "catalogue AS (SELECT *, row_number() OVER () - 1 AS n FROM (SELECT * FROM " + CATALOGUE + "))"
ATTEST = f"""WITH {CONTROL_LIST}, req AS (SELECT o_orderkey AS request_id, c.control_id, c.framework, ([{', '.join(q(r) for r in D.ROLES)}])[1 + o_orderkey % 5] AS role,
  1 + o_orderkey % 400 AS expiry_days, o_orderdate AS ts, sha256('sig' || o_orderkey::VARCHAR) AS signature, sha256(o_custkey::VARCHAR) AS signer_public_key
  FROM orders JOIN catalogue c ON c.n = o_custkey % 21),
refs AS (SELECT request_id, i, 'doc-' || ((request_id * i) % 1100)::VARCHAR AS upload_id FROM (SELECT request_id, unnest(range(1, (2 + request_id % 3)::BIGINT)) AS i FROM req)),
ups AS (SELECT 'doc-' || doc_id::VARCHAR AS upload_id, sha256(text) AS content_hash FROM documents),
res AS (SELECT request_id, coalesce(string_agg(content_hash, '' ORDER BY i), '') AS hashes, coalesce(string_agg(r.upload_id, ',' ORDER BY r.upload_id) FILTER (content_hash IS NULL), '') AS missing
  FROM refs r LEFT JOIN ups USING (upload_id) GROUP BY request_id),
human AS (SELECT req.*, missing, missing = '' AS accepted, sha256(hashes) AS evidence_hash, ts + to_days(expiry_days::INT) AS expires_at,
  substring(sha256(control_id || ':' || framework || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00:' || signature), 1, 16) AS attestation_id FROM req JOIN res USING (request_id))"""


@query("g9_resolve_states", f"""{ENRICHED.replace('WITH ', ATTEST + ', ', 1)}, {EVIDENCE_CTE},
seen AS (SELECT DISTINCT workspace, framework, control_id, true AS valid FROM proof), att AS (SELECT framework, control_id, max(expires_at) AS until FROM human GROUP BY ALL),
open AS (SELECT workspace, control_id AS key, count(*) AS open_findings FROM enriched GROUP BY ALL),
grid AS (SELECT workspace, framework, control_id, verification_method FROM (SELECT DISTINCT workspace FROM every_file) CROSS JOIN catalogue)
SELECT g.workspace, g.framework, g.control_id, g.verification_method, CASE WHEN valid THEN CASE g.verification_method WHEN 'machine' THEN 'VERIFIED_MACHINE' WHEN 'configuration' THEN 'VERIFIED_SYSTEM' ELSE 'ATTESTED_HUMAN' END
  WHEN until IS NOT NULL AND NOT TIMESTAMP '{AS_OF}' > until THEN 'ATTESTED_HUMAN' WHEN until IS NOT NULL THEN 'EXPIRED_EVIDENCE' ELSE 'MISSING_EVIDENCE' END AS state, coalesce(open_findings, 0) AS open_findings
FROM grid g LEFT JOIN seen s ON s.workspace = g.workspace AND s.framework = g.framework AND s.control_id = g.control_id
LEFT JOIN att a ON a.framework = g.framework AND a.control_id = g.control_id LEFT JOIN open o ON o.workspace = g.workspace AND o.key = g.framework || '-' || g.control_id""")
def g9(spark, sf):
    files, found = few(spark, sf)
    people = LG.human_attest(attestations(spark, sf), uploads(spark, sf))
    return ST.resolve_states(files, FN.enrich_controls(found), EV.collect_evidence(files), people, AS_OF)


ALL_FRAMEWORKS = "[" + ", ".join(q(f) for f in D.FRAMEWORKS) + "]"
STANDARDS = f"standards AS (SELECT workspace, list_sort(list_distinct(list_concat({ALL_FRAMEWORKS}, flatten(list(frameworks))))) AS standards FROM enriched GROUP BY workspace)"


@query("g10_standards", f"{ENRICHED}, {STANDARDS} SELECT workspace, array_to_string(standards, ',') AS standards FROM standards")
def g10(spark, sf):
    _, found = few(spark, sf)
    return FN.standards(FN.enrich_controls(found)).select("workspace", F.array_join("standards", ",").alias("standards"))


@query("g11_scan_statistics", f"{FOUND} SELECT e.workspace, files_scanned, files_unreadable, coalesce(total_findings, 0) AS total_findings FROM (SELECT workspace, count(*) AS files_scanned, count(*) FILTER (length(path) % 7 = 0) AS files_unreadable FROM every_file GROUP BY 1) e LEFT JOIN (SELECT workspace, count(*) AS total_findings FROM found WHERE length(file) % 7 <> 0 GROUP BY 1) f USING (workspace)")
def g11(spark, sf):
    """Files with paths of a length divisible by seven can't be read."""
    files = corpus(spark, sf).withColumn("content", F.expr("CASE WHEN length(path) % 7 <> 0 THEN content END"))
    return FN.scan_statistics(files, DT.scan_files(files, BASE))


# --- sinks and documents ------------------------------------------------------------------------
def landing(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


DOC_SQL = f"""{NUMBERED}, {EVIDENCE_CTE} SELECT w.workspace, coalesce(f.n, 0) AS findings, coalesce(p.n, 0) AS evidence, coalesce(f.first_id, '') AS first_id, coalesce(risk, 0)::INT AS risk_score
FROM (SELECT DISTINCT workspace FROM every_file) w LEFT JOIN (SELECT workspace, count(*) AS n, min(id) AS first_id, least(100, sum(CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 5 END)) AS risk FROM numbered GROUP BY 1) f USING (workspace)
LEFT JOIN (SELECT workspace, count(*) AS n FROM proof GROUP BY 1) p USING (workspace)"""


@query("a7_write_report_json", DOC_SQL)
def a7(spark, sf):
    _, _, docs = documents(spark, sf, 5)
    path = landing(spark, "report")
    SK.write_report_json(docs, path)
    written = spark.read.schema("workspace STRING, part INT, parts INT, findings ARRAY<STRUCT<id:string>>, system_evidence ARRAY<STRUCT<control_id:string>>, metrics STRUCT<risk_score:int>").json(path)
    return written.groupBy("workspace").agg(
        F.sum(F.size("findings")).alias("findings"), F.sum(F.size("system_evidence")).alias("evidence"),
        F.coalesce(F.min(F.expr("get(findings, 0).id")), F.lit("")).alias("first_id"), F.max("metrics.risk_score").alias("risk_score"))


@query("a5_read_reports", f"{NUMBERED} SELECT workspace, id, file, line, severity, evidence_hash, array_to_string(frameworks, ',') AS frameworks FROM numbered")
def a5(spark, sf):
    _, _, docs = documents(spark, sf)
    path = landing(spark, "report")
    SK.write_report_json(docs, path)
    found = RP.read_reports(spark, path, one_per_line=True).select("project", F.explode("findings").alias("f"))
    return found.selectExpr("project.path AS workspace", "f.id", "f.file", "f.line", "f.severity", "f.evidence_hash",
                            "array_join(f.compliance_frameworks_affected, ',') AS frameworks")


@query("a11_validate_report", f"""{NUMBERED},
judged AS (
  SELECT workspace, CASE {DAMAGE.format(8)} WHEN 0 THEN 'agent_signature is not hex' WHEN 1 THEN 'merkle_root is not 64 hex digits' WHEN 2 THEN 'project missing'
    WHEN 3 THEN 'metrics missing' WHEN 4 THEN 'agent_version missing; not a report document' WHEN 5 THEN CASE WHEN n > 0 THEN 'finding confidence outside 0..1' ELSE '' END
    WHEN 6 THEN CASE WHEN n > 0 THEN 'finding severity unknown' ELSE '' END ELSE '' END AS errors
  FROM (SELECT DISTINCT workspace FROM every_file) LEFT JOIN (SELECT workspace, count(*) AS n FROM numbered GROUP BY 1) USING (workspace))
SELECT workspace, errors = '' AS valid, errors FROM judged""")
def a11(spark, sf):
    """Signed reports, each eighth of them with another constraint broken."""
    _, _, docs = documents(spark, sf)
    kind = F.expr(DAMAGE.format(8))
    broken = docs.withColumns({
        "agent_signature": F.when(kind == 0, "").otherwise("ab"), "merkle_root": F.when(kind == 1, "zz").otherwise(F.col("merkle_root")),
        "project": F.when(kind != 2, F.col("project")), "metrics": F.when(kind != 3, F.col("metrics")),
        "agent_version": F.when(kind != 4, F.col("agent_version")), "_corrupt_record": F.when(kind == 4, "{").cast("string"),
        "findings": on_first_finding(5, 8, "confidence", 1.5),
    }).withColumn("findings", on_first_finding(6, 8, "severity", "urgent"))
    return RP.validate_report(broken).select("workspace", "valid", F.array_join(F.array_sort("errors"), "; ").alias("errors"))


UPLOAD_KINDS = "[" + ", ".join(q(u) for u in D.UPLOAD_TYPES) + "]"


@query("a6_ingest_evidence", f"SELECT 'd' || doc_id::VARCHAR AS file_name, ({UPLOAD_KINDS})[1 + doc_id % 5] AS file_type, sha256(text) AS content_hash, strlen(text) AS file_size FROM documents")
def a6(spark, sf):
    kinds = "array(" + ", ".join(lit(u) for u in D.UPLOAD_TYPES) + ")"
    sent = tables(spark, sf, "documents").selectExpr(
        "concat('d', doc_id) AS file_name", f"{kinds}[cast(doc_id % 5 AS int)] AS file_type", "base64(encode(text, 'UTF-8')) AS content_base64")
    return LG.ingest_evidence(sent).drop("upload_id")


@query("a8_write_findings_csv", f"""{NUMBERED} SELECT id AS "ID", type AS "Type", file AS "File", CASE WHEN line IS NULL OR line = 0 THEN '' ELSE line::VARCHAR END AS "Line", severity AS "Severity", confidence::VARCHAR AS "Confidence", control_id AS "Control ID", control_category AS "Control Category", array_to_string(frameworks, ', ') AS "Compliance Frameworks" FROM numbered""")
def a8(spark, sf):
    _, found = few(spark, sf)
    path = landing(spark, "findings")
    SK.write_findings_csv(FN.finalize(found), path)
    return spark.read.option("header", True).option("escape", '"').csv(path).na.fill("")


@query("a9_to_sarif", f"{NUMBERED} SELECT workspace, id, control_id AS rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'low' THEN 'note' ELSE 'warning' END AS level, CASE WHEN snippet = '' THEN type ELSE substring(snippet, 1, 500) END AS message, replace(file, chr(92), '/') AS uri, coalesce(nullif(line, 0), 1) AS start_line FROM numbered")
def a9(spark, sf):
    _, found = few(spark, sf)
    return SK.sarif_results(FN.finalize(found)).filter("result IS NOT NULL").select(
        "workspace", "id", "rule_id", "level", "message", "uri", "start_line")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Attestation requests, one per order; customers repeat, so roots do too."""
    return tables(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderkey AS id", "upper(sha2(cast(o_custkey AS string), 256)) AS merkle_root",
        "upper(sha2(o_orderpriority, 256)) AS public_key_hex",
        "concat('{\"frameworks\":[\"SOC2\",\"', CASE o_orderstatus WHEN 'O' THEN 'GDPR' ELSE 'DPDP' END, '\"],\"control_coverage_percent\":', cast(o_orderkey % 101 AS string), '.5}') AS metadata",
        "array(sha2(cast(o_orderkey AS string), 256), sha2(o_orderstatus, 256)) AS evidence_hashes",
        "array(sha2(o_orderpriority, 256)) AS human_signer_identities",
        "map('SOC2-CC6.2', 'MISSING_EVIDENCE', 'SOC2-CC7.2', CASE o_orderstatus WHEN 'F' THEN 'VERIFIED_SYSTEM' ELSE 'EXPIRED_EVIDENCE' END) AS control_states",
        "o_orderdate AS created_at")


LEDGER = """ledger AS (SELECT o_orderkey AS id, sha256(o_custkey::VARCHAR) AS merkle_root, sha256(o_orderpriority) AS public_key_hex, 'SOC2,' || CASE o_orderstatus WHEN 'O' THEN 'GDPR' ELSE 'DPDP' END AS frameworks,
  (o_orderkey % 101)::DOUBLE + 0.5 AS coverage, o_orderdate AS created_at FROM orders)"""


@query("h3_record_attestation", f"WITH {LEDGER} SELECT id, merkle_root, public_key_hex, frameworks AS frameworks_covered, coverage AS control_coverage_percent, 2 AS evidence_count, 1 AS human_signer_count, 2 AS control_count FROM ledger")
def h3(spark, sf):
    return LG.record_attestation(requests(spark, sf)).select(
        "id", "merkle_root", "public_key_hex", F.array_join("frameworks_covered", ",").alias("frameworks_covered"),
        "control_coverage_percent", "evidence_count", "human_signer_count", "control_count")


@query("a10_append_ledger", "SELECT count(*) AS n, count(DISTINCT id) AS ids, min(id) AS first_id, max(id) AS last_id, count(DISTINCT root) AS roots FROM (SELECT sha256(o_custkey::VARCHAR) AS root, row_number() OVER () AS id FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders))")
def a10(spark, sf):
    path = landing(spark, "ledger")
    rows = LG.record_attestation(requests(spark, sf)).drop("id")
    LS.append_ledger(spark, rows, path)
    LS.append_ledger(spark, rows, path)
    return LS.read_ledger(spark, path).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("first_id"),
        F.max("id").alias("last_id"), F.countDistinct("merkle_root").alias("roots"))


def stamp(column: str) -> str:
    return f"date_format({column}, 'yyyy-MM-dd HH:mm:ss')"


@query("h1_lookup_controls", f"WITH {CONTROL_LIST}, r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'NONE' ELSE c.framework END AS framework, c.control_id FROM orders JOIN catalogue c ON c.n = o_orderkey % 21) SELECT r.o_orderkey, r.framework, r.control_id, k.control_category, k.control_type, k.verification_method, k.review_days, k.expiry_days FROM r LEFT JOIN catalogue k ON k.framework = r.framework AND k.control_id = r.control_id")
def h1(spark, sf):
    rows = pairs_from(tables(spark, sf, "orders"), "o_orderkey").selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus = 'P' THEN 'NONE' ELSE framework END AS framework", "control_id")
    return LG.lookup_controls(rows).select("o_orderkey", "framework", "control_id", "control_category", "control_type",
                                           "verification_method", "review_days", "expiry_days")


@query("h2_select_controls", f"WITH {CONTROL_LIST} SELECT c.framework, c.control_id, c.control_category, count(*) AS attested FROM orders JOIN catalogue c ON c.n = o_custkey % 21 WHERE c.control_type = 'system' GROUP BY ALL")
def h2(spark, sf):
    wanted = select_controls(spark, control_type="system").select("framework", "control_id", "control_category")
    rows = pairs_from(tables(spark, sf, "orders"), "o_custkey").select("framework", "control_id")
    return rows.join(F.broadcast(wanted), ["framework", "control_id"]).groupBy("framework", "control_id", "control_category").agg(
        F.count(F.lit(1)).alias("attested"))


@query("h4_list_attestations", f"WITH {LEDGER} SELECT id, merkle_root, public_key_hex, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, frameworks, coverage, (SELECT count(*) FROM ledger) AS total FROM ledger ORDER BY ledger.created_at DESC, id DESC LIMIT 50 OFFSET 10")
def h4(spark, sf):
    return LG.list_attestations(LG.record_attestation(requests(spark, sf)), 50, 10).selectExpr(
        "id", "merkle_root", "public_key_hex", f"{stamp('created_at')} AS created_at", "array_join(frameworks_covered, ',') AS frameworks",
        "control_coverage_percent AS coverage", "total")


@query("h5_auditor_verify", f"""WITH {LEDGER}, asked AS (SELECT c_custkey, upper(sha256(c_custkey::VARCHAR)) AS merkle_root, sha256(CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END) AS public_key_hex FROM customer),
hit AS (SELECT c_custkey, l.* FROM asked a JOIN ledger l ON lower(a.merkle_root) = l.merkle_root AND a.public_key_hex = l.public_key_hex QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY id) = 1)
SELECT a.c_custkey, h.id IS NOT NULL AS verified, h.id AS attest_id, coalesce(frameworks, '') AS frameworks, coverage, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS attested_at,
  CASE WHEN h.id IS NULL THEN 'Attestation not found in compliance ledger' ELSE 'Attestation verified in compliance ledger' END AS message FROM asked a LEFT JOIN hit h USING (c_custkey)""")
def h5(spark, sf):
    asked = tables(spark, sf, "customer").selectExpr(
        "c_custkey", "upper(sha2(cast(c_custkey AS string), 256)) AS merkle_root",
        "sha2(CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END, 256) AS public_key_hex")
    return LG.auditor_verify(asked, LG.record_attestation(requests(spark, sf))).selectExpr(
        "c_custkey", "verified", "attest_id", "array_join(frameworks_covered, ',') AS frameworks", "control_coverage_percent AS coverage",
        f"{stamp('attested_at')} AS attested_at", "message")


@query("h5_verify_stored", ORACLES["h5_auditor_verify"])
def h5_stored(spark, sf):
    """The same against a stored ledger of two appends, ids of the orders kept as a column."""
    asked = tables(spark, sf, "customer").selectExpr(
        "c_custkey", "upper(sha2(cast(c_custkey AS string), 256)) AS merkle_root",
        "sha2(CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END, 256) AS public_key_hex")
    path, rows = landing(spark, "ledger"), LG.record_attestation(requests(spark, sf)).withColumnRenamed("id", "order_id")
    for part in (0, 1):
        LS.append_ledger(spark, rows.where(f"order_id % 2 = {part}"), path, 1)
    stored = LS.asked_rows(asked, spark, path).drop("id").withColumnRenamed("order_id", "id")
    return LG.auditor_verify(asked, stored).selectExpr(
        "c_custkey", "verified", "attest_id", "array_join(frameworks_covered, ',') AS frameworks", "control_coverage_percent AS coverage",
        f"{stamp('attested_at')} AS attested_at", "message")


@query("h6_human_attest", f"{ATTEST} SELECT request_id, control_id, framework, role, accepted, missing, evidence_hash, attestation_id, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at FROM human")
def h6(spark, sf):
    return LG.human_attest(attestations(spark, sf), uploads(spark, sf)).selectExpr(
        "request_id", "control_id", "framework", "role", "accepted", "array_join(missing_uploads, ',') AS missing", "evidence_hash",
        "attestation_id", f"{stamp('expires_at')} AS expires_at")


@query("h7_list_human_attestations", f"{ATTEST}, kept AS (SELECT * FROM human WHERE framework = 'GDPR') SELECT attestation_id, control_id, framework, role, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, (SELECT count(*) FROM kept) AS total FROM kept ORDER BY kept.ts DESC, attestation_id DESC LIMIT 50")
def h7(spark, sf):
    people = LG.human_attest(attestations(spark, sf), uploads(spark, sf))
    return LG.list_human_attestations(people, framework="GDPR").selectExpr(
        "attestation_id", "control_id", "framework", "role", f"{stamp('ts')} AS ts", "total")


@query("h8_attestation_expired", f"{ATTEST} SELECT request_id, attestation_id, TIMESTAMP '{AS_OF}' > expires_at AS expired FROM human")
def h8(spark, sf):
    people = LG.human_attest(attestations(spark, sf), uploads(spark, sf))
    return LG.attestation_expired(people, AS_OF).select("request_id", "attestation_id", "expired")


@query("h9_evidence_freshness", f"WITH {CONTROL_LIST}, a AS (SELECT o_orderkey, c.*, datediff('day', o_orderdate::DATE, DATE '{AS_OF[:10]}') AS age_days FROM orders JOIN catalogue c ON c.n = o_orderkey % 21) SELECT o_orderkey, framework, control_id, review_days, expiry_days, age_days::INT AS age_days, age_days > review_days AS review_due, age_days > expiry_days AS expired FROM a")
def h9(spark, sf):
    proof = pairs_from(tables(spark, sf, "orders"), "o_orderkey").selectExpr("o_orderkey", "framework", "control_id", "o_orderdate AS collected_at")
    return LG.evidence_freshness(proof, AS_OF[:10]).drop("collected_at")


@query("h10_signer_identity", "SELECT c_custkey, sha256(sha256(c_custkey::VARCHAR) || ':' || c_mktsegment) AS signer_identity FROM customer")
def h10(spark, sf):
    return tables(spark, sf, "customer").selectExpr(
        "c_custkey", f"{LG.signer_identity('sha2(cast(c_custkey AS string), 256)', 'c_mktsegment')} AS signer_identity")


# --- roll-ups ------------------------------------------------------------------------------------
def rollup_inputs(spark: SparkSession, sf: str):
    files, found = everything(spark, sf)
    return files, *report_tables(files, FN.enrich_controls(found))


SAT = "('VERIFIED_MACHINE', 'VERIFIED_SYSTEM', 'ATTESTED_HUMAN')"


def coverage_sql(framework: str) -> str:
    return f"""{ALL_ENRICHED}, {EVIDENCE_CTE}, {STATES_CTE}, {STANDARDS},
parts AS (SELECT workspace, {framework} AS standard, (state IN {SAT})::INT AS ok FROM states JOIN standards USING (workspace) UNION ALL SELECT workspace, framework, 1 FROM proof
  UNION ALL SELECT workspace, unnest(frameworks), 0 FROM enriched WHERE workspace NOT IN (SELECT workspace FROM states UNION SELECT workspace FROM proof)),
t AS (SELECT workspace, standard, count(*) AS total, sum(ok)::BIGINT AS satisfied FROM parts GROUP BY ALL),
u AS (SELECT workspace, unnest(standards) AS standard FROM standards)
SELECT workspace, standard, coalesce(total, 0) AS total, coalesce(satisfied, 0) AS satisfied, CASE WHEN total > 0 THEN floor(satisfied * 100.0 / total + 0.5)::INT ELSE 100 END AS coverage FROM u LEFT JOIN t USING (workspace, standard)"""


@query("r1_framework_coverage", coverage_sql("CASE WHEN strpos(control_id, '-') > 0 THEN split_part(control_id, '-', 1) ELSE coalesce(list_filter(standards, lambda f: strpos(control_id, f) > 0)[1], standards[1]) END"))
def r1(spark, sf):
    _, enriched, proof, states = rollup_inputs(spark, sf)
    return RU.framework_coverage(FN.standards(enriched), states, proof, enriched)


@query("r1_framework_coverage_normalised", coverage_sql(f"list_filter({ALL_FRAMEWORKS}, lambda f: starts_with(control_id, f || '-'))[1]"))
def r1_normalised(spark, sf):
    _, enriched, proof, states = rollup_inputs(spark, sf)
    return RU.framework_coverage(FN.standards(enriched), states, proof, enriched, normalised=True)


@query("r2_readiness", f"""{ALL_ENRICHED}, {EVIDENCE_CTE}, {STATES_CTE},
s AS (SELECT workspace, state FROM states UNION ALL SELECT workspace, 'VERIFIED_SYSTEM' FROM proof UNION ALL SELECT workspace, 'MISSING_EVIDENCE' FROM enriched WHERE workspace NOT IN (SELECT workspace FROM states UNION SELECT workspace FROM proof)),
c AS (SELECT workspace, {', '.join(f"count(state) FILTER (state = '{x}') AS {x.lower()}" for x in D.CONTROL_STATES)}, count(state) AS n, count(state) FILTER (state IN {SAT}) AS good FROM (SELECT DISTINCT workspace FROM every_file) LEFT JOIN s USING (workspace) GROUP BY workspace)
SELECT * EXCLUDE (n, good), CASE WHEN n > 0 THEN floor(good * 100.0 / n + 0.5)::INT ELSE 0 END AS readiness_percent FROM c""")
def r2(spark, sf):
    files, enriched, proof, states = rollup_inputs(spark, sf)
    return RU.readiness(files, states, proof, enriched)


def final(spark: SparkSession, sf: str) -> DataFrame:
    return FN.finalize(everything(spark, sf)[1])


METHOD = "CASE WHEN lower(control_category) LIKE '%system%' OR lower(control_category) LIKE '%config%' THEN 'system' ELSE 'machine' END"


@query("r3_control_drilldown", f"{ALL_NUMBERED} SELECT workspace, control_id, framework, arg_min(control_category, position) AS control_category, arg_min(auditor_explanation, position) AS description, arg_min(evidence_hash, position) AS evidence_hash, 'MISSING_EVIDENCE' AS state, arg_min({METHOD}, position) AS verification_method, count(*) AS findings_count FROM (SELECT *, coalesce(frameworks[1], 'UNKNOWN') AS framework FROM numbered) GROUP BY workspace, control_id, framework")
def r3(spark, sf):
    return RU.control_drilldown(final(spark, sf))


@query("r3_control_members", f"{ALL_NUMBERED} SELECT workspace, control_id, coalesce(frameworks[1], 'UNKNOWN') AS framework, position, id, file, line, snippet, severity FROM numbered")
def r3_members(spark, sf):
    return RU.control_members(final(spark, sf))


# findings taken as passed: in workspaces with an even last letter all but some files, elsewhere every fifth line
PASSED = "(coalesce(line, 1) % 5 = 0 OR (ascii(right(workspace, 1)) % 2 = 0 AND length(file) % 9 <> 0))"


def some_passed(findings: DataFrame) -> DataFrame:
    return findings.withColumn("control_pass_fail_status", F.expr(f"CASE WHEN {PASSED} THEN 'PASS' ELSE 'FAIL' END"))


STATE = f"CASE WHEN arg_min({PASSED}, position) THEN 'VERIFIED_MACHINE' ELSE 'MISSING_EVIDENCE' END"


@query("r4_control_evidence_view", f"{ALL_NUMBERED} SELECT workspace, control_id, array_to_string(frameworks, ',') AS frameworks, coalesce(min(frameworks[1]), 'UNKNOWN') AS framework, arg_min(control_category, position) AS control_category, {STATE} AS state, arg_min({PASSED}, position) AS evidence_present, count(*) AS findings_count FROM numbered GROUP BY workspace, control_id, array_to_string(frameworks, ',')")
def r4(spark, sf):
    return RU.control_evidence_view(some_passed(final(spark, sf)))


@query("r4_control_state_tallies", f"{ALL_NUMBERED}, v AS (SELECT workspace, {STATE} AS state FROM numbered GROUP BY workspace, control_id, array_to_string(frameworks, ',')) SELECT workspace, count(*) FILTER (state = 'VERIFIED_MACHINE') AS VERIFIED_MACHINE, 0::BIGINT AS VERIFIED_SYSTEM, 0::BIGINT AS ATTESTED_HUMAN, count(*) FILTER (state = 'MISSING_EVIDENCE') AS MISSING_EVIDENCE, 0::BIGINT AS EXPIRED_EVIDENCE FROM v GROUP BY workspace")
def r4_tallies(spark, sf):
    return RU.control_state_tallies(RU.control_evidence_view(some_passed(final(spark, sf))))


RATE = f"cast(round(100.0 * count(*) FILTER ({PASSED}) / count(*)) AS INT)"


@query("r5_compliance_summary", f"{ALL_ENRICHED} SELECT e.workspace, count(*) FILTER (NOT {PASSED.replace('workspace', 'e.workspace')}) AS control_failures, count(*) FILTER ({PASSED.replace('workspace', 'e.workspace')}) AS controls_verified, {RATE.replace('workspace', 'e.workspace')} AS pass_rate, max(coalesce(n, 0)) AS frameworks_covered, count(*) AS evidence_gaps, CASE WHEN {RATE.replace('workspace', 'e.workspace')} >= 80 THEN 'Audit Ready' ELSE 'Evidence Review Required' END AS audit_status FROM enriched e LEFT JOIN (SELECT workspace, count(DISTINCT f) AS n FROM (SELECT workspace, unnest(frameworks) AS f FROM enriched) GROUP BY 1) u USING (workspace) GROUP BY e.workspace")
def r5(spark, sf):
    return RU.compliance_summary(some_passed(FN.enrich_controls(everything(spark, sf)[1])))


@query("r6_severity_histogram", f"{FOUND}, b AS (SELECT * FROM (VALUES ('Critical'), ('High'), ('Medium'), ('Low')) AS t(severity)) SELECT w.workspace, b.severity, count(f.workspace) AS findings FROM (SELECT DISTINCT workspace FROM found) w CROSS JOIN b LEFT JOIN found f ON f.workspace = w.workspace AND f.severity = lower(b.severity) GROUP BY w.workspace, b.severity")
def r6(spark, sf):
    return RU.severity_histogram(few(spark, sf)[1])


@query("r7_framework_order", f"{ENRICHED}, u AS (SELECT workspace, unnest(frameworks) AS framework FROM enriched UNION ALL SELECT workspace, 'OTHER' FROM enriched) SELECT workspace, framework, count(*) AS findings, coalesce(list_position({ALL_FRAMEWORKS}, framework), 8)::INT AS rank FROM u GROUP BY workspace, framework")
def r7(spark, sf):
    found = FN.enrich_controls(few(spark, sf)[1])
    names = found.select("workspace", F.explode(F.expr("concat(compliance_frameworks_affected, array('OTHER'))")).alias("framework"))
    return names.groupBy("workspace", "framework").agg(F.count(F.lit(1)).alias("findings")).withColumn(
        "rank", F.expr(f"cast({RU.framework_rank()} AS int)"))


@query("r8_findings_preview", f"{ALL_NUMBERED} SELECT workspace, id, file, line, type, severity FROM numbered WHERE position <= 6")
def r8(spark, sf):
    return RU.findings_preview(final(spark, sf)).select("workspace", "id", "file", "line", "type", "severity")


@query("r8_newest_attestations", f"WITH {LEDGER} SELECT id, merkle_root, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM ledger ORDER BY ledger.created_at DESC, id DESC LIMIT 50")
def r8_newest(spark, sf):
    return RU.newest(LG.record_attestation(requests(spark, sf)), 50).selectExpr("id", "merkle_root", f"{stamp('created_at')} AS created_at")


# --- similarity ----------------------------------------------------------------------------------
KIND = "CASE WHEN label % 4 < 2 THEN 'hardcoded_secret' ELSE 'weak_authentication' END"


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = tables(spark, sf, "embeddings")
    known = rows.filter("vec_id % 2 = 0").selectExpr(
        "vec_id AS pattern_id", f"{KIND} AS finding_type", "label % 2 = 1 AS is_false_positive", "cast(embedding AS array<double>) AS embedding")
    new = rows.filter("vec_id % 2 = 1").selectExpr(
        "vec_id AS finding_id", f"{KIND} AS finding_type", "label", "cast(embedding AS array<double>) AS embedding")
    return new, known


SCORES = f"""v AS (SELECT vec_id, label, {KIND} AS kind, embedding::DOUBLE[] AS e FROM embeddings),
sims AS (SELECT f.vec_id AS finding_id, p.label % 2 = 1 AS fp, list_cosine_similarity(f.e, p.e) AS s FROM v f JOIN v p ON f.kind = p.kind WHERE f.vec_id % 2 = 1 AND p.vec_id % 2 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY finding_id, fp ORDER BY s DESC) AS r FROM sims QUALIFY r <= 3),
agg AS (SELECT finding_id, coalesce(sum(s * CASE r WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.1 END) FILTER (fp), 0) AS fp_ensemble, coalesce(sum(s * CASE r WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.1 END) FILTER (NOT fp), 0) AS real_ensemble,
  coalesce(max(s) FILTER (fp), 0) AS fp_best, coalesce(max(s) FILTER (NOT fp), 0) AS real_best,
  coalesce(avg(s) FILTER (fp AND r <= 2), 0) AS fp_weight, coalesce(avg(s) FILTER (NOT fp AND r <= 2), 0) AS real_weight, bool_or(fp) AND bool_or(NOT fp) AS both_classes FROM top GROUP BY finding_id),
scored AS (SELECT vec_id AS finding_id, kind AS finding_type, label, agg.* EXCLUDE (finding_id), (label / 10.0)::DOUBLE AS heuristic FROM v JOIN agg ON finding_id = vec_id)"""
SCORE_COLUMNS = ["fp_ensemble", "real_ensemble", "fp_best", "real_best", "fp_weight", "real_weight"]


def rounded(columns) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


@query("v2_topk_ensemble", f"WITH {SCORES} SELECT finding_id, finding_type, {', '.join(f'round({c}, 6) AS {c}' for c in SCORE_COLUMNS)}, both_classes FROM scored")
def v2(spark, sf):
    return VA.topk_ensemble(*vectors(spark, sf)).select("finding_id", "finding_type", *rounded(SCORE_COLUMNS), "both_classes")


def ladder_sql(pick: int) -> str:
    reason = lambda s: f"printf({', '.join([q(s[3]), *s[4]])})" if s[4] else q(s[3])
    return "CASE " + " ".join(f"WHEN {duck_ladder(s[0])} THEN {reason(s) if pick == 3 else duck_ladder(s[pick])}" for s in VA.LADDER) + " END"


def duck_ladder(text: str) -> str:
    return re.sub(r"(?<=[0-9])D\b", "", text)


DECIDED = f"decided AS (SELECT *, {ladder_sql(1)} AS is_valid, ({ladder_sql(2)})::DOUBLE AS ai_confidence, {ladder_sql(3)} AS reason FROM scored)"


def judged(spark: SparkSession, sf: str) -> DataFrame:
    scores = VA.topk_ensemble(*vectors(spark, sf)).withColumn("heuristic", F.expr("label / 10D"))
    return VA.decide(scores)


@query("v3_decide", f"WITH {SCORES}, {DECIDED} SELECT finding_id, is_valid, round(ai_confidence, 6) AS ai_confidence, reason FROM decided")
def v3(spark, sf):
    return judged(spark, sf).select("finding_id", "is_valid", *rounded(["ai_confidence"]), "reason")


@query("v4_blend_confidence", f"WITH {SCORES}, {DECIDED}, b AS (SELECT *, label >= 8 AS mild FROM decided WHERE CASE WHEN label >= 8 THEN is_valid OR ai_confidence >= 0.3 ELSE is_valid END) SELECT finding_id, round(CASE WHEN NOT mild THEN (0.8 + ai_confidence) / 2 WHEN is_valid AND ai_confidence > 0.7 THEN least(0.95, (0.8 + ai_confidence) / 2) ELSE 0.8 END, 6)::DOUBLE AS confidence FROM b")
def v4(spark, sf):
    return VA.blend_confidence(judged(spark, sf).withColumn("confidence", F.lit(0.8)), "label >= 8").select("finding_id", *rounded(["confidence"]))


def heuristic_sql(s: str, c: str, p: str) -> str:
    s, c, p = f"lower({s})", f"lower({c})", f"lower({p})"

    def either(words):
        return f"({O.has(c, words)} OR {O.has(p, words)})"

    ph, tests, real = O.tally(s, N.SCORE_PLACEHOLDER), O.tally(p, N.SCORE_TEST_PATH), O.tally(s, N.SCORE_REAL)
    det = "(" + " + ".join(f"(strpos({c}, {q(n)}) > 0 OR strpos({p}, {q(n)}) > 0)::INT" for n in N.SCORE_DETECTOR) + ")"
    quiet = f"NOT {O.has(c, N.SCORE_DETECTOR)}"
    return (
        f"greatest(0, least(1, 0.5::DOUBLE - CASE WHEN {ph} > 0 THEN least(0.4::DOUBLE, 0.2 + {ph} * 0.1::DOUBLE) ELSE 0 END"
        f" - CASE WHEN {det} > 0 THEN least(0.5::DOUBLE, 0.3 + {det} * 0.1::DOUBLE) ELSE 0 END"
        f" - CASE WHEN {tests} > 0 THEN least(0.3::DOUBLE, 0.15 + {tests} * 0.05::DOUBLE) ELSE 0 END"
        f" - CASE WHEN regexp_matches({p}, '\\.(sln|csproj|vcxproj|vcproj)$') AND {O.rx(s, N.UUID_REGEX)} THEN 0.5 ELSE 0 END"
        f" - CASE WHEN {either(N.SCORE_SECURITY_TOOL)} THEN 0.3 ELSE 0 END"
        f" + CASE WHEN {real} > 0 AND {quiet} THEN least(0.4::DOUBLE, 0.2 + {real} * 0.1::DOUBLE) ELSE 0 END"
        f" + CASE WHEN {O.has(p, N.SCORE_PRODUCTION)} THEN 0.15 ELSE 0 END"
        f" - CASE WHEN {O.has(s, N.SCORE_ENV)} OR {O.has(c, N.SCORE_ENV)} THEN 0.25 ELSE 0 END"
        f" + CASE WHEN {O.has(s, N.SCORE_KNOWN)} AND {quiet} THEN 0.3 ELSE 0 END"
        f" - CASE WHEN {either(N.SCORE_EDUCATIONAL)} THEN 0.2 ELSE 0 END))"
    )


@query("v1_heuristic_score", f"{ASSIGN} SELECT workspace, path, line_no, round({heuristic_sql(O.SNIPPET, 'near3', 'path')}, 6)::DOUBLE AS heuristic FROM a")
def v1(spark, sf):
    from ..functions.text import snippet
    rows = assignments(spark, sf, ("near3",)).withColumn("snippet", F.expr(snippet("line")))
    return VA.with_heuristic(rows, "near3", "path").select("workspace", "path", "line_no", *rounded(["heuristic"]))


KIND4 = "CASE {0} % 4 WHEN 0 THEN 'hardcoded_secret' WHEN 1 THEN 'weak_authentication' WHEN 2 THEN 'command_injection' ELSE 'xss' END"
GROUPED = [(k, i, sql) for k in EN.VALIDATED for i, sql in enumerate(O.DETECTORS[k]())]
JUDGED = [(k, i, sql.replace(" QUALIFY row_number() OVER (PARTITION BY workspace, path ORDER BY line_no) = 1", "").replace("FROM lines", "FROM ctx")
           .replace("SELECT workspace, path AS file,", "SELECT near3, path, workspace, path AS file,", 1)) for k, i, sql in GROUPED if k != "D2" or i > 1]


@query("v4_ensemble_scan", f"""{O.HEAD_CTX}, matched AS ({" UNION ALL ".join(f"SELECT '{k}' AS detector, {i} AS rule, * FROM ({sql})" for k, i, sql in JUDGED)}),
cand AS (SELECT *, row_number() OVER () AS cid, CASE detector WHEN 'D2' THEN 2 * confidence - 0.5 WHEN 'D22' THEN confidence ELSE 2 * confidence - 0.5 END AS c0,
  CASE detector WHEN 'D22' THEN 'xss' ELSE type END AS kind, {heuristic_sql('snippet', 'near3', 'path')} AS heuristic FROM matched),
texts AS (SELECT *, kind || ': ' || snippet || CASE WHEN near3 != '' THEN ' Context: ' || substring(near3, 1, 200) ELSE '' END || ' File: ' || file AS text FROM cand),
counted AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 2 = 1),
placed AS (SELECT *, ('0x' || substr(md5(text), 1, 8))::BIGINT % n AS r FROM texts, counted),
own AS (SELECT vec_id // 2 AS r, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 1),
known AS (SELECT {KIND4.format('(vec_id // 2)')} AS kind, label % 2 = 1 AS fp, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 0),
sims AS (SELECT c.r, k.kind, fp, list_cosine_similarity(own.e, k.e) AS s FROM (SELECT DISTINCT r, kind FROM placed) c JOIN own USING (r) JOIN known k USING (kind)),
top AS (SELECT *, row_number() OVER (PARTITION BY r, kind, fp ORDER BY s DESC) AS z FROM sims QUALIFY z <= 3),
agg AS (SELECT r, kind, coalesce(sum(s * CASE z WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.1 END) FILTER (fp), 0) AS fp_ensemble, coalesce(sum(s * CASE z WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.1 END) FILTER (NOT fp), 0) AS real_ensemble,
  coalesce(max(s) FILTER (fp), 0) AS fp_best, coalesce(max(s) FILTER (NOT fp), 0) AS real_best,
  coalesce(avg(s) FILTER (fp AND z <= 2), 0) AS fp_weight, coalesce(avg(s) FILTER (NOT fp AND z <= 2), 0) AS real_weight, bool_or(fp) AND bool_or(NOT fp) AS both_classes FROM top GROUP BY r, kind),
scored AS (SELECT placed.*, agg.* EXCLUDE (r, kind) FROM placed JOIN agg USING (r, kind)), {DECIDED},
blended AS (SELECT *, CASE WHEN kind <> 'xss' THEN (c0 + ai_confidence) / 2 WHEN is_valid AND ai_confidence > 0.7 THEN least(0.95, (c0 + ai_confidence) / 2) ELSE c0 END AS final
  FROM decided WHERE is_valid OR kind = 'xss' AND ai_confidence >= 0.3),
firsts AS (SELECT * FROM blended QUALIFY row_number() OVER (PARTITION BY detector, rule, workspace, file, CASE WHEN detector = 'D2' THEN line ELSE 0 END ORDER BY line) = 1)
SELECT detector, workspace, file, type, line, snippet, CASE WHEN detector = 'D2' THEN CASE WHEN final >= 0.8 THEN 'high' ELSE 'medium' END ELSE severity END AS severity,
  round(final, 6)::DOUBLE AS confidence, label, reason FROM firsts
UNION ALL SELECT 'D2', workspace, file, type, line, snippet, severity, confidence, label, NULL FROM ({" UNION ALL ".join(sql for k, i, sql in GROUPED if k == "D2" and i <= 1)})""")
def v4_scan(spark, sf):
    """Validation inside D2, D19, D21 and D22; the vector of a text is one of the given embeddings, by the text's hash."""
    rows = tables(spark, sf, "embeddings")
    known = rows.where("vec_id % 2 = 0").selectExpr(
        "vec_id AS pattern_id", f"{KIND4.format('(vec_id div 2)')} AS finding_type", "label % 2 = 1 AS is_false_positive", "cast(embedding AS array<double>) AS embedding")
    own = rows.where("vec_id % 2 = 1").selectExpr("vec_id div 2 AS r", "cast(embedding AS array<double>) AS embedding")
    n = own.count()

    def embed(found: DataFrame) -> DataFrame:
        at = found.withColumn("r", F.expr(f"cast(conv(substr(md5(text), 1, 8), 16, 10) AS bigint) % {n}"))
        return at.join(own, "r").drop("r")

    found = EN.scan_validated(corpus(spark, sf), known, embed)
    label = F.expr("coalesce(metadata['issue'], metadata['weak_cipher'], metadata['secret_type'], '')").alias("label")
    return found.select("detector", *FINDING_COLUMNS, F.round("confidence", 6).alias("confidence"), label, "reason")


# --- remediation ---------------------------------------------------------------------------------
FIXABLE = ["D1", "D9"]
FIX_FOUND = f"{O.HEAD},\n{O.TOOL},\nfound AS MATERIALIZED (\n{O.detector_union(FIXABLE)}\n)"
FIX_NUMBERED = FIX_FOUND + """,
numbered AS (SELECT *, 'F' || lpad(position::VARCHAR, 3, '0') AS id FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY file, coalesce(line, -1), type, snippet, severity, confidence, label) AS position FROM found))"""
VAR, VAL = O.group("l.line", S.ASSIGNMENT, 1), O.group("l.line", S.ASSIGNMENT, 2)
SECRET_FIX = f"""secret_fix AS (SELECT n.workspace, n.file, n.line, n.id, n.type, l.line AS before, regexp_replace(upper({VAR}), '[^A-Z0-9_]', '_', 'g') AS env_var, trim({VAL}, {q(chr(39) + chr(34))}) AS literal,
  regexp_extract(l.line, '^\\s*') || {VAR} || ' = os.getenv(''' || regexp_replace(upper({VAR}), '[^A-Z0-9_]', '_', 'g') || ''', ' || {js(f'trim({VAL}, ' + q(chr(39) + chr(34)) + ')')} || ')' AS after
  FROM numbered n JOIN lines l ON l.workspace = n.workspace AND l.path = n.file AND l.line_no = n.line WHERE n.type = 'hardcoded_secret' AND ends_with(n.file, '.py'))"""
ACL_FIX = """acl_fix AS (SELECT workspace, path AS file, line_no::INT AS line, line AS before, replace(line, 'public-read', 'private') AS after FROM lines WHERE ext = '.tf' AND strpos(line, 'public-read') > 0 QUALIFY row_number() OVER (PARTITION BY workspace, path ORDER BY line_no) = 1)"""


def fixable(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    files = corpus(spark, sf)
    return files, FN.assign_ids(DT.scan_files(files, FIXABLE))


@query("p1_fix_secret_lines", f"{FIX_NUMBERED}, {SECRET_FIX} SELECT workspace, file, line, id AS finding_id, before, after, env_var, literal FROM secret_fix")
def p1(spark, sf):
    files, found = fixable(spark, sf)
    return RM.fix_secret_lines(found, files).select("workspace", "file", "line", F.col("id").alias("finding_id"), "before", "after", "env_var", "literal")


@query("p2_fix_public_acl", f"""{O.HEAD}, {ACL_FIX}, joined AS (SELECT f.workspace, f.file, string_agg(CASE WHEN l.line_no = f.line THEN f.after || chr(10) || {q(chr(10).join(RM.ENCRYPTION_HINT))} ELSE l.line END, chr(10) ORDER BY l.line_no) AS new_content
  FROM acl_fix f JOIN lines l ON l.workspace = f.workspace AND l.path = f.file GROUP BY ALL)
SELECT workspace, file, line, before, after, sha256(new_content) AS content_hash FROM acl_fix JOIN joined USING (workspace, file)""")
def p2(spark, sf):
    return RM.fix_public_acl(corpus(spark, sf)).select("workspace", "file", "line", "before", "after", F.sha2("new_content", 256).alias("content_hash"))


PY_LINES = O.line_table("(SELECT * FROM every_file WHERE ext = '.py')", "pl", "workspace, path")


@query("p3_import_insertion", f"""WITH {O.CORPUS},{PY_LINES},
f AS (SELECT workspace, path, bool_or({O.trimmed('line')} = 'import os') AS has, max(line_no) AS n, bool_or(line_no = 1 AND starts_with(line, '#!'))::INT AS s FROM pl GROUP BY ALL),
o AS (SELECT f.*, pl.line AS opening FROM f LEFT JOIN pl ON pl.workspace = f.workspace AND pl.path = f.path AND pl.line_no = f.s + 1),
c AS (SELECT o.workspace, o.path, min(pl.line_no) AS closing FROM o JOIN pl ON pl.workspace = o.workspace AND pl.path = o.path AND pl.line_no > o.s + 1 AND strpos(pl.line, left(o.opening, 3)) > 0 GROUP BY ALL)
SELECT o.workspace, o.path, (CASE WHEN has THEN NULL WHEN left(opening, 3) IN (repeat(chr(39), 3), repeat(chr(34), 3)) THEN coalesce(closing, n) ELSE s END)::INT AS insert_at
FROM o LEFT JOIN c USING (workspace, path)""")
def p3(spark, sf):
    return RM.import_insertion(corpus(spark, sf))


@query("p4_fix_catalogue", f"""{FIX_NUMBERED}, {SECRET_FIX}, {ACL_FIX}, dim AS (SELECT * FROM {O.values(DIM_ROWS, "d(dtype, d_id, d_category, d_evidence, d_frameworks, d_description, d_explanation)")}),
fixes AS (SELECT workspace, file, line, before, after, id AS finding_id, type FROM secret_fix UNION ALL SELECT a.workspace, a.file, a.line, a.before, a.after, n.id, n.type FROM acl_fix a JOIN numbered n ON n.workspace = a.workspace AND n.file = a.file AND n.type = 'insecure_acl')
SELECT workspace, file, line, before, after, finding_id, type, d_id AS control_id, d_category AS control_category, array_to_string(d_frameworks, ',') AS frameworks, d_description AS description FROM fixes JOIN dim ON dtype = type""")
def p4(spark, sf):
    files, found = fixable(spark, sf)
    return RM.fix_catalogue(found, files).withColumn("frameworks", F.array_join("frameworks", ","))


@query("p5_env_template_entries", f"{FIX_NUMBERED}, {SECRET_FIX}, present AS (SELECT workspace, line FROM lines WHERE path = '.env.template') SELECT s.workspace, env_var || '=' || literal AS entry FROM secret_fix s WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.workspace = s.workspace AND p.line = env_var || '=' || literal)")
def p5(spark, sf):
    files, found = fixable(spark, sf)
    return RM.env_template_entries(RM.fix_secret_lines(found, files), files)


# --- streaming and extensions --------------------------------------------------------------------
STREAM_IDS = ["D5", "D12", "D17"]
STREAM_DOCS = """raw AS (SELECT source AS workspace, 'doc' || doc_id::VARCHAR || '.conf' AS path, text AS content FROM documents)"""


@query("m1_stream_scan", (f"WITH {STREAM_DOCS}, " + O.HEAD.split("named AS", 1)[1].join(["named AS", ""])) + f",\n{O.TOOL}\nSELECT workspace, file, type, line, snippet, severity, round(confidence, 6) AS confidence FROM (\n{O.detector_union(STREAM_IDS)}\n)")
def m1(spark, sf):
    """Documents arrive as configuration files; findings land per micro-batch."""
    schema = tables(spark, sf, "documents").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet")
    files = SF.files_from_table(arriving, "source", "concat('doc', doc_id, '.conf')", "text")
    sink = landing(spark, "stream")
    scan_stream(files, sink, landing(spark, "stream-state"), STREAM_IDS).awaitTermination()
    return spark.read.parquet(sink).select(*FINDING_COLUMNS, F.round("confidence", 6).alias("confidence"))


def write_batches(files: DataFrame, path: str, batches: int) -> int:
    """Files dealt to ``batches`` times as many Parquet files as they have splits; returns the number of Parquet files in a batch.

    No task writes or reads more than a split, however large the files are together.
    """
    splits = files.rdd.getNumPartitions()
    files.repartition(batches * splits, "workspace", "path", "content").write.parquet(path)
    return splits


@query("m1_stream_workspaces", ORACLES["d38_scan_findings"])
def m1_workspaces(spark, sf):
    """The corpus arrives in three micro-batches, each of as many files as the corpus has splits; all detectors, then what is settled over all."""
    columns = "workspace STRING, path STRING, name STRING, ext STRING, content STRING"
    source, state = landing(spark, "arrived"), landing(spark, "workspaces-state")
    arriving = spark.readStream.schema(columns).option("maxFilesPerTrigger", write_batches(corpus(spark, sf), source, 3)).parquet(source)
    scan_stream(arriving, landing(spark, "workspaces"), state).awaitTermination()
    label = F.expr("coalesce(metadata['issue'], metadata['weak_cipher'], metadata['secret_type'], '')").alias("label")
    return settled_findings(spark, state).select("detector", *FINDING_COLUMNS, F.round("confidence", 6).alias("confidence"), label)


@query("u1_python_symbols", f"""WITH {O.CORPUS} SELECT workspace, path, kind, symbol, lineno, nearby FROM every_file
JOIN {SYMBOL_ROWS} ON seed = CASE WHEN {SYM} THEN 'sym' WHEN {SYM2} THEN 'sym2' END""")
def u1(spark, sf):
    return SY.python_symbols(corpus(spark, sf))


@query("u2_canonical_json", f"{O.HEAD} SELECT workspace, path, line_no, {js('line')} AS json FROM lines WHERE regexp_matches(line, '[^ -~]')")
def u2(spark, sf):
    lines = SF.explode_lines(DT.not_excluded(corpus(spark, sf)))
    return lines.filter("line RLIKE '[^ -~]'").selectExpr(
        "workspace", "path", "cast(line_no AS bigint) AS line_no", f"{FN.json_string('line')} AS json")


USER_RULES = [
    UR.UserRule("U-mail", r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]{2,}", (), "line", "personal_data", "medium", 0.6),
    UR.UserRule("U-license", r"license", (".html",), "file", "license_text", "low", 0.5),
]


@query("u3_register_rules", f"{O.HEAD} SELECT workspace, file, type, line, snippet, severity, confidence FROM (" + "\nUNION ALL ".join(
    O.firsts([(USER_RULES[0].pattern, "U-mail")], "true", "personal_data", "medium", "0.6")
    + [O.whole("license_text", f"ext = '.html' AND {O.rx('content', 'license')}", "U-license", "low", "0.5")]) + ")")
def u3(spark, sf):
    return DT.scan_files(corpus(spark, sf), [], extra=UR.register_rules(USER_RULES)).select(*FINDING_COLUMNS, "confidence")


# --- flagship ------------------------------------------------------------------------------------
@query("flagship_secret_report", f"{numbered(FOUND.replace(O.detector_union(BASE), O.detector_union(['D5'])))}, m AS (SELECT workspace, count(*) AS findings, least(100, count(*) * 20)::BIGINT AS risk_score FROM numbered GROUP BY 1) SELECT n.workspace, id, file, line, snippet, control_id, findings, risk_score FROM numbered n JOIN m USING (workspace)")
def flagship(spark, sf):
    """Secrets in configuration files with control, id and the workspace's risk score."""
    found = FN.finalize(DT.scan_files(corpus(spark, sf), ["D5"]))
    metrics = FN.severity_metrics(found).selectExpr("workspace", "critical + high + medium + low AS findings", "cast(risk_score AS bigint) AS risk_score")
    return found.join(metrics, "workspace").select("workspace", "id", "file", "line", "snippet", "control_id", "findings", "risk_score")


@query("full_report_findings", f"""{ALL_NUMBERED} SELECT workspace, detector, type, file, line, snippet, severity, round(confidence, 6) AS confidence, frameworks AS compliance_frameworks_affected,
control_id, control_category, status AS control_pass_fail_status, required_evidence_missing, auditor_explanation, control_state, position, id, evidence_hash FROM numbered""")
def full_report(spark, sf):
    files = corpus(spark, sf)
    return report_findings(files, True).drop("metadata").withColumn("confidence", F.round("confidence", 6))
