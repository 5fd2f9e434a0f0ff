"""The detectors as rule groups over the files table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import gates as G
from ..functions.text import (
    any_rlike, has_any, java, let, lit, match_lines, near, one_of, rlike, snippet, starts_with_any, strip, ends_with_any,
)
from ..rules import code as C, needles as N, secrets as S
from .detect import HIT_LINE, LINE, FileMatches, FileRule, LineRules, LineValues, Piece, apply, candidate, hit, metadata

CODE = one_of("ext", N.CODE_EXTS)
SCRIPT = one_of("ext", [".py", ".js", ".ts", ".php", ".rb"])
NOT_CODE_COMMENT = f"NOT {G.is_comment(LINE, N.COMMENTS_CODE)}"
TEST_NAME = "contains(lname, 'test')"
TEST_LIKE = "(contains(lname, 'test') OR contains(lname, 'spec'))"
EXAMPLE_LIKE = "(contains(lname, 'example') OR contains(lname, 'sample'))"
NOT_DEFINITION = f"NOT {G.is_pattern_definition(LINE)}"


def around(before: int, after: int) -> str:
    return f"lower({near('no', before, after)})"


def group(line: str, pattern: str, index: int = 1) -> str:
    return f"regexp_extract({line}, {lit(java(pattern))}, {index})"


def file_row(detector: str, kind: str, text: str, severity: str, confidence: str, meta: dict[str, str] | None = None) -> str:
    return hit(detector, kind, "NULL", lit(text), lit(severity), confidence,
               metadata({k: lit(v) for k, v in (meta or {}).items()}))


def line_rules(detector: str, rules, files: str, kind: str, severity: str, confidence: str, meta=None, **more) -> LineRules:
    """A group with constant severity and metadata and the five-prefix comment gate."""
    gate = more.pop("lines", "true")
    comment = more.pop("comment", NOT_CODE_COMMENT)
    return LineRules(
        detector, rules, files, kind, lit(severity), confidence,
        lines=f"{comment} AND {gate}" if gate != "true" else comment,
        meta={k: lit(v) for k, v in (meta or {}).items()}, **more)


PEM = "(contains(content, '-----BEGIN') AND contains(content, 'PRIVATE KEY'))"


def blended(confidence: str, validation: str) -> str:
    """With the similarity model switched off its neutral score of one half is still averaged in."""
    return f"(({confidence}) + 0.5D) / 2D" if validation == "disabled" else confidence


def secret_assignment(line: str, pattern: str) -> str:
    var, value = group(line, pattern, 1), group(line, pattern, 2)
    real = let("clean", G.unquote(value), f"clean != '' AND {G.looks_like_secret('clean')} AND NOT {G.is_test_data('clean')}")
    return f"(NOT {G.is_env_reference(value)} AND {let('var', var, G.has_secret_keyword('var'))} AND {real})"


def d1() -> list[Piece]:
    confidence = (
        f"0.9D * CASE WHEN {TEST_LIKE} THEN 0.7D ELSE 1.0D END * CASE WHEN {EXAMPLE_LIKE} THEN 0.6D ELSE 1.0D END"
    )
    return [LineRules(
        "D1", [(S.ASSIGNMENT, "")], "(ext = '.py' AND NOT detector_code)", "hardcoded_secret", lit("high"), confidence,
        lines=f"NOT {G.is_comment(LINE, N.COMMENTS_PY)} AND {NOT_DEFINITION}", accept=secret_assignment,
        tool_confidence=f"{confidence} * 0.6D", label=None, per="line",
        meta={"is_test_file": TEST_LIKE, "is_example_file": EXAMPLE_LIKE})]


def d2(validation: str) -> list[Piece]:
    files = f"({one_of('ext', N.CODE_SECRET_EXTS)} AND NOT detector_code)"
    open_line = f"NOT {G.is_code_placeholder_line(LINE)}"

    def confidence(of: str, line: str) -> str:
        return G.code_confidence(of, TEST_LIKE, EXAMPLE_LIKE, G.is_comment(line, N.COMMENTS_MARKUP))

    accept = let("u", G.unquote_space("v"), (
        f"v != '' AND NOT {G.is_placeholder_value('u')} AND length(u) >= 3 AND {confidence('u', LINE)} >= 0.4D"))
    score = blended(let("u", G.unquote_space("h.value"), confidence("u", HIT_LINE)), validation)
    row = let("score", score, hit(
        "D2", "hardcoded_secret", "h.no", snippet(HIT_LINE), "CASE WHEN score >= 0.8D THEN 'high' ELSE 'medium' END", "score",
        metadata({"language": "ext", "pattern": lit("code_file_scan"), "is_test_file": TEST_LIKE,
                  "is_example_file": EXAMPLE_LIKE, "is_comment": G.is_comment(HIT_LINE, N.COMMENTS_MARKUP)})))
    return [
        FileRule(files, PEM, hit("D2", "hardcoded_secret", "NULL", lit("SSH private key detected in file"),
                                 lit("critical"), "0.99D",
                                 metadata({"language": "ext", "pattern": lit("ssh_private_key"),
                                           "secret_type": lit("SSH_PRIVATE_KEY")}))),
        LineRules("D2", [(S.EMPTY_PASSWORD, "Empty password detected")], files, "hardcoded_secret", lit("high"), "0.95D",
                  lines=open_line, per="line", meta={"language": "ext", "pattern": lit("empty_password")}),
        LineValues("D2", S.CODE_VALUES, files, f"{open_line} AND NOT {rlike(LINE, S.EMPTY_PASSWORD)}", accept, row),
    ]




def d3() -> list[Piece]:
    value = f"coalesce(nullif({group('m.match', '(?s)' + S.PHP_ARRAY, 1)}, ''), {group('m.match', '(?s)' + S.PHP_ARRAY, 2)})"
    found = (
        f"filter({match_lines('content', S.PHP_ARRAY, 'is')}, m -> length({strip(value)}) >= 3"
        f" AND NOT {one_of(f'upper({G.unquote_space(value)})', N.PHP_PLACEHOLDER_VALUES)})"
    )
    row = hit("D3", "hardcoded_secret", "m.line_no", "substring(m.match, 1, 200)", lit("critical"), "0.9D",
              metadata({"language": lit("php"), "pattern": lit("php_array_password"),
                        "secret_type": lit("HARDCODED_PASSWORD")}))
    return [FileMatches("(ext = '.php' AND NOT detector_code)", found, row, (S.PHP_ARRAY,))]


def d4() -> list[Piece]:
    def accept(line: str, pattern: str) -> str:
        value = group(line, pattern)
        return (
            f"(length({strip(value)}) >= 3"
            f" AND NOT {one_of(f'upper({G.unquote_space(value)})', N.JAVA_PLACEHOLDER_VALUES)})"
        )

    return [LineRules("D4", [(S.JAVA_SIMPLE, "")], "(ext = '.java' AND NOT detector_code)", "hardcoded_secret",
                      lit("critical"), "0.9D", accept=accept, per="line", label=None,
                      meta={"language": lit("java"), "pattern": lit("java_simple_password"),
                            "secret_type": lit("HARDCODED_PASSWORD")})]


TEXT_FILE = f"(ext != '.py' AND NOT {ends_with_any('name', N.ENV_TEMPLATE_SUFFIXES)})"
IAC_FILE = one_of("lower(ext)", N.IAC_EXTS)
CONFIG_LINE = f"NOT {G.is_comment(LINE, N.COMMENTS_PY)} AND NOT {G.is_config_placeholder_line(LINE)}"


def d5() -> list[Piece]:
    files = f"({TEXT_FILE} AND ({one_of('lower(ext)', N.SECRET_TEXT_EXTS)} OR startswith(name, '.env')))"
    lines = f"{CONFIG_LINE} AND NOT ({IAC_FILE} AND contains({LINE}, {lit(N.PUBLIC_ACL_MARKER)}))"
    return [LineRules("D5", [(S.ASSIGNMENT, "")], files, "hardcoded_secret", lit("high"), "0.9D", lines=lines,
                      accept=secret_assignment, tool_confidence="0.6D", label=None, per="line",
                      meta={"file_type": "lower(ext)"})]


def d6() -> list[Piece]:
    return [LineRules("D6", [(N.PUBLIC_ACL_MARKER, "")], f"({TEXT_FILE} AND {IAC_FILE})", "insecure_acl", lit("high"), "0.9D",
                      lines=f"{CONFIG_LINE} AND contains({LINE}, {lit(N.PUBLIC_ACL_MARKER)})", label=None, per="line",
                      text=strip(HIT_LINE))]


def d7() -> list[Piece]:
    files = f"({one_of('ext', N.KEY_EXTS)} OR contains(lname, 'key') OR contains(lname, 'private'))"
    return [FileRule(files, PEM, hit("D7", "hardcoded_secret", "NULL", lit("SSH private key file detected"), lit("critical"),
                                     "0.99D", metadata({"secret_type": lit("SSH_PRIVATE_KEY"), "file_type": "ext"})))]


def d8() -> list[Piece]:
    rules = [(provider, pattern, label) for provider, known in S.CLOUD.items() for pattern, label in known]
    every = ", ".join(
        f"CASE WHEN {candidate([pattern])} THEN transform(regexp_extract_all(content, {lit(java(pattern))}, 0), "
        f"v -> named_struct('value', v, 'rule', {k})) END" for k, (_, pattern, _) in enumerate(rules))
    found = f"filter(flatten(array_compact(array({every}))), m -> NOT {G.is_test_data('m.value')})"
    names = "array(" + ", ".join(lit(provider) for provider, _, _ in rules) + ")"
    labels = "array(" + ", ".join(lit(label) for _, _, label in rules) + ")"
    row = hit("D8", "hardcoded_secret", "NULL", "substring(m.value, 1, 200)", lit("critical"), "0.95D",
              metadata({"provider": f"{names}[m.rule]", "secret_type": f"{labels}[m.rule]"}), "0.7D")
    return [FileMatches("(lower(ext) != '.sln' AND NOT test_file)", found, row, tuple(p for _, p, _ in rules))]


def d9() -> list[Piece]:
    tf = "ext = '.tf'"
    return [
        LineRules("D9", [(N.PUBLIC_ACL_MARKER, "")], tf, "insecure_acl", lit("high"), "0.9D",
                  lines=f"contains({LINE}, {lit(N.PUBLIC_ACL_MARKER)})", label=None, per="line"),
        FileRule(tf, rlike("content", C.WILDCARD_QUOTED, ""),
                 file_row("D9", "insecure_acl", "IAM policy with wildcard permissions", "high", "0.9D",
                          {"issue": "Wildcard permissions in IAM policy"})),
        FileRule(tf, rlike("content", C.NO_AUTHORIZATION),
                 file_row("D9", "unauthenticated_api_endpoint", "Public API endpoint without authorization", "high", "0.9D"),
                 (C.NO_AUTHORIZATION,)),
        FileRule(tf, rlike("content", C.PUBLIC_ACCESS),
                 file_row("D9", "insecure_acl", "Public network access enabled", "high", "0.9D"), (C.PUBLIC_ACCESS,)),
    ]


def d10() -> list[Piece]:
    files = (
        f"(({one_of('ext', ['.yaml', '.yml', '.json'])} OR {one_of('name', N.COMPOSE_NAMES)})"
        f" AND {has_any('lname', N.CONTAINER_NAME_NEEDLES)})"
    )
    return [
        FileRule(files, any_rlike("content", C.ROOT_USER, ""),
                 file_row("D10", "container_runs_as_root", "Container runs as root user", "high", "0.9D")),
        FileRule(files, rlike("content", C.PRIVILEGE_ESCALATION, ""),
                 file_row("D10", "insecure_acl", "Privilege escalation enabled", "high", "0.9D")),
        FileRule(files, any_rlike("content", C.DOCKER_SOCKET, ""),
                 file_row("D10", "insecure_acl", "Docker socket exposed to container", "high", "0.9D",
                          {"control_id": "SOC2-CC6.1", "compliance_frameworks": "SOC2,ISO27001"})),
        FileRule(files, "NOT contains(content, 'securityContext') AND NOT contains(content, 'SecurityContext')",
                 file_row("D10", "missing_security_context", "Missing security context in container configuration",
                          "medium", "0.8D")),
    ]


def d11() -> list[Piece]:
    return [FileRule(
        CODE, f"{rlike('content', C.AUTH_DECORATOR)} AND NOT {rlike('content', C.LOGGER_CALL)}",
        file_row("D11", "dpdp_missing_access_logging", "Authentication middleware found but no access logging",
                 "medium", "0.75D"), (C.AUTH_DECORATOR,))]


NO_DB_ENCRYPTION = "NOT contains(lc, 'encrypt') AND NOT contains(lc, 'sqlcipher')"


def d12() -> list[Piece]:
    files = one_of("ext", N.CODE_EXTS + [".sql"])
    return [
        FileRule(files, rlike("content", C.DB_EMPTY_PASSWORD),
                 file_row("D12", "hardcoded_secret", "Empty password in database connection", "high", "0.95D"),
                 (C.DB_EMPTY_PASSWORD,)),
        FileRule(files, rlike("content", C.DB_LITERAL_PASSWORD),
                 file_row("D12", "hardcoded_secret", "Plaintext password in database connection string", "high", "0.9D"),
                 (C.DB_LITERAL_PASSWORD,)),
        FileRule(files, f"{rlike('content', C.DB_JDBC)} AND NOT contains(content, 'useSSL=true')",
                 file_row("D12", "unencrypted_database_connection", "Unencrypted database connection detected", "high", "0.85D"),
                 (C.DB_JDBC,)),
        FileRule(files, f"{any_rlike('content', C.SQLITE)} AND {NO_DB_ENCRYPTION}",
                 file_row("D12", "unencrypted_database", "SQLite database without encryption (GDPR Article 32, SOC2-CC6.1)",
                          "high", "0.9D", {"control_id": "SOC2-CC6.1", "compliance_frameworks": "GDPR,SOC2,HIPAA"}),
                 tuple(C.SQLITE)),
    ]


def d13() -> list[Piece]:
    files = (
        f"({has_any('path', N.CICD_PATHS)} OR ({one_of('ext', ['.yml', '.yaml', '.json'])}"
        f" AND ({has_any('path', ['.github', '.gitlab', '.circleci'])} OR contains(lname, 'jenkins'))))"
    )
    change = {"control_id": "SOC2-CC8.1"}
    return [
        line_rules("D13", S.PIPELINE_SECRETS, files, "hardcoded_secret", "critical", "0.95D",
                   {"secret_type": "CI_CD_SECRET", "control_id": "SOC2-CC6.2"}),
        FileRule(files, f"NOT {has_any('lc', ['sign', 'gpg', 'cosign'])}",
                 file_row("D13", "unsigned_artifacts", "CI/CD pipeline does not sign artifacts", "medium", "0.7D", change)),
        FileRule(files, rlike("content", C.LATEST_PULL),
                 file_row("D13", "unpinned_dependency", "Docker image pulled with :latest tag (unpinned)", "medium", "0.8D", change)),
        FileRule(files, f"NOT {rlike('content', C.DEPENDENCY_SCANNER)}",
                 file_row("D13", "missing_dependency_lock", "CI/CD pipeline missing dependency vulnerability scanning",
                          "medium", "0.75D", change)),
        FileRule(files, f"NOT {rlike('content', C.SECURITY_SCAN)}",
                 file_row("D13", "missing_logging", "CI/CD pipeline missing security scanning", "medium", "0.7D",
                          {"control_id": "SOC2-CC7.2"})),
    ]


def d15() -> list[Piece]:
    return [line_rules(
        "D15", S.FRONTEND_STORAGE, f"({one_of('ext', ['.js', '.ts', '.jsx', '.tsx', '.vue'])} AND NOT detector_code)",
        "insecure_secret_storage", "high", "0.9D",
        {"control_id": "SOC2-CC6.2", "compliance_frameworks": "SOC2,GDPR,PCI-DSS",
         "vulnerability_type": "frontend_secret_storage"},
        comment=f"NOT {G.is_comment(LINE, N.COMMENTS_FRONTEND)}")]


def d16() -> list[Piece]:
    files = (
        f"(({one_of('name', N.CONFIG_NAMES)} OR {one_of('ext', ['.env', '.conf', '.config', '.ini'])}"
        f" OR (ext = '.py' AND {has_any('lname', ['config', 'settings', 'database'])})) AND NOT detector_code)"
    )
    fixed = "(NOT contains(lc, 'production') AND NOT contains(content, 'os.getenv') AND NOT contains(content, 'os.environ'))"
    cors = LineRules(
        "D16",
        [(C.CORS_WILDCARD, "CORS allows all origins (wildcard)"),
         (C.CORS_LOCALHOST, "CORS hardcoded to localhost (should be configurable for production)")],
        files, "insecure_configuration", "CASE WHEN h.rule = 0 THEN 'medium' ELSE 'low' END",
        "CASE WHEN h.rule = 0 THEN 0.85D ELSE 0.7D END",
        accept=lambda line, p: fixed if p == C.CORS_LOCALHOST else "true", per="file",
        meta={"control_id": lit("SOC2-CC6.1"), "compliance_frameworks": lit("SOC2"),
              "vulnerability_type": lit("cors_misconfiguration")})
    sqlite = FileRule(
        files, f"{rlike('content', C.SQLITE_FILE)} AND {NO_DB_ENCRYPTION}",
        file_row("D16", "unencrypted_database", "SQLite database configuration without encryption", "high", "0.9D",
                 {"control_id": "SOC2-CC6.1", "compliance_frameworks": "GDPR,SOC2,HIPAA",
                  "vulnerability_type": "database_encryption"}), (C.SQLITE_FILE,))
    return [cors, sqlite]


def d17() -> list[Piece]:
    files, article = f"({CODE} AND NOT detector_code)", {"control_id": "GDPR-Article-32"}
    return [
        line_rules("D17", C.WEAK_CIPHERS, f"({files} AND NOT {TEST_NAME})", "weak_encryption", "high", "0.9D", article,
                   label="weak_cipher"),
        line_rules("D17", C.TLS_SETTINGS, files, "weak_encryption", "high", "0.85D", article),
    ]


def d18() -> list[Piece]:
    return [
        line_rules("D18", C.SQL_INJECTION, f"({CODE} AND NOT detector_code)", "potential_sql_injection", "high", "0.75D",
                   {"control_id": "SOC2-CC6.1", "vulnerability_type": "sql_injection"},
                   lines=f"{NOT_DEFINITION} AND NOT {G.orm_only(around(4, 5))}"),
        line_rules("D18", C.NOSQL_INJECTION, CODE, "potential_sql_injection", "high", "0.75D",
                   {"control_id": "SOC2-CC6.1", "vulnerability_type": "nosql_injection"}),
    ]


def d19(validation: str) -> list[Piece]:
    files = f"({CODE} AND NOT {TEST_NAME})"

    def real_key(line: str, pattern: str) -> str:
        placeholder = f"({one_of('v', N.FLASK_PLACEHOLDER_VALUES)} OR contains(v, 'KEEP IT SECRET'))"
        return let("v", f"upper({group(line, pattern)})", f"NOT {placeholder}")

    return [
        line_rules("D19", C.WEAK_AUTH, files, "weak_authentication", "high", blended("0.8D", validation),
                   {"control_id": "SOC2-CC6.1"}, lines=f"NOT {has_any(around(4, 5), N.HASHING_NEEDLES)}"),
        line_rules("D19", C.FLASK_SECRET_KEY, files, "hardcoded_secret", "high", blended("0.9D", validation),
                   {"control_id": "SOC2-CC6.2"}, accept=real_key),
    ]


def d20() -> list[Piece]:
    kind = f"CASE WHEN {has_any(HIT_LINE, ['system(', 'exec(', 'eval('])} THEN 'command execution' ELSE 'authentication' END"
    return [LineRules(
        "D20", [(p, "") for p in C.AUTH_CALLS], CODE, "missing_logging", lit("medium"), "0.75D",
        lines=f"{NOT_CODE_COMMENT} AND NOT {any_rlike(near('no', 9, 10), C.LOGGING_CALLS)}", label=None, per="file",
        meta={"issue": f"concat('Missing security event logging for ', {kind})", "control_id": lit("SOC2-CC7.2"),
              "auth_type": kind})]


def d21(validation: str) -> list[Piece]:
    return [line_rules(
        "D21", C.COMMAND_INJECTION, SCRIPT, "command_injection", "critical",
        blended(f"CASE WHEN {TEST_NAME} THEN 0.6D ELSE 0.9D END", validation),
        {"vulnerability": "command_injection", "control_id": "SOC2-CC6.1", "cwe": "CWE-78"})]


def d22() -> list[Piece]:
    markup = f"{has_any(f'lower({LINE})', ['innerhtml', 'outerhtml'])}"
    harmless = (
        f"({markup} AND ({rlike(LINE, C.XSS_CONSTANT_ASSIGNMENT)} OR {rlike(LINE, C.XSS_DOM_ASSIGNMENT)} OR {TEST_LIKE}))"
    )
    lines = (
        f"{NOT_DEFINITION} AND (contains(lower({LINE}), '|safe')"
        f" OR (NOT {has_any(around(2, 3), N.SANITIZER_NEEDLES)} AND NOT {harmless}))"
    )
    return [line_rules(
        "D22", C.XSS, f"({one_of('ext', C.XSS_EXTS)} AND NOT detector_code)", "potential_sql_injection", "high",
        f"CASE WHEN {TEST_NAME} THEN 0.6D ELSE 0.85D END", {"vulnerability": "xss", "control_id": "SOC2-CC6.1"},
        comment=f"NOT {G.is_comment(LINE, N.COMMENTS_MARKUP)}", lines=lines)]


def d23() -> list[Piece]:
    files = (
        f"({one_of('ext', ['.py', '.js', '.ts', '.env', '.config', '.conf'])} AND NOT detector_code"
        f" AND NOT {TEST_NAME} AND NOT array_contains(split(path, '/'), 'test'))"
    )
    return [line_rules("D23", C.DEBUG_MODE, files, "insecure_configuration", "medium", "0.9D",
                       {"control_id": "SOC2-CC7.2"}, lines=NOT_DEFINITION)]


def d24() -> list[Piece]:
    # every label names a missing flag or an "insecure" cookie, so the user-input gate never drops a row
    return [line_rules("D24", C.COOKIES, f"({SCRIPT} AND NOT detector_code)", "insecure_configuration", "high", "0.85D",
                       {"control_id": "SOC2-CC6.1"}, lines=NOT_DEFINITION)]


def d25() -> list[Piece]:
    files = one_of("ext", N.CODE_EXTS + [".yaml", ".yml", ".json", ".env"])
    quiet = f"({files} AND NOT test_file)"

    def real(line: str, pattern: str) -> str:
        # the file part of the test-data gate is in ``quiet``; project files are not among the extensions
        return let("v", f"lower({group(line, pattern)})", f"NOT {has_any('v', N.TEST_VALUE_NEEDLES)}")

    return [
        line_rules("D25", S.JWT_SECRETS, quiet, "hardcoded_secret", "critical", "0.9D", {"secret_type": "JWT_SECRET"},
                   accept=real, tool_confidence="0.7D",
                   lines=f"NOT {has_any(f'lower({LINE})', ['example', 'placeholder'])}"),
        line_rules("D25", S.OAUTH_SECRETS, quiet, "hardcoded_secret", "critical", "0.9D", {"secret_type": "OAUTH_SECRET"},
                   accept=real, tool_confidence="0.7D"),
        line_rules("D25", S.SESSION_SECRETS, quiet, "hardcoded_secret", "high", "0.85D", {"secret_type": "SESSION_SECRET"},
                   accept=real, tool_confidence="0.6D"),
        line_rules("D25", S.ENCRYPTION_KEYS, files, "hardcoded_secret", "critical", "0.95D", {"secret_type": "ENCRYPTION_KEY"}),
        line_rules("D25", S.API_KEY_IN_URL, files, "api_key_in_url", "high", "0.8D"),
    ]


def d26() -> list[Piece]:
    def whole(rules, flags: str, text: str, severity: str, confidence: str) -> FileRule:
        label = "CASE " + " ".join(f"WHEN {rlike('content', p, flags)} THEN {lit(d)}" for p, d in rules) + " END"
        return FileRule(CODE, any_rlike("content", [p for p, _ in rules], flags),
                        hit("D26", "weak_authentication", "NULL", lit(text), lit(severity), confidence,
                            metadata({"issue": label, "control_id": lit("SOC2-CC6.1")})), tuple(p for p, _ in rules))

    return [
        line_rules("D26", C.SESSION_SETTINGS, CODE, "weak_authentication", "high", "0.85D", {"control_id": "SOC2-CC6.1"}),
        whole(C.JWT_EXPIRY, "ims", "JWT token without expiration", "high", "0.8D"),
        whole(C.CSRF, "i", "Missing CSRF protection", "medium", "0.75D"),
    ]


def d27() -> list[Piece]:
    files = one_of("ext", C.INSECURE_CONFIG_EXTS)
    return [
        line_rules("D27", C.INSECURE_DEBUG, f"({files} AND NOT {TEST_NAME})", "insecure_acl", "high", "0.9D",
                   {"vulnerability": "debug_mode_enabled"}),
        line_rules("D27", C.INSECURE_CORS, files, "insecure_acl", "medium", "0.8D", {"vulnerability": "insecure_cors"}),
        line_rules("D27", C.INSECURE_COOKIE_FLAGS, files, "weak_authentication", "high", "0.85D",
                   {"vulnerability": "insecure_cookies"}),
    ]


def d28() -> list[Piece]:
    files = f"({CODE} AND NOT detector_code)"
    outside = (
        f"NOT {any_rlike(LINE, C.NORMAL_FILE_OPS)} AND NOT {has_any(LINE, N.PATH_JOIN_NEEDLES)}"
        f" AND {has_any(around(4, 5), N.PATH_INPUT_NEEDLES)}"
    )
    return [
        line_rules("D28", C.PATH_ACCESS, files, "insecure_acl", "high", "0.8D", {"vulnerability": "path_traversal"}, lines=outside),
        line_rules("D28", C.INPUT_ACCESS, files, "insecure_acl", "medium", "0.7D",
                   {"vulnerability": "missing_input_validation"},
                   lines=f"NOT {has_any(around(2, 3), N.VALIDATOR_NEEDLES)}"),
    ]


def d29() -> list[Piece]:
    return [
        line_rules("D29", C.LOG_INJECTION, CODE, "missing_logging", "medium", "0.75D",
                   {"vulnerability": "log_injection", "control_id": "SOC2-CC7.2"}),
        line_rules("D29", C.SENSITIVE_LOGS, CODE, "missing_logging", "high", "0.85D",
                   {"vulnerability": "sensitive_data_in_logs", "control_id": "SOC2-CC7.2"}),
    ]


def d30() -> list[Piece]:
    files = one_of("ext", N.CODE_EXTS + [".yaml", ".yml"])
    return [
        line_rules("D30", C.ENCRYPTION_AT_REST, files, "weak_encryption", "high", "0.85D", {"control_id": "GDPR-Article-32"}),
        line_rules("D30", C.PII_IN_ERRORS, files, "weak_encryption", "medium", "0.75D",
                   {"vulnerability": "pii_in_errors", "control_id": "GDPR-Article-32"}),
    ]


def d31() -> list[Piece]:
    files = (
        f"({one_of('name', N.SUPPLY_CHAIN_NAMES)} OR {one_of('ext', ['.yaml', '.yml', '.json', '.py', '.js', '.ts'])})"
    )
    return [
        line_rules("D31", S.SUPPLY_CHAIN_SECRETS, files, "hardcoded_secret", "critical", "0.95D", {"secret_type": "CI_CD_SECRET"}),
        line_rules("D31", C.REGISTRIES, files, "insecure_acl", "medium", "0.8D", {"vulnerability": "insecure_registry"}),
    ]


def d32() -> list[Piece]:
    return [line_rules("D32", C.XXE, CODE, "xxe_injection", "high", "0.85D",
                       {"vulnerability": "xxe", "control_id": "SOC2-CC6.1", "cwe": "CWE-611"},
                       lines=f"NOT {has_any(around(9, 10), N.XXE_GUARDS)}")]


def d33() -> list[Piece]:
    return [line_rules("D33", C.SSRF, CODE, "ssrf", "high", "0.8D",
                       {"vulnerability": "ssrf", "control_id": "SOC2-CC6.1", "cwe": "CWE-918"},
                       lines=f"NOT {has_any(around(9, 10), N.SSRF_GUARDS)}")]


def d34() -> list[Piece]:
    return [line_rules("D34", C.DESERIALIZATION, CODE, "insecure_deserialization", "critical", "0.9D",
                       {"vulnerability": "insecure_deserialization", "control_id": "SOC2-CC6.1", "cwe": "CWE-502"})]


def d35() -> list[Piece]:
    return [line_rules("D35", C.PATH_TRAVERSAL, CODE, "insecure_acl", "high", "0.85D",
                       {"vulnerability": "path_traversal", "control_id": "SOC2-CC6.1"},
                       lines=f"NOT {has_any(around(4, 5), N.TRAVERSAL_GUARDS)}")]


def d36() -> list[Piece]:
    def operation(no: str) -> str:
        later = f"array({no} + 2, {no} + 3, {no} + 4, {no} + 5)"
        return f"get(filter({later}, k -> k <= size(lines) AND {rlike('get(lines, k - 1)', C.FILE_OPERATION)}), 0)"

    text = (
        f"concat({snippet(HIT_LINE, 100)}, ' ... ', {snippet('get(lines, ' + operation('h.no') + ' - 1)', 100)})"
    )
    return [LineRules("D36", [(C.EXISTS_CHECK, "TOCTOU: exists() check followed by file operation (race condition)")],
                      CODE, "insecure_acl", lit("medium"), "0.7D", lines=f"{operation('no')} IS NOT NULL", per="line",
                      text=text, meta={"vulnerability": lit("race_condition"), "control_id": lit("SOC2-CC6.1")})]


def d37() -> list[Piece]:
    return [line_rules("D37", C.CRYPTO_MISUSE, CODE, "weak_encryption", "high", "0.85D",
                       {"vulnerability": "crypto_misuse", "control_id": "SOC2-CC6.2"})]


BUILDERS = {
    "D1": d1, "D2": d2, "D3": d3, "D4": d4, "D5": d5, "D6": d6, "D7": d7, "D8": d8, "D9": d9, "D10": d10,
    "D11": d11, "D12": d12, "D13": d13, "D15": d15, "D16": d16, "D17": d17, "D18": d18, "D19": d19, "D20": d20,
    "D21": d21, "D22": d22, "D23": d23, "D24": d24, "D25": d25, "D26": d26, "D27": d27, "D28": d28, "D29": d29,
    "D30": d30, "D31": d31, "D32": d32, "D33": d33, "D34": d34, "D35": d35, "D36": d36, "D37": d37,
}
VALIDATED = {"D2", "D19", "D21"}
TOOL_AWARE = {"D1", "D5", "D8", "D25"}


def pieces_for(ids: list[str], validation: str = "disabled") -> list[Piece]:
    if validation not in ("disabled", "off"):
        raise ValueError("validation is 'disabled' or 'off'; 'ensemble' needs patterns and vectors, see operators.ensemble")
    out: list[Piece] = []
    for key in ids:
        build = BUILDERS[key]
        out += build(validation) if key in VALIDATED else build()
    return out


def not_excluded(files: DataFrame, extra_names: tuple[str, ...] = ()) -> DataFrame:
    """Files outside the excluded directories and names; parts are those of the relative path."""
    return files.filter(f"NOT {G.excluded_path('split(path, ' + lit('/') + ')', extra_names=extra_names)}")


def security_tools(files: DataFrame) -> DataFrame:
    """Workspaces whose root README calls them a security tool; their name is tested where it is used."""
    return (
        files.filter(G.readme_flag(N.SECURITY_TOOL_README)).select("workspace").distinct()
        .withColumn("tool_readme", F.lit(True))
    )


def scan_files(files: DataFrame, ids: list[str] | None = None, validation: str = "disabled",
               extra: list[Piece] | None = None, excluded_names: tuple[str, ...] = (), tools: DataFrame | None = None) -> DataFrame:
    """Raw findings of the per-file detectors.

    Only findings, never file contents, are joined with the workspace flag. ``tools`` are the workspaces that
    ``security_tools`` finds; without it they are looked for in ``files``, which must then hold ignored files too.
    """
    ids = list(BUILDERS) if ids is None else ids
    found = apply(not_excluded(files, excluded_names), pieces_for(ids, validation) + list(extra or []))
    if not TOOL_AWARE & set(ids):
        return found.select(*RAW)
    return with_tools(found, security_tools(files) if tools is None else tools)


RAW = ["workspace", "detector", "type", "file", "line", "snippet", "severity", "confidence", "metadata"]


def with_tools(found: DataFrame, tools: DataFrame) -> DataFrame:
    """Hits with the lower confidence that some detectors have in workspaces of security tools."""
    named = has_any(G.workspace_name(), N.SECURITY_TOOL_NAMES)
    tool = F.expr(f"(coalesce(tool_readme, false) OR {named}) AND tool_confidence IS NOT NULL")
    marked = found.join(tools, "workspace", "left")
    return marked.withColumn("confidence", F.when(tool, F.col("tool_confidence")).otherwise(F.col("confidence"))).select(*RAW)
