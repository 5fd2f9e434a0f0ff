"""The same results stated relationally for DuckDB, to check the Spark plans against.

Nothing here is used at run time. Lines are unnested rows, first hits are window ranks,
neighbourhoods are window frames, classes of a regex are RE2's; fixed values come from ``rules``.
"""

from __future__ import annotations

from ..rules import code as C, dimensions as D, needles as N, practice as P, secrets as S
from .corpus import N_SEEDS, SEEDS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(expr: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({expr}, {q(pattern)}, {q(flags)})" if flags else f"regexp_matches({expr}, {q(pattern)})"


def any_rx(expr: str, patterns, flags: str = "i") -> str:
    return "(" + " OR ".join(rx(expr, p, flags) for p in patterns) + ")"


def has(expr: str, words) -> str:
    return "(" + " OR ".join(f"strpos({expr}, {q(w)}) > 0" for w in words) + ")"


def tally(expr: str, words) -> str:
    return "(" + " + ".join(f"(strpos({expr}, {q(w)}) > 0)::INT" for w in words) + ")"


def within(expr: str, values) -> str:
    return f"({expr} IN ({', '.join(q(v) for v in values)}))"


def trimmed(expr: str) -> str:
    return f"trim({expr}, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160))"


def starts(expr: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({expr}, {q(p)})" for p in prefixes) + ")"


def group(line: str, pattern: str, index: int = 1) -> str:
    return f"regexp_extract({line}, {q(pattern)}, {index}, 'i')"


def values(rows, names: str) -> str:
    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return str(v)
        if isinstance(v, list):
            return "[" + ", ".join(q(x) for x in v) + "]"
        return q(v)
    return f"(VALUES {', '.join('(' + ', '.join(cell(v) for v in r) + ')' for r in rows)}) AS {names}"


# --- the corpus ------------------------------------------------------------------------------
SEED_ROWS = [(i, s.path, s.head, s.style) for i, s in enumerate(SEEDS)]
EXCLUDED = (
    f"(len(list_intersect(string_split(path, '/'), [{', '.join(q(d) for d in N.EXCLUDED_DIRS)}])) > 0"
    f" OR {within('name', N.EXCLUDED_NAMES)})"
)
DETECTOR_CODE = (
    f"({has('lower(rooted)', N.DETECTOR_PATH_NEEDLES)} OR {tally('lc', N.DETECTOR_CONTENT_NEEDLES)} >= 2"
    f" OR (strpos(lc, 'for pattern') > 0 AND strpos(lc, 're.search(pattern') > 0))"
)
TEST_FILE = f"({has('lower(rooted)', N.TEST_PATH_NEEDLES)} OR {has('lc', N.TEST_CONTENT_NEEDLES)})"
CORPUS = f"""
seeds AS (SELECT * FROM {values(SEED_ROWS, 's(i, spath, head, style)')}),
raw AS (
  SELECT source || '-' || (doc_id // 200)::VARCHAR AS workspace, replace(spath, '{{id}}', doc_id::VARCHAR) AS path,
    CASE style WHEN 'hash' THEN head || '# ' || replace(text, chr(10), chr(10) || '# ')
      WHEN 'json' THEN head || '"' || regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g') || '"}}'
      ELSE CASE WHEN (doc_id // {N_SEEDS}) % 2 = 0 THEN head || chr(10) || text ELSE text || chr(10) || head END END AS content
  FROM documents JOIN seeds ON i = doc_id % {N_SEEDS}
  UNION ALL
  SELECT 'web-' || (page_id // 25)::VARCHAR, 'site/p' || page_id::VARCHAR || '.html', html FROM pages),
named AS (SELECT *, list_last(string_split(path, '/')) AS name FROM raw),
every_file AS MATERIALIZED (
  SELECT *, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS ext, '/' || path AS rooted, lower(name) AS lname, lower(content) AS lc
  FROM named),
files AS MATERIALIZED (
  SELECT *, {DETECTOR_CODE} AS detector_code, {has('lc', N.PATTERN_CONTEXT_NEEDLES)} AS pattern_context, {TEST_FILE} AS test_file
  FROM every_file WHERE NOT {EXCLUDED})"""
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def line_table(source: str, name: str, keep: str) -> str:
    return f"""
{name}_split AS (SELECT {keep}, string_split_regex(content, {q(BREAK)}) AS parts FROM {source} WHERE content != ''),
{name}_cut AS (SELECT * EXCLUDE parts, CASE WHEN list_last(parts) = '' THEN parts[1:len(parts) - 1] ELSE parts END AS parts FROM {name}_split),
{name} AS MATERIALIZED (SELECT * EXCLUDE parts, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM {name}_cut)"""


LINES = line_table(
    "files", "lines",
    "workspace, path, name, ext, rooted, lname, lc, content, detector_code, pattern_context, test_file")
FRAMES = {(9, 10): "near10", (4, 5): "near5", (2, 3): "near3"}
CONTEXT = ",\nctx AS MATERIALIZED (SELECT *, " + ", ".join(
    f"string_agg(line, chr(10)) OVER (PARTITION BY workspace, path ORDER BY line_no ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING) AS {n}"
    for (b, a), n in FRAMES.items()) + " FROM lines)"
HEAD = f"WITH {CORPUS},{LINES}"
HEAD_CTX = HEAD + CONTEXT

# --- gates -----------------------------------------------------------------------------------
CODE = within("ext", N.CODE_EXTS)
SCRIPT = within("ext", [".py", ".js", ".ts", ".php", ".rb"])
TEST_NAME = "strpos(lname, 'test') > 0"
TEST_LIKE = has("lname", ["test", "spec"])
EXAMPLE_LIKE = has("lname", ["example", "sample"])


def comment(prefixes) -> str:
    return starts(trimmed("line"), prefixes)


NO_COMMENT = f"NOT {comment(N.COMMENTS_CODE)}"
LOW = f"lower({trimmed('line')})"
RAW_STRING = r"""r["'].*["']"""
NAMED_LIST = r"""["'][^"']+["']\s*:\s*\["""
DEFINITION = (
    f"(({has(LOW, N.PATTERN_LINE_NEEDLES)} AND {has('line', [':', '[', '('])})"
    f" OR ({rx('line', RAW_STRING, '')} AND (pattern_context OR {has(LOW, ['pattern', 'regex'])}))"
    f" OR ({rx('line', NAMED_LIST, '')} AND {has(LOW, ['pattern', 'cipher', 'secret'])}))"
)


def secretive(v: str) -> str:
    return (
        f"CASE WHEN {v} = '' OR {has(f'upper({v})', N.SECRET_FALSE_POSITIVES)} THEN false"
        f" WHEN {has(v, N.KNOWN_SECRET_MARKS)} THEN true"
        f" WHEN strpos({v}, '-----BEGIN') > 0 AND strpos({v}, 'PRIVATE KEY') > 0 THEN true"
        f" WHEN strpos(lower({v}), 'password=') > 0 AND length({v}) > 20 THEN true"
        f" WHEN {rx(v, '^' + N.UUID_REGEX)} THEN true"
        f" WHEN length({v}) >= 20 AND regexp_full_match({v}, '[\\pL\\pN]+') THEN true"
        f" WHEN length({v}) >= 16 AND regexp_full_match({v}, '[\\pL\\pN+/=]+') THEN true ELSE false END"
    )


def test_data(v: str) -> str:
    return (
        f"(test_file OR {has(f'lower({v})', N.TEST_VALUE_NEEDLES)}"
        f" OR ({within('lower(ext)', N.GUID_PROJECT_EXTS)} AND {rx(v, '^' + N.UUID_REGEX)}))"
    )


def keyword(v: str) -> str:
    return f"({has(f'upper({v})', N.SECRET_KEYWORDS)} AND NOT {has(f'upper({v})', N.SECRET_KEYWORD_EXEMPT)})"


def assignment() -> str:
    var, val = group("line", S.ASSIGNMENT, 1), group("line", S.ASSIGNMENT, 2)
    clean = f"trim({val}, {q(chr(39) + chr(34))})"
    return (
        f"({rx('line', S.ASSIGNMENT)} AND NOT (strpos({val}, '${{') > 0 OR starts_with({val}, '$')) AND {keyword(var)}"
        f" AND {clean} != '' AND {secretive(clean)} AND NOT {test_data(clean)})"
    )


CODE_PLACEHOLDER = f"({has('upper(line)', N.CODE_PLACEHOLDER_WORDS)} AND NOT {has('upper(line)', N.CODE_PLACEHOLDER_ESCAPES)})"
CONFIG_PLACEHOLDER = f"({has('upper(line)', N.CONFIG_PLACEHOLDER_WORDS)} AND {has('line', N.CONFIG_PLACEHOLDER_CONFIRM)})"


def code_confidence(v: str, comments: str) -> str:
    base = (
        f"(CASE WHEN {TEST_LIKE} THEN 0.85::DOUBLE * 0.7::DOUBLE ELSE 0.85::DOUBLE END * CASE WHEN {EXAMPLE_LIKE} THEN 0.6::DOUBLE"
        f" ELSE 1::DOUBLE END * CASE WHEN {comments} THEN 0.8::DOUBLE ELSE 1::DOUBLE END)"
    )
    return (
        f"CASE WHEN {secretive(v)} THEN least(0.99::DOUBLE, {base} + 0.1::DOUBLE) WHEN length({v}) >= 8 THEN least(0.9::DOUBLE, {base})"
        f" WHEN length({v}) >= 4 THEN greatest(0.5::DOUBLE, {base} - 0.2::DOUBLE) ELSE {base} END"
    )


# --- detectors -------------------------------------------------------------------------------
SNIPPET = f"substring({trimmed('line')}, 1, 200)"
TOOL = f"""tools AS (SELECT DISTINCT workspace FROM every_file
  WHERE {within('path', N.README_NAMES)} AND {has('lc', N.SECURITY_TOOL_README)})"""
IS_TOOL = (
    f"(workspace IN (SELECT workspace FROM tools) OR {has('lower(list_last(string_split(workspace, ' + q('/') + ')))', N.SECURITY_TOOL_NAMES)})"
)


def part(kind: str, where: str, severity: str, confidence: str, label: str = "''", snippet: str = SNIPPET,
         table: str = "lines", line: str = "line_no") -> str:
    return (
        f"SELECT workspace, path AS file, {q(kind)} AS type, ({line})::INT AS line, {snippet} AS snippet, "
        f"{severity} AS severity, ({confidence})::DOUBLE AS confidence, {label} AS label FROM {table} WHERE {where}"
    )


def firsts(rules, files: str, kind: str, severity: str, confidence: str, gate: str = "true", comments: str = NO_COMMENT,
           accept=None, table: str = "lines", match=None) -> list[str]:
    """First accepted line per (file, rule)."""
    out = []
    for pattern, label in rules:
        test = match(pattern) if match else rx("line", pattern)
        where = f"{files} AND {test} AND {comments} AND {gate}" + (f" AND {accept(pattern)}" if accept else "")
        inner = (
            f"(SELECT * FROM {table} WHERE {where} "
            f"QUALIFY row_number() OVER (PARTITION BY workspace, path ORDER BY line_no) = 1)"
        )
        out.append(part(kind, "true", q(severity), confidence, q(label), table=inner))
    return out


def whole(kind: str, where: str, text: str, severity: str, confidence: str, label: str = "''") -> str:
    return part(kind, where, q(severity), confidence, label, q(text), "files", "NULL")


def blend(x: str) -> str:
    return f"(({x})::DOUBLE + 0.5::DOUBLE) / 2"


def tool(yes: str, no: str) -> str:
    return f"CASE WHEN {IS_TOOL} THEN {yes} ELSE {no} END"


PEM = "strpos(content, '-----BEGIN') > 0 AND strpos(content, 'PRIVATE KEY') > 0"


def d1():
    base = f"0.9::DOUBLE * CASE WHEN {TEST_LIKE} THEN 0.7::DOUBLE ELSE 1::DOUBLE END * CASE WHEN {EXAMPLE_LIKE} THEN 0.6::DOUBLE ELSE 1::DOUBLE END"
    return [part("hardcoded_secret", f"ext = '.py' AND NOT detector_code AND NOT {comment(N.COMMENTS_PY)} AND NOT {DEFINITION} AND {assignment()}",
                 "'high'", tool(f"{base} * 0.6::DOUBLE", base))]


def d2():
    files = f"{within('ext', N.CODE_SECRET_EXTS)} AND NOT detector_code"
    markup = comment(N.COMMENTS_MARKUP)
    out = [
        whole("hardcoded_secret", f"{files} AND {PEM}", "SSH private key detected in file", "critical", "0.99", "'SSH_PRIVATE_KEY'"),
        part("hardcoded_secret", f"{files} AND NOT {CODE_PLACEHOLDER} AND {rx('line', S.EMPTY_PASSWORD)}", "'high'", "0.95",
             "'Empty password detected'"),
    ]
    for pattern in S.CODE_VALUES:
        clean = f"trim(v, {q(chr(39) + chr(34) + ' ')})"
        found = (
            f"(SELECT *, trim(val, {q(chr(39) + chr(34) + ' ')}) AS cv FROM (SELECT *, list_filter(regexp_extract_all(line, {q(pattern)}, 1, 'i'), lambda v: v != '' "
            f"AND NOT {within(f'upper({clean})', N.CODE_PLACEHOLDER_VALUES)} AND NOT {within(f'lower({clean})', N.CODE_NULL_VALUES)} "
            f"AND length({clean}) >= 3 AND {code_confidence(clean, markup)} >= 0.4)[1] AS val FROM lines "
            f"WHERE {files} AND {rx('line', pattern)} AND NOT {CODE_PLACEHOLDER} AND NOT {rx('line', S.EMPTY_PASSWORD)}) WHERE val IS NOT NULL)"
        )
        score = blend(code_confidence("cv", markup))
        out.append(part("hardcoded_secret", "true", f"CASE WHEN {score} >= 0.8 THEN 'high' ELSE 'medium' END", score, table=found))
    return out


def d3():
    mark = f"regexp_replace(content, {q('(' + S.PHP_ARRAY + ')')}, chr(1) || '\\1' || chr(2), 'gis')"
    cut = f"(SELECT workspace, path, unnest(parts[2:]) AS piece, generate_subscripts(parts[2:], 1) AS k, parts FROM (SELECT *, string_split({mark}, chr(1)) AS parts FROM files WHERE ext = '.php' AND NOT detector_code))"
    rows = f"(SELECT *, split_part(piece, chr(2), 1) AS m, 1 + len(regexp_extract_all(array_to_string(parts[1:k], ''), chr(10))) AS line_no FROM {cut})"
    v = f"(SELECT *, coalesce(nullif(regexp_extract(m, {q(S.PHP_ARRAY)}, 1, 'is'), ''), regexp_extract(m, {q(S.PHP_ARRAY)}, 2, 'is')) AS v FROM {rows})"
    return [part("hardcoded_secret", f"length({trimmed('v')}) >= 3 AND NOT {within('upper(trim(v, ' + q(chr(39) + chr(34) + ' ') + '))', N.PHP_PLACEHOLDER_VALUES)}",
                 "'critical'", "0.9", "'HARDCODED_PASSWORD'", "substring(m, 1, 200)", v)]


def d4():
    v = group("line", S.JAVA_SIMPLE)
    return [part("hardcoded_secret", f"ext = '.java' AND NOT detector_code AND {rx('line', S.JAVA_SIMPLE)} AND length({trimmed(v)}) >= 3"
                 f" AND NOT {within('upper(trim(' + v + ', ' + q(chr(39) + chr(34) + ' ') + '))', N.JAVA_PLACEHOLDER_VALUES)}",
                 "'critical'", "0.9", "'HARDCODED_PASSWORD'")]


TEXT_FILE = "(ext != '.py' AND NOT (" + " OR ".join(f"ends_with(name, {q(s)})" for s in N.ENV_TEMPLATE_SUFFIXES) + "))"
IAC = within("lower(ext)", N.IAC_EXTS)
CONFIG_LINE = f"NOT {comment(N.COMMENTS_PY)} AND NOT {CONFIG_PLACEHOLDER}"


def d5():
    return [part("hardcoded_secret",
                 f"{TEXT_FILE} AND ({within('lower(ext)', N.SECRET_TEXT_EXTS)} OR starts_with(name, '.env')) AND {CONFIG_LINE}"
                 f" AND NOT ({IAC} AND strpos(line, 'public-read') > 0) AND {assignment()}", "'high'", tool("0.6", "0.9"))]


def d6():
    return [part("insecure_acl", f"{TEXT_FILE} AND {IAC} AND {CONFIG_LINE} AND strpos(line, 'public-read') > 0", "'high'", "0.9",
                 snippet=trimmed("line"))]


def d7():
    return [whole("hardcoded_secret", f"({within('ext', N.KEY_EXTS)} OR {has('lname', ['key', 'private'])}) AND {PEM}",
                  "SSH private key file detected", "critical", "0.99", "'SSH_PRIVATE_KEY'")]


def d8():
    out = []
    for rules in S.CLOUD.values():
        for pattern, label in rules:
            found = (
                f"(SELECT * FROM (SELECT workspace, path, ext, test_file, unnest(regexp_extract_all(content, {q(pattern)}, 0, 'i')) AS m "
                f"FROM files WHERE lower(ext) != '.sln' AND NOT test_file) WHERE NOT {test_data('m')})"
            )
            out.append(part("hardcoded_secret", "true", "'critical'", tool("0.7", "0.95"), q(label), "substring(m, 1, 200)", found, "NULL"))
    return out


def d9():
    tf = "ext = '.tf'"
    return [
        part("insecure_acl", f"{tf} AND strpos(line, 'public-read') > 0", "'high'", "0.9"),
        whole("insecure_acl", f"{tf} AND {rx('content', C.WILDCARD_QUOTED, '')}", "IAM policy with wildcard permissions", "high", "0.9",
              "'Wildcard permissions in IAM policy'"),
        whole("unauthenticated_api_endpoint", f"{tf} AND {rx('content', C.NO_AUTHORIZATION)}", "Public API endpoint without authorization", "high", "0.9"),
        whole("insecure_acl", f"{tf} AND {rx('content', C.PUBLIC_ACCESS)}", "Public network access enabled", "high", "0.9"),
    ]


def d10():
    files = f"({within('ext', ['.yaml', '.yml', '.json'])} OR {within('name', N.COMPOSE_NAMES)}) AND {has('lname', N.CONTAINER_NAME_NEEDLES)}"
    return [
        whole("container_runs_as_root", f"{files} AND {any_rx('content', C.ROOT_USER, '')}", "Container runs as root user", "high", "0.9"),
        whole("insecure_acl", f"{files} AND {rx('content', C.PRIVILEGE_ESCALATION, '')}", "Privilege escalation enabled", "high", "0.9"),
        whole("insecure_acl", f"{files} AND {any_rx('content', C.DOCKER_SOCKET, '')}", "Docker socket exposed to container", "high", "0.9"),
        whole("missing_security_context", f"{files} AND NOT {has('content', ['securityContext', 'SecurityContext'])}",
              "Missing security context in container configuration", "medium", "0.8"),
    ]


def d11():
    return [whole("dpdp_missing_access_logging", f"{CODE} AND {rx('content', C.AUTH_DECORATOR)} AND NOT {rx('content', C.LOGGER_CALL)}",
                  "Authentication middleware found but no access logging", "medium", "0.75")]


PLAIN_DB = f"NOT {has('lc', ['encrypt', 'sqlcipher'])}"


def d12():
    files = within("ext", N.CODE_EXTS + [".sql"])
    return [
        whole("hardcoded_secret", f"{files} AND {rx('content', C.DB_EMPTY_PASSWORD)}", "Empty password in database connection", "high", "0.95"),
        whole("hardcoded_secret", f"{files} AND {rx('content', C.DB_LITERAL_PASSWORD)}", "Plaintext password in database connection string", "high", "0.9"),
        whole("unencrypted_database_connection", f"{files} AND {rx('content', C.DB_JDBC)} AND NOT {has('content', ['useSSL=true'])}",
              "Unencrypted database connection detected", "high", "0.85"),
        whole("unencrypted_database", f"{files} AND {any_rx('content', C.SQLITE)} AND {PLAIN_DB}",
              "SQLite database without encryption (GDPR Article 32, SOC2-CC6.1)", "high", "0.9"),
    ]


def d13():
    files = (
        f"({has('path', N.CICD_PATHS)} OR ({within('ext', ['.yml', '.yaml', '.json'])} AND ({has('path', ['.github', '.gitlab', '.circleci'])}"
        f" OR {has('lname', ['jenkins'])})))"
    )
    return firsts(S.PIPELINE_SECRETS, files, "hardcoded_secret", "critical", "0.95") + [
        whole("unsigned_artifacts", f"{files} AND NOT {has('lc', ['sign', 'gpg', 'cosign'])}", "CI/CD pipeline does not sign artifacts", "medium", "0.7"),
        whole("unpinned_dependency", f"{files} AND {rx('content', C.LATEST_PULL)}", "Docker image pulled with :latest tag (unpinned)", "medium", "0.8"),
        whole("missing_dependency_lock", f"{files} AND NOT {rx('content', C.DEPENDENCY_SCANNER)}",
              "CI/CD pipeline missing dependency vulnerability scanning", "medium", "0.75"),
        whole("missing_logging", f"{files} AND NOT {rx('content', C.SECURITY_SCAN)}", "CI/CD pipeline missing security scanning", "medium", "0.7"),
    ]


def d14():
    locks = values([(m, k) for m, k in N.LOCK_FILES.items()], "l(manifest, lock)")
    return [
        f"SELECT f.workspace, f.path AS file, 'missing_dependency_lock' AS type, NULL::INT AS line, 'Missing ' || lock || ' for ' || manifest AS snippet, "
        f"'low' AS severity, 0.8::DOUBLE AS confidence, '' AS label FROM (SELECT DISTINCT workspace, path FROM every_file) f JOIN {locks} ON f.path = manifest "
        f"WHERE NOT EXISTS (SELECT 1 FROM every_file e WHERE e.workspace = f.workspace AND e.path = lock)"]


def d15():
    return firsts(S.FRONTEND_STORAGE, f"{within('ext', ['.js', '.ts', '.jsx', '.tsx', '.vue'])} AND NOT detector_code", "insecure_secret_storage",
                  "high", "0.9", comments=f"NOT {comment(N.COMMENTS_FRONTEND)}")


def d16():
    files = (
        f"({within('name', N.CONFIG_NAMES)} OR {within('ext', ['.env', '.conf', '.config', '.ini'])} OR (ext = '.py'"
        f" AND {has('lname', ['config', 'settings', 'database'])})) AND NOT detector_code"
    )
    fixed = f"({rx('line', C.CORS_LOCALHOST)} AND NOT {has('lc', ['production'])} AND NOT {has('content', ['os.getenv', 'os.environ'])})"
    wild = rx("line", C.CORS_WILDCARD)
    inner = (
        f"(SELECT *, {wild} AS wild FROM lines WHERE {files} AND ({wild} OR {fixed}) "
        f"QUALIFY row_number() OVER (PARTITION BY workspace, path ORDER BY line_no) = 1)"
    )
    return [
        part("insecure_configuration", "true", "CASE WHEN wild THEN 'medium' ELSE 'low' END", "CASE WHEN wild THEN 0.85 ELSE 0.7 END",
             "CASE WHEN wild THEN 'CORS allows all origins (wildcard)' ELSE 'CORS hardcoded to localhost (should be configurable for production)' END",
             table=inner),
        whole("unencrypted_database", f"{files} AND {rx('content', C.SQLITE_FILE)} AND {PLAIN_DB}", "SQLite database configuration without encryption", "high", "0.9"),
    ]


def d17():
    return (
        firsts(C.WEAK_CIPHERS, f"{CODE} AND NOT detector_code AND NOT {TEST_NAME}", "weak_encryption", "high", "0.9")
        + firsts(C.TLS_SETTINGS, f"{CODE} AND NOT detector_code", "weak_encryption", "high", "0.85")
    )


def d18():
    c = "lower(near5)"
    orm = f"({has(c, N.ORM_NEEDLES)} AND NOT {has(c, ['raw(', 'execute('])} AND NOT ({has(c, ['query('])} AND {has(c, ['sql'])}))"
    return (
        firsts(C.SQL_INJECTION, f"{CODE} AND NOT detector_code", "potential_sql_injection", "high", "0.75", f"NOT {DEFINITION} AND NOT {orm}", table="ctx")
        + firsts(C.NOSQL_INJECTION, CODE, "potential_sql_injection", "high", "0.75")
    )


def d19():
    files = f"{CODE} AND NOT {TEST_NAME}"

    def real(pattern):
        v = f"upper({group('line', pattern)})"
        return f"NOT ({within(v, N.FLASK_PLACEHOLDER_VALUES)} OR {has(v, ['KEEP IT SECRET'])})"

    return (
        firsts(C.WEAK_AUTH, files, "weak_authentication", "high", blend("0.8"), f"NOT {has('lower(near5)', N.HASHING_NEEDLES)}", table="ctx")
        + firsts(C.FLASK_SECRET_KEY, files, "hardcoded_secret", "high", blend("0.9"), accept=real)
    )


def d20():
    kind = f"CASE WHEN {has('line', ['system(', 'exec(', 'eval('])} THEN 'command execution' ELSE 'authentication' END"
    inner = (
        f"(SELECT * FROM ctx WHERE {CODE} AND {any_rx('line', C.AUTH_CALLS)} AND {NO_COMMENT} AND NOT {any_rx('near10', C.LOGGING_CALLS)} "
        f"QUALIFY row_number() OVER (PARTITION BY workspace, path ORDER BY line_no) = 1)"
    )
    return [part("missing_logging", "true", "'medium'", "0.75", f"'Missing security event logging for ' || {kind}", table=inner)]


def d21():
    return firsts(C.COMMAND_INJECTION, SCRIPT, "command_injection", "critical", blend(f"CASE WHEN {TEST_NAME} THEN 0.6 ELSE 0.9 END"))


def after_last(pattern: str, ban: str) -> str:
    """A match followed by no ``ban``: such a match exists iff the last one is not followed by it."""
    return f"({rx('line', pattern)} AND NOT {rx('regexp_extract(line, ' + q('^.*' + pattern + '(.*)$') + ', 1, ' + q('i') + ')', ban)})"


def looking_ahead(pattern: str) -> str:
    if "(?!" not in pattern:
        return rx("line", pattern)
    head, *bans = pattern.split("(?!")
    return after_last(head, "|".join(f"(?:{b[:-1]})" for b in bans))


def d22():
    markup = has("lower(line)", ["innerhtml", "outerhtml"])
    harmless = f"({markup} AND ({rx('line', C.XSS_CONSTANT_ASSIGNMENT)} OR {rx('line', C.XSS_DOM_ASSIGNMENT)} OR {TEST_LIKE}))"
    gate = f"NOT {DEFINITION} AND ({has('lower(line)', ['|safe'])} OR (NOT {has('lower(near3)', N.SANITIZER_NEEDLES)} AND NOT {harmless}))"
    return firsts(C.XSS, f"{within('ext', C.XSS_EXTS)} AND NOT detector_code", "potential_sql_injection", "high",
                  f"CASE WHEN {TEST_NAME} THEN 0.6 ELSE 0.85 END", gate, f"NOT {comment(N.COMMENTS_MARKUP)}", table="ctx", match=looking_ahead)


def d23():
    files = (
        f"{within('ext', ['.py', '.js', '.ts', '.env', '.config', '.conf'])} AND NOT detector_code AND NOT {TEST_NAME}"
        f" AND NOT list_contains(string_split(path, '/'), 'test')"
    )
    return firsts(C.DEBUG_MODE, files, "insecure_configuration", "medium", "0.9", f"NOT {DEFINITION}")


def d24():
    def match(pattern):
        if "\\1" not in pattern:
            return looking_ahead(pattern)
        loose = pattern.replace("\\1", "([^)]*?)")
        return f"({rx('line', loose)} AND lower({group('line', loose, 1)}) = lower({group('line', loose, 2)}))"

    return firsts(C.COOKIES, f"{SCRIPT} AND NOT detector_code", "insecure_configuration", "high", "0.85", f"NOT {DEFINITION}", match=match)


def d25():
    files = within("ext", N.CODE_EXTS + [".yaml", ".yml", ".json", ".env"])

    def real(pattern):
        return f"NOT {test_data(group('line', pattern))}"

    return (
        firsts(S.JWT_SECRETS, files, "hardcoded_secret", "critical", tool("0.7", "0.9"), f"NOT {has('lower(line)', ['example', 'placeholder'])}", accept=real)
        + firsts(S.OAUTH_SECRETS, files, "hardcoded_secret", "critical", tool("0.7", "0.9"), accept=real)
        + firsts(S.SESSION_SECRETS, files, "hardcoded_secret", "high", tool("0.6", "0.85"), accept=real)
        + firsts(S.ENCRYPTION_KEYS, files, "hardcoded_secret", "critical", "0.95")
        + firsts(S.API_KEY_IN_URL, files, "api_key_in_url", "high", "0.8")
    )


def d26():
    (none_exp, none_label), (no_exp, no_label) = C.JWT_EXPIRY
    (route, route_label), (off, off_label) = C.CSRF
    call = no_exp.split("(?!")[0]
    bare = (
        f"({rx('content', call, 'is')} AND NOT {rx('regexp_extract(content, ' + q('^.*' + call + '(.*)$') + ', 1, ' + q('is') + ')', 'exp', 'is')})"
    )
    # without dot-all the look-ahead ends with the line, so each line's last match decides
    head = route.split("(?!")[0]
    pieces = f"string_split(regexp_replace(content, {q('(' + head + ')')}, '\\1' || chr(1), 'gi'), chr(1))[2:]"
    open_route = f"len(list_filter({pieces}, lambda x: NOT {rx('split_part(x, chr(10), 1)', 'csrf')})) > 0"
    return firsts(C.SESSION_SETTINGS, CODE, "weak_authentication", "high", "0.85") + [
        whole("weak_authentication", f"{CODE} AND ({rx('content', none_exp, 'is')} OR {bare})", "JWT token without expiration", "high", "0.8",
              f"CASE WHEN {rx('content', none_exp, 'is')} THEN {q(none_label)} ELSE {q(no_label)} END"),
        whole("weak_authentication", f"{CODE} AND ({open_route} OR {rx('content', off)})", "Missing CSRF protection", "medium", "0.75",
              f"CASE WHEN {open_route} THEN {q(route_label)} ELSE {q(off_label)} END"),
    ]


def d27():
    files = within("ext", C.INSECURE_CONFIG_EXTS)
    return (
        firsts(C.INSECURE_DEBUG, f"{files} AND NOT {TEST_NAME}", "insecure_acl", "high", "0.9")
        + firsts(C.INSECURE_CORS, files, "insecure_acl", "medium", "0.8")
        + firsts(C.INSECURE_COOKIE_FLAGS, files, "weak_authentication", "high", "0.85")
    )


def d28():
    files = f"{CODE} AND NOT detector_code"
    gate = f"NOT {any_rx('line', C.NORMAL_FILE_OPS)} AND NOT {has('line', N.PATH_JOIN_NEEDLES)} AND {has('lower(near5)', N.PATH_INPUT_NEEDLES)}"
    return (
        firsts(C.PATH_ACCESS, files, "insecure_acl", "high", "0.8", gate, table="ctx")
        + firsts(C.INPUT_ACCESS, files, "insecure_acl", "medium", "0.7", f"NOT {has('lower(near3)', N.VALIDATOR_NEEDLES)}", table="ctx")
    )


def d29():
    return firsts(C.LOG_INJECTION, CODE, "missing_logging", "medium", "0.75") + firsts(C.SENSITIVE_LOGS, CODE, "missing_logging", "high", "0.85")


def d30():
    files = within("ext", N.CODE_EXTS + [".yaml", ".yml"])
    return firsts(C.ENCRYPTION_AT_REST, files, "weak_encryption", "high", "0.85") + firsts(C.PII_IN_ERRORS, files, "weak_encryption", "medium", "0.75")


def d31():
    files = f"({within('name', N.SUPPLY_CHAIN_NAMES)} OR {within('ext', ['.yaml', '.yml', '.json', '.py', '.js', '.ts'])})"
    return firsts(S.SUPPLY_CHAIN_SECRETS, files, "hardcoded_secret", "critical", "0.95") + firsts(C.REGISTRIES, files, "insecure_acl", "medium", "0.8")


def d32():
    return firsts(C.XXE, CODE, "xxe_injection", "high", "0.85", f"NOT {has('lower(near10)', N.XXE_GUARDS)}", table="ctx")


def d33():
    return firsts(C.SSRF, CODE, "ssrf", "high", "0.8", f"NOT {has('lower(near10)', N.SSRF_GUARDS)}", table="ctx")


def d34():
    return firsts(C.DESERIALIZATION, CODE, "insecure_deserialization", "critical", "0.9")


def d35():
    return firsts(C.PATH_TRAVERSAL, CODE, "insecure_acl", "high", "0.85", f"NOT {has('lower(near5)', N.TRAVERSAL_GUARDS)}", table="ctx")


def d36():
    inner = (
        f"(SELECT a.*, (SELECT min_by(b.line, b.line_no) FROM lines b WHERE b.workspace = a.workspace AND b.path = a.path "
        f"AND b.line_no BETWEEN a.line_no + 2 AND a.line_no + 5 AND {rx('b.line', C.FILE_OPERATION)}) AS later "
        f"FROM lines a WHERE {CODE} AND {rx('line', C.EXISTS_CHECK)})"
    )
    text = f"substring({trimmed('line')}, 1, 100) || ' ... ' || substring({trimmed('later')}, 1, 100)"
    return [part("insecure_acl", "later IS NOT NULL", "'medium'", "0.7",
                 "'TOCTOU: exists() check followed by file operation (race condition)'", text, inner)]


def d37():
    return firsts(C.CRYPTO_MISUSE, CODE, "weak_encryption", "high", "0.85")


DETECTORS = {f"D{k}": globals()[f"d{k}"] for k in range(1, 38)}
LABEL = {"D17", "D13"}


def detector_union(ids) -> str:
    return "\nUNION ALL ".join(p for k in ids for p in DETECTORS[k]())


def detector_sql(key: str) -> str:
    body = detector_union([key])
    head = HEAD_CTX if " FROM ctx" in body or "FROM (SELECT * FROM ctx" in body else HEAD
    return f"{head},\n{TOOL}\nSELECT workspace, file, type, line, snippet, severity, round(confidence, 6) AS confidence, label FROM (\n{body}\n)"
