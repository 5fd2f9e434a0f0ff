"""Rule groups and the behaviours that are easy to get wrong."""

import pytest

from auditlake.operators import detectors as D
from auditlake.operators.practice import missing_locks, practice_gaps, workspace_flags
from auditlake.plans.corpus import HEX40, VALUE
from auditlake.plans.scan import scan_workspaces
from auditlake.operators.user_rules import UserRule, register_rules

# operator, extension, a line one rule matches, a line none matches
PAIRS = [
    ("D2", ".js", f'var password = "{VALUE}";', "var handle = readVault();"),
    ("D17", ".py", "digest = hashlib.md5(data)", "digest = hashlib.blake2b(data)"),
    ("D17", ".py", "conn = connect(host, verify=False)", "conn = connect(host, verify=True)"),
    ("D18", ".py", 'rows = run("SELECT a FROM t WHERE id=" + uid)', 'rows = run("SELECT a FROM t WHERE id=?", uid)'),
    ("D18", ".js", "doc = BasicDBObject(name + suffix)", "doc = BasicDBObject(name)"),
    ("D19", ".py", "if user.password == supplied:", "if check(user, supplied):"),
    ("D20", ".py", "ok = authenticate(user)", "ok = verify(user)"),
    ("D21", ".py", "os.system(cmd)", "os.listdir(cmd)"),
    ("D22", ".js", "box.innerHTML = payload", "box.innerText = payload"),
    ("D23", ".py", "DEBUG = True", "DEBUG = False"),
    ("D24", ".py", "resp.set_cookie('sid', token)", "resp.delete_cookie('sid')"),
    ("D25", ".py", 'JWT_SECRET = "qwertyuiopas"', 'JWT_SECRET = getenv("X")'),
    ("D25", ".py", 'client_secret = "qwertyuiopas"', "client_secret = load()"),
    ("D25", ".py", 'session_secret = "qwertyuiopas"', "session_secret = load()"),
    ("D25", ".py", 'ENCRYPTION_KEY = "qwertyuiopasdfgh"', "ENCRYPTION_KEY = load()"),
    ("D25", ".py", "url = base + '?api_key=' + k", "url = base"),
    ("D26", ".py", "csrf_protect = False", "csrf_protect = True"),
    ("D26", ".py", "session.timeout = 0", "session.timeout = 5"),
    ("D26", ".py", "jwt.encode(payload, key)", "jwt.encode(payload, exp)\nexp = 1"),
    ("D27", ".py", "Access-Control-Allow-Origin: *", "Access-Control-Allow-Origin: https://a.b"),
    ("D27", ".py", "cookie.secure = False", "cookie.secure = True"),
    ("D28", ".py", "name = request.args['name']", "name = clean(name)"),
    ("D28", ".py", "f = open(base + ../ + request.path)", "f = open(base)"),
    ("D29", ".py", "logger.info('u ' + name)", "logger.info('u %s', name)"),
    ("D29", ".py", "log.info(password)", "log.info(count)"),
    ("D30", ".py", "storage_encryption = False", "storage_encryption = True"),
    ("D30", ".py", "raise ValueException(email)", "raise ValueException(code)"),
    ("D31", ".yaml", 'CI_SECRET: "qwertyuiopas"', "CI_SECRET: ${X}"),
    ("D31", ".py", 'registry = "http://pkg.local"', 'registry = "https://pkg.local"'),
    ("D15", ".js", "localStorage.setItem('t', token)", "memoryStore.set('t', token)"),
    ("D32", ".py", "tree = xml.etree.ElementTree.parse(f)", "tree = defused.parse(f)"),
    ("D33", ".py", "r = requests.get(url)", "r = cache.fetch(url)"),
    ("D34", ".py", "obj = pickle.loads(blob)", "obj = json.loads(blob)"),
    ("D35", ".py", "f = open(root + '../x')", "f = open(root)"),
    ("D37", ".js", "n = Math.random()", "n = crypto.randomUUID()"),
    ("D1", ".py", f"api_token = '{HEX40}'", "api_token = load()"),
    ("D4", ".java", 'pwd = "abc1";', "pwd = load();"),
    ("D5", ".ini", f"password = {VALUE}", "password = ${X}"),
    ("D6", ".yaml", "acl: public-read", "acl: private"),
    ("D7", ".pem", "-----BEGIN " + "PRIVATE KEY-----", "-----BEGIN CERTIFICATE-----"),
    ("D8", ".md", "AK" + "IA" + "Q" * 16, "AK" + "IA" + "Q" * 5),
    ("D9", ".tf", 'authorization = "NONE"', 'authorization = "JWT"'),
    ("D11", ".py", "@login_required", "@login_required\nself.logger(x)"),
    ("D12", ".sql", "sqlite:///x", "sqlite:///x encrypt"),
]


def test_each_group_hits_and_misses(files_of):
    rows = []
    for k, (_, ext, yes, no) in enumerate(PAIRS):
        rows += [(f"yes{k}", f"src/f{k}{ext}", yes), (f"no{k}", f"src/f{k}{ext}", no)]
    found = D.scan_files(files_of(*rows)).select("workspace", "detector").distinct().collect()
    seen = {(r.workspace, r.detector) for r in found}
    for k, (detector, _, yes, no) in enumerate(PAIRS):
        assert (f"yes{k}", detector) in seen, (detector, yes)
        assert (f"no{k}", detector) not in seen, (detector, no)


def lines_of(files, key, **more):
    return sorted((r.file, r.line) for r in D.scan_files(files, [key], **more).collect())


def test_logging_context_is_skewed(files_of):
    def text(at):
        lines = [f"x = {i}" for i in range(1, 41)]
        lines[19] = "authenticate(user)"
        lines[at - 1] = "logger.info('x')"
        return "\n".join(lines)

    files = files_of(*[(f"f{at}.py", text(at)) for at in (30, 31, 11, 10)])
    assert lines_of(files, "D20") == [("f10.py", 20), ("f31.py", 20)]


def test_race_look_ahead_skips_the_next_line(files_of):
    def text(at):
        lines = [f"x = {i}" for i in range(1, 25)]
        lines[4] = "if p.exists():"
        lines[at - 1] = "f = open(p)"
        return "\n".join(lines)

    files = files_of(*[(f"f{at}.py", text(at)) for at in (6, 7, 10, 11)])
    assert lines_of(files, "D36") == [("f10.py", 5), ("f7.py", 5)]


def test_first_accepted_line_wins(files_of):
    files = files_of(("a.py", "x\ny\n# os.system(cmd)\n\n\n\n\n\nos.system(cmd)\nos.system(cmd)"))
    assert {line for _, line in lines_of(files, "D21")} == {9}


def test_wildcard_cors_before_localhost_and_once_per_file(files_of):
    files = files_of(
        ("a/settings.py", "allow_origins = ['http://localhost']\nCORS(app, allow_origins=['*'])"),
        ("b/settings.py", "import os.environ\nallow_origins = ['http://localhost']\nCORS(app, allow_origins=['*'])"))
    found = {(r.file, r.line, r.severity) for r in D.scan_files(files, ["D16"]).collect()}
    assert found == {("a/settings.py", 1, "low"), ("b/settings.py", 3, "medium")}


def test_excluded_names_and_suffixes(files_of):
    bad = f"token = {HEX40}"
    files = files_of((".env", bad), ("conf/.env/x.ini", bad), ("prod.env", bad), ("build/a.ini", bad), ("a.tf.json", "public-read"))
    assert [r.ext for r in files.orderBy("path").collect()] == ["", ".json", ".ini", ".ini", ".env"]
    assert lines_of(files, "D5") == [("prod.env", 1)]
    assert lines_of(files, "D9") == [] and lines_of(files, "D6") == [("a.tf.json", 1)]


def test_whole_file_words_silence_values(files_of):
    files = files_of(("a.ini", f"token = {HEX40}\nlatest"), ("b.ini", f"token = {HEX40}\nnewest"))
    assert lines_of(files, "D5") == [("b.ini", 1)]


def test_overlapping_detectors_keep_their_rows(files_of):
    files = files_of(("m.tf", 'acl = "public-read"'), ("k.pem", "-----BEGIN RSA " + "PRIVATE KEY-----"), ("key.js", "-----BEGIN " + "PRIVATE KEY-----"))
    found = sorted((r.file, r.detector) for r in D.scan_files(files, ["D2", "D6", "D7", "D9"]).collect())
    assert found == [("k.pem", "D7"), ("key.js", "D2"), ("key.js", "D7"), ("m.tf", "D6"), ("m.tf", "D9")]


def test_code_secret_rows_per_rule_and_confidence(files_of):
    files = files_of(("a.js", "secret = 'abcdefgh'\n"))
    raw = [r for r in D.scan_files(files, ["D2"], validation="off").collect()]
    assert {r.confidence for r in raw} == {0.85} and {r.severity for r in raw} == {"high"}
    blended = D.scan_files(files, ["D2"]).collect()
    assert len(blended) == len(raw) >= 3
    assert {r.confidence for r in blended} == {(0.85 + 0.5) / 2} and {r.severity for r in blended} == {"medium"}


def test_products_keep_float_order(files_of):
    files = files_of(("testexample.js", "secret = 'abcd'"), ("x.js", "// secret = 'abcd'"))
    got = {r.file: r.confidence for r in D.scan_files(files, ["D2"], validation="off").collect()}
    assert got["testexample.js"] == max(0.5, 0.85 * 0.7 * 0.6 - 0.2)
    assert got["x.js"] == max(0.5, 0.85 * 0.8 - 0.2) == 0.5


def test_security_tool_lowers_confidence(files_of):
    files = files_of(("tool", "README.md", "A Security Scanner"), ("tool", "a.ini", f"token = {HEX40}"),
                     ("plain", "a.ini", f"token = {HEX40}"), ("my-audit", "a.ini", f"token = {HEX40}"))
    got = {r.workspace: r.confidence for r in D.scan_files(files, ["D5"]).collect()}
    assert got == {"tool": 0.6, "plain": 0.9, "my-audit": 0.6}


def test_case_odd_letters_pass_the_prefilter(files_of):
    files = files_of(("a.js", "loſal = 1\nlocalſtorage.setItem('t', token)"))
    assert lines_of(files, "D15") == [("a.js", 2)]


def test_missing_locks(files_of):
    files = files_of(("a", "package.json", "{}"), ("b", "package.json", "{}"), ("b", "package-lock.json", "{}"),
                     ("b", "sub/go.mod", ""), ("c", "Gemfile", ""))
    assert sorted((r.workspace, r.file) for r in missing_locks(files).collect()) == [("a", "package.json"), ("c", "Gemfile")]


def test_practice_gaps_need_a_web_application(files_of):
    files = files_of(
        ("web", "main.py", "x = 1"), ("web", "api.py", "@app.post('/api/consent')\ndef f():\n    export_user_data(1)"),
        ("lib", "x.go", "user"), ("demo-shop", "main.py", "x = 1"),
        ("full", "main.py", "@audit\ndef f():\n    delete_user_data(1)\n    download_data(2)\nimport consent\n"),
        ("full", "c.yaml", "retention_days: 5\ntls_enabled = true"))
    gaps = {(r.workspace, r.type) for r in practice_gaps(files).collect()}
    assert {t for w, t in gaps if w == "full"} == set()
    assert {t for w, t in gaps if w == "web"} == {
        "dpdp_missing_access_logging", "dpdp_missing_retention", "dpdp_missing_right_to_erasure", "gdpr_missing_encryption"}
    assert {w for w, _ in gaps} == {"web"}


@pytest.mark.parametrize("flag,path,content", [
    ("consent_by_dependency", "package.json", '{"dependencies": {"Auth0": "1"}}'),
    ("consent_by_route", "a.tsx", "router.get('/user/consent')"),
    ("consent_by_schema", "a.sql", "CREATE TABLE consent (x int)"),
    ("portability_by_route", "a.js", "router.get('/me/export')"),
    ("access_logging_by_config", "a.yaml", "audit_log_enabled: true"),
    ("retention_by_config", "a.py", "retention_days: 90"),
    ("erasure_by_route", "a.py", "@app.delete('/user/delete')"),
    ("encryption_by_dependency", "Pipfile", "cryptography"),
    ("encryption_by_config", "a.env", "SSL_MODE = true"),
])
def test_practice_flags(files_of, flag, path, content):
    files = files_of(("yes", path, content), ("no", path, "nothing"), ("skipped", f"node_modules/{path}", content))
    got = {r.workspace: r[flag] for r in workspace_flags(files, [flag]).collect()}
    assert got == {"yes": True, "no": False, "skipped": False}


def test_partitioning_does_not_change_the_scan(files_of):
    rows = [(f"src/f{k}{ext}", yes) for k, (_, ext, yes, _) in enumerate(PAIRS)]
    files = files_of(*rows)
    want = None
    for n in (1, 7, 16):
        got = sorted(map(str, scan_workspaces(files.repartition(n)).collect()))
        want = want or got
        assert got == want


def test_user_rules(files_of):
    rules = register_rules([
        UserRule("R1", r"todo\(\w+\)", (".py",), "line", "open_task", "low", 0.4),
        UserRule("R2", r"copyright", (), "file", "notice", "medium", 0.5)])
    files = files_of(("a.py", "# todo(x)\ntodo(y)\ntodo(z)"), ("b.js", "todo(y)\n(c) Copyright"))
    got = sorted((r.file, r.type, r.line, r.confidence) for r in D.scan_files(files, [], extra=rules).collect())
    assert got == [("a.py", "open_task", 2, 0.4), ("b.js", "notice", None, 0.5)]
    with pytest.raises(ValueError):
        register_rules([UserRule("R3", "x", (), "page", "t", "low", 0.4)])
