"""Word lists used by the false-positive gates.

Fixed values: every list has to equal the published rule set for results to match.
"""

# --- extensions and file names ------------------------------------------------
CODE_EXTS = [".py", ".js", ".ts", ".java", ".cs", ".php", ".rb", ".go"]
CODE_SECRET_EXTS = [".php", ".java", ".cs", ".js", ".ts", ".rb", ".go", ".cpp", ".c", ".h", ".swift", ".kt", ".scala"]
IAC_EXTS = [".tf", ".tf.json", ".json", ".yaml", ".yml", ".hcl", ".tfvars"]
SECRET_TEXT_EXTS = [".env", ".ini", ".cfg", ".conf", ".txt", ".json", ".yaml", ".yml", ".properties", ".toml", ".config"]
ENV_TEMPLATE_SUFFIXES = [".env.example", ".env.sample", ".env.template"]
KEY_EXTS = [".key", ".pem", ".p12", ".pfx"]
PUBLIC_ACL_MARKER = "public-read"

EXCLUDED_DIRS = [
    ".git", ".venv", "venv", "env", ".env", "node_modules", "__pycache__",
    ".pytest_cache", "dist", "build", ".tox", ".mypy_cache", ".ruff_cache",
    "site-packages", ".eggs", "*.egg-info", "artifacts", "build-info",
    ".next", ".nuxt", ".cache", "coverage", ".coverage", ".nyc_output",
    "target", "bin", "obj", ".idea", ".vscode", ".vs", ".gradle", ".mvn",
]
EXCLUDED_NAMES = ["report.json", "*.pyc", "*.pyo", "*.class", "*.o", "*.so", "*.dylib"]
PRACTICE_EXCLUDED_PARTS = [".git", "node_modules", "__pycache__", ".venv"]
SCHEMA_EXCLUDED_PARTS = [".git", "node_modules"]

# --- rule-definition code -------------------------------------------------------
DETECTOR_PATH_NEEDLES = ["detector", "scanner", "scan_", "pattern", "compliance.py", "config.py"]
DETECTOR_CONTENT_NEEDLES = [
    "def _scan_",
    "xss_patterns = [",
    "secret_patterns = [",
    "injection_patterns = [",
    "weak_cipher_patterns = [",
    "sql_injection_patterns = [",
    "nosql_injection_patterns = [",
    "weak_ciphers = {",
    "weak_auth_patterns = [",
    "re.compile(",
    "CLOUD_SECRET_PATTERNS",
    "SECRET_REGEX =",
    "pattern.*=.*r\"",
    "patterns = [",
    "detection.*pattern",
    "= [",
    "= {",
]
PATTERN_LINE_NEEDLES = [
    "pattern", "patterns", "regex", "re.compile", "r\"", "r'",
    "= [", "= {", "= (",
    "CLOUD_SECRET_PATTERNS", "SECRET_REGEX", "FALSE_POSITIVE_PATTERNS",
    "xss_patterns", "injection_patterns", "weak_cipher_patterns",
    "secret_patterns", "acl_patterns",
]
PATTERN_CONTEXT_NEEDLES = ["patterns =", "pattern =", "= [", "= {", "sql_injection_patterns", "xss_patterns"]

# --- secret values ---------------------------------------------------------------
SECRET_KEYWORDS = [
    "PASSWORD", "API_KEY", "TOKEN", "SECRET", "AUTH", "CREDENTIAL",
    "PRIVATE_KEY", "ACCESS_KEY", "SESSION_KEY", "ENCRYPTION_KEY",
]
SECRET_KEYWORD_EXEMPT = ["SECRET_KEYWORDS", "SECRETS_MANAGEMENT", "SECRET_REGEX", "SECRET_TEXT"]
SECRET_FALSE_POSITIVES = [
    "SECRET_KEYWORDS", "SECRETS_MANAGEMENT", "SECRET_REGEX", "SECRET_TEXT",
    "SECRET_", "TOKEN_", "PASSWORD_", "API_KEY_",
    "token_normalize", "tokenizer", "tokenize", "tokenized",
    "tokens[", "tokens.", "nextToken", "tmpToken",
    "token = tokens", "token = state", "Token(",
]
KNOWN_SECRET_MARKS = [
    "sk_live_", "pk_live_", "sk_test_", "pk_test_",
    "xoxb-", "xoxa-", "ghp_", "github_pat_", "AKIA", "AIza",
]
UUID_REGEX = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
TEST_VALUE_NEEDLES = [
    "test", "example", "sample", "demo", "placeholder", "dummy",
    "fake", "mock", "stub", "fixture", "testdata", "test_data",
    "changeme", "replaceme", "yourkeyhere", "yoursecrethere",
    "12345", "password123", "secret123", "key123",
]
TEST_PATH_NEEDLES = ["/test/", "/tests/", "/spec/", "/fixtures/", "/examples/", "/samples/"]
TEST_CONTENT_NEEDLES = ["test", "example", "sample", "fixture", "mock"]
GUID_PROJECT_EXTS = [".sln", ".csproj", ".vcxproj", ".vcproj", ".csproj.user"]

# --- placeholders -----------------------------------------------------------------
CODE_PLACEHOLDER_WORDS = ["PLACEHOLDER", "YOUR_", "CHANGE-ME", "REPLACE_ME", "EXAMPLE", "TODO", "FIXME"]
CODE_PLACEHOLDER_ESCAPES = ["PASSWORD", "SECRET", "TOKEN", "KEY"]
CONFIG_PLACEHOLDER_WORDS = ["PLACEHOLDER", "YOUR_", "CHANGE-ME", "REPLACE_ME", "EXAMPLE"]
CONFIG_PLACEHOLDER_CONFIRM = ["change-me", "replace_me", "yourtokenhere", "placeholder"]
CODE_PLACEHOLDER_VALUES = [
    "CHANGE-ME", "REPLACE_ME", "YOURTOKENHERE", "PLACEHOLDER", "TODO", "XXX",
    "FIXME", "YOUR_", "SET_", "CONFIG", "EXAMPLE",
]
CODE_NULL_VALUES = ["null", "none", "true", "false", "undefined", "nil"]
PHP_PLACEHOLDER_VALUES = ["CHANGE-ME", "REPLACE_ME", "PLACEHOLDER", "EXAMPLE", "TODO", "FIXME"]
JAVA_PLACEHOLDER_VALUES = ["CHANGE-ME", "REPLACE_ME", "PLACEHOLDER", "EXAMPLE"]
FLASK_PLACEHOLDER_VALUES = ["CHANGE-ME", "REPLACE_ME", "PLACEHOLDER", "EXAMPLE", "YOUR_SECRET_KEY"]

# --- comment prefixes ----------------------------------------------------------------
COMMENTS_PY = ["#"]
COMMENTS_CODE = ["//", "/*", "*", "#", "--"]
COMMENTS_MARKUP = ["//", "/*", "*", "#", "--", "<!--"]
COMMENTS_FRONTEND = ["//", "/*", "*"]

# --- neighbourhood words -----------------------------------------------------------------
ORM_NEEDLES = [
    "model.objects", "activerecord", "querybuilder", "sequelize",
    "typeorm", "prisma", "sqlalchemy", "django.orm", "active_record",
    "where(", "filter(", "find_by", "find_one", "query(", "select(",
]
HASHING_NEEDLES = ["hash", "bcrypt", "scrypt", "argon2", "pbkdf2", "sha256", "sha512"]
SANITIZER_NEEDLES = [
    "htmlspecialchars", "htmlentities", "escape", "sanitize", "xss", "filter",
    "strip_tags", "|escape", "|e", "textcontent",
]
PATH_INPUT_NEEDLES = ["request.", "input(", "argv", "getenv", "$_get", "$_post", "req.", "query", "params"]
PATH_JOIN_NEEDLES = ["os.path.join", "path.join", "realpath", "abspath"]
VALIDATOR_NEEDLES = ["validate", "sanitize", "escape", "filter"]
XXE_GUARDS = [
    "setfeature", "setexpandentityreferences", "setexternalgeneralentities",
    "setexternalparameterentities", "disallowdoctypedecl", "externalgeneralentities",
    "externalparameterentities", "loaddtd", "resolveexternals", "noent",
    "xml_parser_set_option.*xml_option_no_ent",
]
SSRF_GUARDS = [
    "whitelist", "allowlist", "url.*validate", "url.*sanitize",
    "localhost", "127.0.0.1", "private.*ip", "internal.*network",
]
TRAVERSAL_GUARDS = [
    "basename", "realpath", "abspath", "normalize", "canonicalize",
    "path.*join", "os.path.join", "path.resolve", "sanitize",
]

# --- workspace classification -----------------------------------------------------------------
README_NAMES = ["README.md", "README.txt", "README", "readme.md"]
SECURITY_TOOL_NAMES = [
    "trivy", "grype", "hydra", "scanner", "detector", "audit",
    "security-tool", "pentest", "exploit", "payload", "vulnerability-scanner",
]
SECURITY_TOOL_README = [
    "security scanner", "vulnerability scanner", "pentest tool",
    "security tool", "audit tool", "detection tool", "scanner tool",
]
EDUCATIONAL_NAMES = [
    "vulnerable", "vuln", "demo", "example", "sample", "test", "tutorial",
    "educational", "learning", "practice", "dvwa", "mutillidae", "webgoat",
    "broken", "snippet", "snippets",
]
EDUCATIONAL_README = [
    "educational", "learning", "tutorial", "example", "demo",
    "vulnerable", "intentionally", "for educational purposes",
    "practice", "test", "not for production",
]
WEB_FRAMEWORKS = [
    "flask", "django", "fastapi", "express", "react", "vue", "angular",
    "spring", "rails", "sinatra", "laravel", "symfony", "asp.net",
]
WEB_MANIFESTS = ["package.json", "requirements.txt", "pom.xml", "build.gradle", "Gemfile", "composer.json"]
WEB_ENTRY_FILES = ["app.py", "main.py", "server.js", "index.js", "app.js", "routes.py", "views.py"]
WEB_CODE_EXTS = [".py", ".js", ".ts", ".java", ".cs", ".php", ".rb"]
WEB_USER_DATA = ["user", "customer", "email", "password", "login", "register"]

# --- pipelines, containers, dependencies -----------------------------------------------------------------
COMPOSE_NAMES = ["docker-compose.yml", "docker-compose.yaml", "docker-compose.json", "compose.yml", "compose.yaml"]
CONTAINER_NAME_NEEDLES = ["docker", "kubernetes", "k8s"]
CICD_PATHS = [
    ".github/workflows", ".gitlab-ci.yml", "Jenkinsfile", ".travis.yml",
    "circle.yml", ".circleci", "azure-pipelines.yml", ".drone.yml",
    "bitbucket-pipelines.yml", "buildkite.yml", ".gitlab", "Jenkinsfile.groovy",
]
SUPPLY_CHAIN_NAMES = [
    ".github", ".gitlab-ci.yml", "Jenkinsfile", ".travis.yml", "circle.yml", "azure-pipelines.yml", ".circleci",
]
CONFIG_NAMES = [
    "docker-compose.yml", "docker-compose.yaml", "compose.yml",
    "settings.py", "config.py", "database.py", ".env", ".env.example",
]
LOCK_FILES = {
    "requirements.txt": "requirements.lock",
    "Gemfile": "Gemfile.lock",
    "package.json": "package-lock.json",
    "composer.json": "composer.lock",
    "go.mod": "go.sum",
}

# --- similarity scoring -----------------------------------------------------------------
SCORE_PLACEHOLDER = [
    "change-me", "replace-me", "your-", "example", "placeholder",
    "todo", "fixme", "xxx", "test", "demo", "sample", "tutorial",
    "changeme", "replaceme", "yourtokenhere", "yoursecrethere",
]
SCORE_DETECTOR = [
    "detector", "scanner", "_scan_", "pattern", "re.compile",
    "patterns =", "xss_patterns", "injection_patterns", "secret_patterns",
    "weak_cipher_patterns", "CLOUD_SECRET_PATTERNS", "SECRET_REGEX",
]
SCORE_TEST_PATH = [
    "test_", "_test", "spec_", "_spec", "mock", "fixture",
    "/test/", "/tests/", "/spec/", "/fixtures/", "/examples/",
]
SCORE_SECURITY_TOOL = ["trivy", "grype", "hydra", "scanner", "detector", "vulnerability-scanner", "security-tool"]
SCORE_REAL = [
    "admin", "password", "secret", "token", "key", "credential",
    "system(", "exec(", "eval(", "dangerously", "|safe", "autoescape off",
    "createStatement", "executeQuery", "set_cookie", "sessionStorage", "localStorage",
]
SCORE_PRODUCTION = [
    "app/", "src/", "lib/", "main.", "index.", "server.",
    "routes/", "controllers/", "models/", "services/",
]
SCORE_ENV = [
    "os.getenv", "process.env", "${", "$env", "getenv(",
    "os.environ", "environ.get", "config.get",
]
SCORE_KNOWN = [
    "sk_live_", "pk_live_", "sk_test_", "ghp_", "github_pat_",
    "AKIA", "AIza", "xoxb-", "xoxa-", "-----BEGIN",
]
SCORE_EDUCATIONAL = [
    "vulnerable", "vuln", "demo", "educational",
    "dvwa", "webgoat", "mutillidae", "intentionally",
]
