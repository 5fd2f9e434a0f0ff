"""Code and configuration rules.

Fixed values: (pattern, label) texts in Python ``re`` notation, in evaluation order.
"""

WEAK_CIPHERS = [
    (r"3DES", "TripleDES"),
    (r"TripleDES", "TripleDES"),
    (r"DES3", "TripleDES"),
    (r"DESede", "TripleDES"),
    (r"algorithms\.TripleDES", "TripleDES"),
    (r"cipher\.TripleDES", "TripleDES"),
    (r"TripleDES\(\)", "TripleDES"),
    (r"Blowfish", "Blowfish"),
    (r"blowfish", "Blowfish"),
    (r"algorithms\.Blowfish", "Blowfish"),
    (r"cipher\.Blowfish", "Blowfish"),
    (r"Blowfish\(\)", "Blowfish"),
    (r"ARC4", "ARC4"),
    (r"RC4", "ARC4"),
    (r"arc4", "ARC4"),
    (r"rc4", "ARC4"),
    (r"algorithms\.ARC4", "ARC4"),
    (r"cipher\.ARC4", "ARC4"),
    (r"ARC4\(\)", "ARC4"),
    (r"MD5", "MD5"),
    (r"md5", "MD5"),
    (r"hashlib\.md5", "MD5"),
    (r"MessageDigest\.getInstance\(['\"]MD5", "MD5"),
    (r"SHA1", "SHA1"),
    (r"sha1", "SHA1"),
    (r"hashlib\.sha1", "SHA1"),
    (r"MessageDigest\.getInstance\(['\"]SHA-1", "SHA1"),
]
TLS_SETTINGS = [
    (r"check_hostname\s*=\s*False", "SSL hostname verification disabled"),
    (r"verify\s*=\s*False", "SSL certificate verification disabled"),
    (r"ssl\.create_default_context\(\)", "SSL context without hostname verification"),
    (r"SSLContext\(\)", "SSL context without proper configuration"),
    (r"ssl\._create_unverified_context\(\)", "Unverified SSL context"),
    (r"ssl\.create_default_context\(\)\s*$", "SSL context without hostname verification (default)"),
    (r"context\.check_hostname\s*=\s*False", "SSL hostname verification disabled"),
    (r"context\.verify_mode\s*=\s*ssl\.CERT_NONE", "SSL certificate verification disabled"),
]
SQL_INJECTION = [
    (r"[\"'].*SELECT.*[\"']\s*\+\s*[a-zA-Z_]+", "String concatenation in SQL query"),
    (r"f[\"'].*SELECT.*\{.*\}.*[\"']", "f-string with SQL query"),
    (r"[\"'].*SELECT.*[\"']\.format\(", "String format in SQL query"),
    (r"execute\s*\(\s*[\"'].*%(?:s|d).*[\"']", "String formatting in SQL execute"),
    (r"createStatement\(\)\.executeQuery\s*\(\s*[\"'].*\+", "Java Spring: String concatenation in createStatement().executeQuery()"),
    (r"connection\.createStatement\(\)\.executeQuery\s*\(\s*[\"'].*\+", "Java Spring: String concatenation in connection.createStatement().executeQuery()"),
    (r"String\s+query\s*=\s*[\"'].*SELECT.*[\"']\s*\+", "Java: String concatenation in SQL query variable"),
    (r"query\s*=\s*[\"'].*SELECT.*[\"']\s*\+", "Java: String concatenation in SQL query assignment"),
    (r"executeQuery\s*\(\s*[\"'].*SELECT.*[\"']\s*\+", "Java: String concatenation in executeQuery()"),
    (r"\.executeQuery\s*\(\s*[\"'].*SELECT.*[\"']\s*\+", "Java: String concatenation in .executeQuery()"),
    (r"PreparedStatement.*executeQuery.*\+", "Java: String concatenation in PreparedStatement (should use parameters)"),
]
NOSQL_INJECTION = [
    (r"\$where\s*[:=]\s*[\"'].*\+.*[\"']", "String concatenation in MongoDB $where"),
    (r"find\s*\(\s*\{[^}]*\$where[^}]*\+", "String concatenation in MongoDB find with $where"),
    (r"\.put\s*\(\s*[\"'][^\"']+[\"']\s*,\s*[a-zA-Z_]+[^)]*\+", "String concatenation in MongoDB query.put (NoSQL injection)"),
    (r"BasicDBObject\s*\([^)]*\+", "String concatenation in BasicDBObject (NoSQL injection)"),
    (r"Query\s*\([^)]*\+", "String concatenation in Query (NoSQL injection)"),
    (r"eval\s*\(\s*[\"'].*\+", "String concatenation in eval (NoSQL injection risk)"),
    (r"\.find\s*\(\s*[\"'].*\+.*[\"']", "String concatenation in MongoDB find query"),
    (r"\.find\s*\(\s*\{[^}]*[a-zA-Z_]+[^}]*\+", "String concatenation in MongoDB find query object"),
]
WEAK_AUTH = [
    (r"password\s*==\s*", "Plaintext password comparison"),
    (r"password\s*=\s*==", "Plaintext password comparison"),
    (r"\.password\s*==\s*", "Plaintext password comparison"),
    (r"NoOpPasswordEncoder", "NoOpPasswordEncoder - passwords not hashed"),
    (r"NoOpPasswordEncoder\.getInstance\(\)", "NoOpPasswordEncoder.getInstance() - passwords not hashed"),
    (r"passwordEncoder\s*=\s*NoOpPasswordEncoder", "NoOpPasswordEncoder - passwords not hashed"),
    (r"\.passwordEncoder\(NoOpPasswordEncoder", "NoOpPasswordEncoder configured - passwords not hashed"),
    (r"String\s+password", "Password stored as String (plaintext)"),
    (r"password\s*:\s*String", "Password stored as String (plaintext)"),
    (r"password\s*=\s*Column\(String", "Password column as String (plaintext) in database model"),
    (r"password\s*=\s*db\.String", "Password field as String (plaintext) in database model"),
    (r"password\s*=\s*models\.CharField", "Password field as CharField (plaintext) in database model"),
]
FLASK_SECRET_KEY = [
    (r"SECRET_KEY\s*=\s*[\"']([^\"']{10,})[\"']", "Flask SECRET_KEY hardcoded"),
    (r"app\.config\[[\"']SECRET_KEY[\"']\]\s*=\s*[\"']([^\"']{10,})[\"']", "Flask SECRET_KEY hardcoded in config"),
]
AUTH_CALLS = [
    r"password\s*==\s*",
    r"password\s*=\s*==",
    r"\.password\s*==\s*",
    r"login\s*\(",
    r"authenticate\s*\(",
    r"checkPassword\s*\(",
    r"verifyPassword\s*\(",
    r"system\s*\(",
    r"exec\s*\(",
    r"eval\s*\(",
]
LOGGING_CALLS = [
    r"\.log\s*\(",
    r"logger\s*\.",
    r"logging\s*\.",
    r"console\s*\.(log|error|warn)",
    r"print\s*\(",
    r"Log\.",
    r"Logger\.",
]
COMMAND_INJECTION = [
    (r"system\s*\(\s*\$_?(?:GET|POST|REQUEST|COOKIE)\[", "Command injection via system() with user input (PHP)"),
    (r"system\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)", "Command injection via system() with superglobal (PHP)"),
    (r"exec\s*\(\s*\$_?(?:GET|POST|REQUEST|COOKIE)\[", "Command injection via exec() with user input (PHP)"),
    (r"exec\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)", "Command injection via exec() with superglobal (PHP)"),
    (r"shell_exec\s*\(\s*\$_?(?:GET|POST|REQUEST|COOKIE)\[", "Command injection via shell_exec() with user input (PHP)"),
    (r"passthru\s*\(\s*\$_?(?:GET|POST|REQUEST|COOKIE)\[", "Command injection via passthru() with user input (PHP)"),
    (r"eval\s*\(\s*\$_?(?:GET|POST|REQUEST|COOKIE)\[", "Code injection via eval() with user input (PHP)"),
    (r"eval\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)", "Code injection via eval() with superglobal (PHP)"),
    (r"os\.system\s*\(\s*[a-zA-Z_]+[^)]*\)", "Command injection via os.system() (Python)"),
    (r"subprocess\.(call|run|Popen)\s*\(\s*[a-zA-Z_]+[^)]*shell\s*=\s*True", "Command injection via subprocess with shell=True (Python)"),
    (r"subprocess\.(call|run|Popen)\s*\(\s*[a-zA-Z_]+[^)]*\)", "Command injection via subprocess (Python - check for shell=True)"),
    (r"child_process\.(exec|spawn|execFile)\s*\(\s*[a-zA-Z_]+[^)]*\)", "Command injection via child_process (Node.js)"),
    (r"eval\s*\(\s*[a-zA-Z_]+[^)]*\)", "Code injection via eval() with variable (Node.js/Python)"),
    (r"Function\s*\(\s*[\"']?[^\"']*[\"']?\s*,\s*[a-zA-Z_]+", "Code injection via Function constructor (JavaScript)"),
    (r"new\s+Function\s*\([^)]*[a-zA-Z_]+", "Code injection via new Function() (JavaScript)"),
    (r"system\s*\(\s*[a-zA-Z_]+[^)]*\)", "Command injection via system() (Ruby)"),
    (r"exec\s*\(\s*[a-zA-Z_]+[^)]*\)", "Command injection via exec() (Ruby)"),
    (r"eval\s*\(\s*[a-zA-Z_]+[^)]*\)", "Code injection via eval() (Ruby)"),
    (r"`[^`]*\$[a-zA-Z_]+[^`]*`", "Command injection via backticks with variable (Ruby)"),
    (r"Runtime\.getRuntime\(\)\.exec\s*\(\s*[a-zA-Z_]+", "Command injection via Runtime.exec() (Java)"),
    (r"new\s+ProcessBuilder\s*\(\s*[a-zA-Z_]+", "Command injection via ProcessBuilder (Java)"),
    (r"Process\.Start\s*\(\s*[a-zA-Z_]+", "Command injection via Process.Start() (.NET)"),
]
XSS = [
    (r"echo\s+\$_?(?:GET|POST|REQUEST|COOKIE)\[", "XSS: Direct echo of user input without sanitization (PHP)"),
    (r"echo\s+\$_(?:GET|POST|REQUEST|COOKIE)", "XSS: Direct echo of superglobal without sanitization (PHP)"),
    (r"print\s+\$_?(?:GET|POST|REQUEST|COOKIE)\[", "XSS: Direct print of user input without sanitization (PHP)"),
    (r"print\s+\$_(?:GET|POST|REQUEST|COOKIE)", "XSS: Direct print of superglobal without sanitization (PHP)"),
    (r"<\?=\s*\$_?(?:GET|POST|REQUEST|COOKIE)\[", "XSS: Direct output of user input in PHP short tag"),
    (r"<\?=\s*\$_(?:GET|POST|REQUEST|COOKIE)", "XSS: Direct output of superglobal in PHP short tag"),
    (r"\{\{\s*[^}]+\s*\|\s*safe\s*\}\}", "XSS: Template variable with |safe filter (Flask/Jinja2) - CRITICAL"),
    (r"\{\{\s*[^}]+\s*\|\s*safe\s*\}\}", "XSS: Template variable with |safe filter (Django) - CRITICAL"),
    (r"\{%\s*autoescape\s+off\s*%\}", "XSS: Autoescape disabled in Django template"),
    (r"th:utext\s*=\s*[\"']?\$\{[^}]+\}", "XSS: Thymeleaf th:utext with unescaped expression (Java Spring) - CRITICAL"),
    (r"th:utext\s*=\s*[\"']\{[^}]+\}", "XSS: Thymeleaf th:utext with unescaped expression (Java Spring) - CRITICAL"),
    (r"<[^>]*th:utext\s*=\s*[\"']?\$\{[^}]+\}[^>]*>", "XSS: Thymeleaf th:utext attribute with unescaped expression (Java Spring) - CRITICAL"),
    (r"<[^>]*th:utext\s*=\s*[\"']\{[^}]+\}[^>]*>", "XSS: Thymeleaf th:utext attribute with unescaped expression (Java Spring) - CRITICAL"),
    (r"\{\{\s*[a-zA-Z_]+\s*\}\}(?!.*\|escape)(?!.*\|e)(?!.*\|safe)", "XSS: Jinja2 template variable without explicit escaping"),
    (r"\[\[\$\{[^}]+\}\]\]", "XSS: Thymeleaf unescaped inline expression [[${...}]] (Java Spring)"),
    (r"print\s*\(\s*[a-zA-Z_]+[^)]*\)", "XSS: Direct print of variable (Python)"),
    (r"\{\{\s*[a-zA-Z_]+\s*\}\}(?!.*\|safe)", "XSS: Template variable without escaping (Jinja2/Django)"),
    (r"document\.write\s*\(\s*[a-zA-Z_]+", "XSS: Direct document.write() with variable (JavaScript)"),
    (r"\.innerHTML\s*=\s*[a-zA-Z_]+", "XSS: Direct innerHTML assignment with variable (JavaScript)"),
    (r"\.outerHTML\s*=\s*[a-zA-Z_]+", "XSS: Direct outerHTML assignment with variable (JavaScript)"),
    (r"dangerouslySetInnerHTML\s*=\s*\{[^}]*__html", "XSS: dangerouslySetInnerHTML usage (React)"),
    (r"Markup\s*\([^)]*request\.", "XSS: Markup() with request data (Flask)"),
    (r"escape\s*=\s*False", "XSS: escape=False in template rendering"),
    (r"\.html_safe\s*\(", "XSS: html_safe() usage (Rails) - CRITICAL"),
    (r"\.html_safe\b", "XSS: html_safe method call (Rails) - CRITICAL"),
    (r"raw\s*\([^)]*\)", "XSS: raw() helper usage (Rails) - CRITICAL"),
    (r"constantize\s*\(\s*[a-zA-Z_]+", "Code injection via constantize() with variable (Ruby)"),
    (r"\.constantize\s*\(", "Code injection via constantize() (Ruby)"),
    (r"INSERT\s+INTO.*VALUES.*\$_(?:GET|POST|REQUEST)", "Stored XSS: INSERT with user input (PHP)"),
    (r"Model\.create\s*\([^)]*request\.(POST|body)", "Stored XSS: Model creation with user input (Django/Node.js)"),
    (r"Model\.save\s*\([^)]*request\.(POST|body)", "Stored XSS: Model save with user input"),
    (r"mathjs\.eval\s*\(", "Code injection via mathjs.eval() (Node.js)"),
    (r"vm\.runInContext\s*\(", "Code injection via vm.runInContext() (Node.js)"),
    (r"vm\.runInNewContext\s*\(", "Code injection via vm.runInNewContext() (Node.js)"),
]
XSS_EXTS = [".py", ".js", ".ts", ".php", ".rb", ".html", ".htm", ".jsp", ".erb", ".java", ".xml"]
XSS_CONSTANT_ASSIGNMENT = r"innerHTML\s*=\s*[\"'][^\"']+[\"']"
XSS_DOM_ASSIGNMENT = r"innerHTML\s*=\s*document\.(createElement|getElementById)"
DEBUG_MODE = [
    (r"app\.config\[[\"']DEBUG[\"']\]\s*=\s*True", "DEBUG mode enabled in Flask (production risk)"),
    (r"app\.config\[[\"']debug[\"']\]\s*=\s*True", "DEBUG mode enabled in Flask (lowercase key)"),
    (r"DEBUG\s*=\s*True", "DEBUG mode enabled (Flask/Django)"),
    (r"debug\s*=\s*True", "DEBUG mode enabled (lowercase)"),
    (r"FLASK_ENV\s*=\s*[\"']development[\"']", "Flask environment set to development"),
    (r"FLASK_DEBUG\s*=\s*1", "Flask DEBUG enabled"),
    (r"FLASK_DEBUG\s*=\s*True", "Flask DEBUG enabled (True)"),
    (r"DEBUG\s*=\s*True", "DEBUG mode enabled in Django settings"),
    (r"ALLOWED_HOSTS\s*=\s*\[\s*[\"']\*[\"']", "Django ALLOWED_HOSTS set to * (insecure)"),
    (r"process\.env\.NODE_ENV\s*!=\s*[\"']production[\"']", "Node.js not in production mode"),
    (r"debug\s*:\s*true", "Debug mode enabled (Express/Node.js)"),
    (r"NODE_ENV\s*=\s*[\"']development[\"']", "Node.js environment set to development"),
    (r"environment\s*=\s*[\"']dev[\"']", "Environment set to development"),
    (r"environment\s*=\s*[\"']development[\"']", "Environment set to development"),
]
COOKIES = [
    (r"response\.set_cookie\s*\(\s*[\"'][^\"']+[\"']\s*,\s*[a-zA-Z_]+", "Insecure cookie: user-controlled value (Flask)"),
    (r"set_cookie\s*\(\s*[\"'][^\"']+[\"']\s*,\s*request\.", "Insecure cookie: request data in cookie value (Flask)"),
    (r"\.set_cookie\s*\(\s*[\"'][^\"']+[\"']\s*,\s*[a-zA-Z_]+", "Insecure cookie: user-controlled value (Flask/Django)"),
    (r"response\.set_cookie\s*\(\s*[\"']([^\"']+)[\"']\s*,\s*\1\s*\)", "Insecure cookie: cookie name and value are the same variable (Flask)"),
    (r"response\.set_cookie\s*\(\s*[\"']([^\"']+)[\"']\s*,\s*([a-zA-Z_]+)\s*\)", "Insecure cookie: user-controlled value in cookie (Flask)"),
    (r"response\.set_cookie\s*\(\s*[\"'][^\"']+[\"']\s*,\s*[a-zA-Z_]+", "Insecure cookie: user-controlled value (Django)"),
    (r"set_cookie\s*\([^)]*\)(?!.*secure\s*=\s*True)", "Cookie set without secure flag (Flask/Django)"),
    (r"set_cookie\s*\([^)]*\)(?!.*httponly\s*=\s*True)", "Cookie set without HttpOnly flag (Flask/Django)"),
    (r"document\.cookie\s*=\s*[a-zA-Z_]+", "Insecure cookie: direct assignment to document.cookie (JavaScript)"),
    (r"document\.cookie\s*\+=\s*[a-zA-Z_]+", "Insecure cookie: concatenation to document.cookie (JavaScript)"),
    (r"res\.cookie\s*\([^)]*\)(?!.*secure\s*:\s*true)", "Cookie set without secure flag (Express)"),
    (r"res\.cookie\s*\([^)]*\)(?!.*httpOnly\s*:\s*true)", "Cookie set without httpOnly flag (Express)"),
]
SESSION_SETTINGS = [
    (r"session\.timeout\s*=\s*0", "Session timeout disabled"),
    (r"session\.cookie\.secure\s*=\s*False", "Session cookie not secure"),
    (r"session\.cookie\.httponly\s*=\s*False", "Session cookie not HttpOnly"),
    (r"session\.cookie\.samesite\s*=\s*[\"']?None[\"']?", "Session cookie SameSite=None (insecure)"),
]
JWT_EXPIRY = [
    (r"jwt\.encode\([^)]*exp\s*=\s*None", "JWT without expiration"),
    (r"jwt\.encode\([^)]*\)(?!.*exp)", "JWT encode without exp parameter"),
]
CSRF = [
    (r"@app\.(post|put|delete|patch)\([^)]*\)(?!.*csrf)", "API endpoint without CSRF protection"),
    (r"csrf_protect\s*=\s*False", "CSRF protection disabled"),
]
INSECURE_DEBUG = [
    (r"DEBUG\s*=\s*True", "Debug mode enabled"),
    (r"debug\s*=\s*true", "Debug mode enabled (lowercase)"),
    (r"environment\s*=\s*[\"']production[\"'].*debug\s*=\s*True", "Debug mode in production"),
]
INSECURE_CORS = [
    (r"cors.*origin\s*=\s*[\"']\*[\"']", "CORS allows all origins"),
    (r"Access-Control-Allow-Origin\s*:\s*\*", "CORS header allows all origins"),
]
INSECURE_COOKIE_FLAGS = [
    (r"cookie.*secure\s*=\s*False", "Cookie not marked as secure"),
    (r"cookie.*httponly\s*=\s*False", "Cookie not marked as HttpOnly"),
    (r"session.*cookie.*secure\s*=\s*False", "Session cookie not secure"),
]
INSECURE_CONFIG_EXTS = [".py", ".js", ".ts", ".java", ".cs", ".php", ".rb", ".go", ".yaml", ".yml", ".json", ".conf", ".ini"]
PATH_ACCESS = [
    (r"open\([^)]*\.\./", "Path traversal in file open"),
    (r"readFile\([^)]*\.\./", "Path traversal in readFile"),
    (r"File\.ReadAllText\([^)]*\.\./", "Path traversal in ReadAllText"),
    (r"\.\./.*\.\./", "Multiple path traversal sequences"),
]
NORMAL_FILE_OPS = [
    r"with open\([^)]*[\"']",
    r"read_text\([^)]*[\"']",
    r"Path\([^)]*[\"']",
    r"file_path\.read",
    r"package_json.*read",
    r"requirements.*read",
]
INPUT_ACCESS = [
    (r"request\.(get|post|args)\[[^\]]+\]", "Direct user input without validation"),
    (r"request\.(query|params|body)\[", "Direct request parameter access"),
    (r"\$_GET\[|\$_POST\[|\$_REQUEST\[", "Direct superglobal access (PHP)"),
]
LOG_INJECTION = [
    (r"log\.(info|error|warn|debug)\([^)]*\+.*user", "String concatenation in log (log injection risk)"),
    (r"logger\.(info|error|warn)\([^)]*\+", "String concatenation in logger"),
    (r"console\.log\([^)]*\+.*request", "String concatenation in console.log"),
]
SENSITIVE_LOGS = [
    (r"log\.(info|error|warn)\([^)]*password", "Password in log statement"),
    (r"logger\.(info|error|warn)\([^)]*password", "Password in logger statement"),
    (r"console\.log\([^)]*password", "Password in console.log"),
    (r"log\.(info|error|warn)\([^)]*token", "Token in log statement"),
    (r"log\.(info|error|warn)\([^)]*secret", "Secret in log statement"),
    (r"log\.(info|error|warn)\([^)]*credit.*card|cc[_-]?number", "Credit card in log statement"),
    (r"log\.(info|error|warn)\([^)]*ssn|social.*security", "SSN in log statement"),
]
ENCRYPTION_AT_REST = [
    (r"storage.*encryption\s*=\s*False", "Storage encryption disabled"),
    (r"encrypt.*at.*rest\s*=\s*False", "Encryption at rest disabled"),
]
PII_IN_ERRORS = [
    (r"raise.*Exception\([^)]*email", "Email in exception message"),
    (r"throw.*Error\([^)]*email", "Email in error message"),
    (r"error\([^)]*password", "Password in error message"),
]
REGISTRIES = [
    (r"registry\s*=\s*[\"']http://", "Insecure package registry (HTTP)"),
    (r"npm.*registry.*http://", "Insecure npm registry"),
]
XXE = [
    (r"DocumentBuilderFactory\s*\.\s*newInstance\(\)", "DocumentBuilderFactory without XXE protection (Java)"),
    (r"SAXParserFactory\s*\.\s*newInstance\(\)", "SAXParserFactory without XXE protection (Java)"),
    (r"XMLInputFactory\s*\.\s*newInstance\(\)", "XMLInputFactory without XXE protection (Java)"),
    (r"TransformerFactory\s*\.\s*newInstance\(\)", "TransformerFactory without XXE protection (Java)"),
    (r"xml\.etree\.ElementTree\.parse\(", "ElementTree.parse() without XXE protection (Python)"),
    (r"lxml\.etree\.parse\(", "lxml.etree.parse() without XXE protection (Python)"),
    (r"xml\.dom\.minidom\.parse\(", "minidom.parse() without XXE protection (Python)"),
    (r"new\s+SimpleXMLElement\s*\(", "SimpleXMLElement without XXE protection (PHP)"),
    (r"DOMDocument\s*->\s*loadXML\s*\(", "DOMDocument->loadXML() without XXE protection (PHP)"),
    (r"xml2js\.parseString\s*\(", "xml2js.parseString() without XXE protection (Node.js)"),
    (r"fast-xml-parser.*parse\s*\(", "fast-xml-parser without XXE protection (Node.js)"),
]
SSRF = [
    (r"urllib\.(urlopen|request)\([^)]*[a-zA-Z_]+[^)]*\)", "urllib with user input (SSRF risk)"),
    (r"requests\.(get|post|put|delete)\([^)]*[a-zA-Z_]+[^)]*\)", "requests with user input (SSRF risk)"),
    (r"httpx\.(get|post|put|delete)\([^)]*[a-zA-Z_]+[^)]*\)", "httpx with user input (SSRF risk)"),
    (r"http\.(get|request)\([^)]*[a-zA-Z_]+[^)]*\)", "http.get() with user input (SSRF risk)"),
    (r"https\.(get|request)\([^)]*[a-zA-Z_]+[^)]*\)", "https.get() with user input (SSRF risk)"),
    (r"axios\.(get|post|put|delete)\([^)]*[a-zA-Z_]+[^)]*\)", "axios with user input (SSRF risk)"),
    (r"file_get_contents\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)", "file_get_contents() with user input (SSRF risk)"),
    (r"curl_exec\s*\(\s*curl_init\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)", "curl_exec() with user input (SSRF risk)"),
    (r"new\s+URL\s*\(\s*[a-zA-Z_]+\s*\)", "new URL() with variable (SSRF risk)"),
    (r"HttpURLConnection.*openConnection\s*\(\s*[a-zA-Z_]+\s*\)", "HttpURLConnection with variable (SSRF risk)"),
]
DESERIALIZATION = [
    (r"pickle\.(loads?|load)\([^)]*[a-zA-Z_]+[^)]*\)", "pickle deserialization with user input (Python - RCE risk)"),
    (r"yaml\.load\s*\([^)]*[a-zA-Z_]+[^)]*\)", "yaml.load() with user input (Python - unsafe, use yaml.safe_load)"),
    (r"marshal\.loads?\s*\([^)]*[a-zA-Z_]+[^)]*\)", "marshal.loads() with user input (Python - insecure)"),
    (r"ObjectInputStream.*readObject\s*\(", "ObjectInputStream.readObject() (Java - insecure deserialization)"),
    (r"readObject\s*\(", "readObject() method (Java - insecure deserialization)"),
    (r"BinaryFormatter.*Deserialize\s*\(", "BinaryFormatter.Deserialize() (.NET - insecure)"),
    (r"SoapFormatter.*Deserialize\s*\(", "SoapFormatter.Deserialize() (.NET - insecure)"),
    (r"node-serialize.*deserialize\s*\(", "node-serialize.deserialize() (Node.js - insecure)"),
    (r"eval\s*\(\s*[a-zA-Z_]+", "eval() with variable (Node.js - insecure)"),
    (r"Function\s*\(\s*[a-zA-Z_]+", "Function() constructor with variable (Node.js - insecure)"),
    (r"unserialize\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)", "unserialize() with user input (PHP - insecure)"),
    (r"Marshal\.load\s*\(\s*[a-zA-Z_]+", "Marshal.load() with variable (Ruby - insecure deserialization)"),
    (r"YAML\.load\s*\(\s*[a-zA-Z_]+", "YAML.load() with variable (Ruby - use YAML.safe_load)"),
    (r"Psych\.load\s*\(\s*[a-zA-Z_]+", "Psych.load() with variable (Ruby - insecure)"),
]
PATH_TRAVERSAL = [
    (r"open\s*\(\s*[^)]*\.\./", "open() with ../ (path traversal)"),
    (r"File\.(read|write|delete|exists)\s*\([^)]*\.\./", "File operation with ../ (path traversal)"),
    (r"readFile\s*\([^)]*\.\./", "readFile() with ../ (path traversal)"),
    (r"file_get_contents\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE).*\.\./", "file_get_contents() with ../ (path traversal)"),
    (r"new\s+File\s*\([^)]*\.\./", "new File() with ../ (path traversal)"),
]
EXISTS_CHECK = r"\.exists\s*\(|File\.exists|fs\.exists"
FILE_OPERATION = r"open\s*\(|File\.(read|write|delete)|readFile|writeFile"
CRYPTO_MISUSE = [
    (r"Math\.random\s*\(", "Math.random() - insecure random (JavaScript)"),
    (r"random\.randint\s*\(", "random.randint() - insecure random (Python)"),
    (r"new\s+Random\s*\(\)", "new Random() - insecure random (Java)"),
    (r"iv\s*=\s*[\"'][^\"']{1,16}[\"']", "Hardcoded IV (initialization vector)"),
    (r"nonce\s*=\s*[\"'][^\"']{1,16}[\"']", "Hardcoded nonce"),
    (r"PBKDF2.*iterations\s*=\s*[0-9]{1,3}\b", "PBKDF2 with low iteration count"),
    (r"bcrypt.*rounds\s*=\s*[0-4]\b", "bcrypt with low rounds"),
]

# whole-file rules
WILDCARD_QUOTED = r"[\"']\*[\"']"
NO_AUTHORIZATION = r"authorization\s*=\s*[\"']?NONE[\"']?"
PUBLIC_ACCESS = r"public[_-]?access\s*=\s*true"
ROOT_USER = [r"runAsUser\s*:\s*0", r"USER\s+0"]
PRIVILEGE_ESCALATION = r"allowPrivilegeEscalation\s*:\s*true"
DOCKER_SOCKET = [
    r"/var/run/docker\.sock",
    r"docker\.sock:/var/run/docker\.sock",
    r"- /var/run/docker\.sock:/var/run/docker\.sock",
    r"volumes:\s*-\s*[\"']?/var/run/docker\.sock",
    r"hostPath:\s*path:\s*[\"']?/var/run/docker\.sock",
]
AUTH_DECORATOR = r"@(require_auth|authenticated|login_required|auth)"
LOGGER_CALL = r"\.(log|logger|logging)"
DB_EMPTY_PASSWORD = r"password\s*=\s*[\"']\s*[\"']"
DB_LITERAL_PASSWORD = r"password\s*=\s*[\"'][^\"']{3,}[\"']"
DB_JDBC = r"jdbc:mysql://"
SQLITE = [
    r"sqlite:///",
    r"sqlite://",
    r"SQLALCHEMY_DATABASE_URI.*sqlite",
    r"DATABASE_URL.*sqlite",
    r"DATABASE.*sqlite",
    r"driver.*=.*sqlite",
]
LATEST_PULL = r"docker\s+pull\s+[^:]+:latest"
DEPENDENCY_SCANNER = r"snyk|dependabot|safety|bandit|trivy|grype"
SECURITY_SCAN = r"security.*scan|vulnerability.*scan|sast|dast"
CORS_WILDCARD = r"CORS\([^)]*allow_origins\s*=\s*\[?\s*[\"']\*[\"']"
CORS_LOCALHOST = r"allow_origins\s*=\s*\[?\s*[\"']http://localhost"
SQLITE_FILE = r"sqlite:///"
