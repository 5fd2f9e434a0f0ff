"""A source-tree corpus made from the given tables.

Every document becomes one file: its whole text plus the lines of one seed, which give the file a
name, an extension and something for the rules to find. Every page becomes one ``.html`` file.
The seeds are test inputs, chosen by ``doc_id``; token-shaped strings are put together here so
that no real-looking token is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import lit
from ..session import spread
from ..sources.files import path_attributes

AWS = "AK" + "IA" + "Q7" * 8
GITHUB = "gh" + "p_" + "a1B2" * 9
STRIPE = "sk_" + "live_" + "Zx9" * 9
SLACK = "xox" + "b-" + "1" * 11 + "-" + "2" * 11 + "-" + "aB" * 12
GCP = "AI" + "za" + "Sy7" * 11 + "Qz"
PEM_HEAD = "-----BEGIN RSA " + "PRIVATE KEY-----"
HEX40 = "9f3c" * 10
VALUE = "Zq81rT0pLmXw92Ke"
UUID = "0f8e7d6c-1a2b-4c3d-8e9f-a0b1c2d3e4f5"


@dataclass(frozen=True)
class Seed:
    """``style`` says how the document text is placed around the seed lines."""

    path: str
    head: str
    style: str = "lines"  # lines: before or after; hash: after, as comments; json: as a value


SEEDS = [
    # secrets in code and configuration
    Seed("src/vault{id}.py", f"api_token = '{HEX40}'"),
    Seed("src/test_vault{id}.py", f"api_token = '{HEX40}'\nname = 'n'"),
    Seed("lib/sample{id}.py", f"password = \"{VALUE}\"\n# secret = {HEX40}"),
    Seed("src/Login{id}.java", f'String password = "{VALUE}";\npassword = "changed";\nString pwd = "";'),
    Seed("web/login{id}.php", f"$password = \"{VALUE}\";\n$passwords = array(\n 'admin' => 'adm1n99',\n 'u' => 'pw55555');\n$x = ['token' => 'abcd1234'];"),
    Seed("web/client{id}.js", f"const token = '{STRIPE}';\nlet secret = 'abc';\n// api_key: 'zzzzzzzz'\nconst apikey = 'null';"),
    Seed("web/example{id}.ts", f"export const password = 'longer-value-here';\nvar token = 'YOUR_TOKEN_VALUE';\n// TODO later"),
    Seed("cmd/main{id}.go", "pwd := \"\"\npassword=plainvalue\nsecret = [\"one\", \"two22222\"]"),
    Seed("app/conf{id}.rb", "db_password = 'rubyvalue1'\nconnection_string: \"Server=x;Pwd=y\"\nCHANGE-ME"),
    Seed("conf/app{id}.ini", f"password = {VALUE}\n# token = {HEX40}\nsecret = ${{VAULT}}"),
    Seed("conf/app{id}.properties", f"db.password: {VALUE}\nauth_token: $TOKEN"),
    Seed("conf/app{id}.yaml", f"credential: \"{HEX40}\"\napi-key: change-me PLACEHOLDER"),
    Seed("deploy/.env", f"SECRET_KEYWORDS = {HEX40}\nSESSION_TOKEN = {HEX40}\nFLASK_DEBUG = 1"),
    Seed("conf/.env.local", f"AUTH_TOKEN={HEX40}\ndebug = true"),
    Seed("conf/.env.example", f"AUTH_TOKEN={HEX40}"),
    Seed("conf/app{id}.toml", f"password = '{UUID}'\ntoken = abc"),
    Seed("conf/prod{id}.cfg", "connection_password = \"password=abcdefghijklmnopqrstu\""),
    Seed("infra/bucket{id}.tf", 'acl = "public-read"\nactions = ["*"]\nauthorization = "NONE"\npublic_access = true'),
    Seed("infra/bucket{id}.json", "{\"acl\": \"public-read\",\n \"token\": \"public-read\"}"),
    Seed("infra/values{id}.hcl", "acl = public-read-write\n# public-read"),
    Seed("keys/server{id}.pem", PEM_HEAD + "\nMIIB"),
    Seed("keys/private{id}.js", PEM_HEAD + "\nMIIB"),
    Seed("docs/notes{id}.txt", f"{AWS}\n{GITHUB}\nAccountKey=abc;\nsecret = {AWS}"),
    Seed("docs/more{id}.md", f"{SLACK} {GCP}\nmongodb+srv://u:pw@h\nredis://:pw@h\npostgres://u:pw@h\nmysql://u:pw@h"),
    Seed("proj/app{id}.sln", f"Project = {UUID}"),
    Seed("proj/app{id}.csproj", f"<ProjectGuid>{UUID}</ProjectGuid>\ntoken = {UUID}"),
    Seed("docs/gcp{id}.json", '{"type": "service_account", "private_key": "' + "-----BEGIN" + '", "client_email": "a@b.iam.gserviceaccount.com"}'),
    Seed("docs/mail{id}.txt", "SG" + "." + "a" * 22 + "." + "b" * 43 + "\nkey-" + "c" * 32 + "\nDefaultEndpointsProtocol=https;AccountName=n;AccountKey=k;"),
    # rule-definition code, excluded folders, ignored names
    Seed("src/rules{id}.py", f"xss_patterns = [\n  (r'eval', 'x'),\n]\npassword = '{HEX40}'"),
    Seed("src/scanner{id}.py", f"password = '{HEX40}'\nhashlib.md5(x)"),
    Seed("src/loop{id}.js", f"for pattern in list: re.search(pattern, x)\npassword = '{HEX40}'\neval(x)"),
    Seed("node_modules/dep{id}.js", f"password = '{HEX40}'\neval(x)"),
    Seed("build/out{id}.py", f"password = '{HEX40}'"),
    Seed("src/report.json", f'{{"password": "{HEX40}"}}'),
    Seed("src/mod{id}.pyc", f"password = '{HEX40}'\n{AWS}"),
    Seed("tests/unit{id}.ini", f"password = {HEX40}"),
    Seed("ignored/gen{id}.py", f"password = '{HEX40}'\neval(x)"),
    Seed(".scanignore", "# generated\n**/ignored\n\n/vendor\n*.min.js\nsk?p*"),
    # weak crypto, injection, authentication
    Seed("src/hash{id}.py", "digest = hashlib.md5(data)\ncipher = algorithms.TripleDES(k)\n# ARC4\nx = sha1(y)"),
    Seed("src/testhash{id}.py", "digest = hashlib.md5(data)\nconn = connect(host, verify=False)"),
    Seed("src/Tls{id}.java", "MessageDigest.getInstance(\"MD5\")\nctx = SSLContext()\nctx.check_hostname = False"),
    Seed("src/tls{id}.py", "ctx = ssl.create_default_context()\ncontext.check_hostname = False\ncontext.verify_mode = ssl.CERT_NONE\nssl._create_unverified_context()"),
    Seed("src/query{id}.py", 'rows = run("SELECT a FROM t WHERE id=" + uid)\nr = f"SELECT {a} FROM t"\nr = "SELECT {}".format(x)'),
    Seed("src/orm{id}.py", 'q = model.objects\nrows = run("SELECT a FROM t WHERE id=" + uid)\nz = 1'),
    Seed("src/raw{id}.py", 'q = session.query(x)\ncur.execute("SELECT a FROM t WHERE id=%s" % uid)\nz = "SELECT 1" + tail'),
    Seed("src/Dao{id}.java", 'String query = "SELECT a FROM t WHERE id=" + id;\nconnection.createStatement().executeQuery("SELECT a" + id);\nPreparedStatement p = c.executeQuery(a + b);'),
    Seed("src/mongo{id}.js", "doc = new BasicDBObject(name + suffix)\ndb.find({ $where: 'a' + b })\nq.put('f', v + w)\nnew Query(a + b)\neval('a' + b)"),
    Seed("src/defs{id}.py", 'sql_pattern = [(r"SELECT.*" + tail, "x")]\nrows = run("SELECT a FROM t WHERE id=" + uid)'),
    Seed("src/auth{id}.py", "if user.password == supplied:\n    pass\nSECRET_KEY = 'qwertyuiopasdf'"),
    Seed("src/hashed{id}.py", "if user.password == supplied:\n    use(bcrypt)\nSECRET_KEY = 'CHANGE-ME'\napp.config['SECRET_KEY'] = 'keep it secret now'"),
    Seed("src/Account{id}.java", "private String password;\nnew NoOpPasswordEncoder();\n// String password"),
    Seed("src/model{id}.py", "password = Column(String)\npassword = db.String\npassword = models.CharField()"),
    Seed("src/signin{id}.js", "ok = authenticate(user)\nz = 1"),
    Seed("src/logged{id}.js", "ok = authenticate(user)\nconsole.log('x')\neval(x)"),
    Seed("src/far{id}.py", "\n".join(["login(user)"] + ["x = 1"] * 10 + ["logger.info('x')"] + ["y = 2"] * 9 + ["authenticate(z)"])),
    Seed("src/shell{id}.py", "os.system(cmd)\nsubprocess.run(args, shell=True)\neval(expr)"),
    Seed("src/testshell{id}.py", "os.system(cmd)"),
    Seed("web/run{id}.php", "system($_GET['c']);\nexec($_POST['c']);\nunserialize($_COOKIE['x']);\necho $_GET['n'];\nprint $_REQUEST['n'];"),
    Seed("src/proc{id}.rb", "`ls $dir`\nsystem(cmd)\nconstantize(name)\nx.html_safe\nMarshal.load(data)"),
    Seed("src/child{id}.js", "child_process.exec(cmd)\nnew Function(body)\nvm.runInContext(code)\nmathjs.eval(expr)"),
    Seed("web/page{id}.js", "box.innerHTML = payload\nbox.innerHTML = 'const'\nel.innerHTML = document.createElement('p')\ndocument.write(x)"),
    Seed("web/spec{id}.js", "box.innerHTML = payload"),
    Seed("web/clean{id}.js", "box.innerHTML = payload\nx = sanitize(y)"),
    Seed("web/view{id}.html", "{{ name }}\n{{ body | safe }}\n<p th:utext=\"${x}\">\n[[${y}]]\n<!-- {{ hidden }} -->"),
    Seed("web/half{id}.html", "{{ name }} {{ other }}|safe\n{{ a }}|escape {{ b }}"),
    Seed("web/react{id}.js", "dangerouslySetInnerHTML = {{ __html: x }}\nres.cookie('a', b)\ndocument.cookie = token"),
    Seed("src/render{id}.py", "Markup(request.args)\nprint(value)\nrender(escape=False)"),
    Seed("src/debug{id}.py", "DEBUG = True\napp.config['DEBUG'] = True\nALLOWED_HOSTS = ['*']"),
    Seed("test/debug{id}.py", "DEBUG = True\nenvironment = 'dev'"),
    Seed("src/env{id}.js", "process.env.NODE_ENV != 'production'\ndebug: true"),
    Seed("src/cookie{id}.py", "resp.set_cookie('sid', token)\nresponse.set_cookie('name', name)\nresponse.set_cookie('k', request.args)"),
    Seed("src/safe{id}.py", "resp.set_cookie('sid', 'x') ; secure=True ; httponly=True\nset_cookie(a) set_cookie(b) secure = True"),
    Seed("src/jwt{id}.py", "JWT_SECRET = \"qwertyuiopas\"\njwt.encode(payload, secret, 'abcdefghijkl')\nclient_secret = \"qwertyuiopas\""),
    Seed("conf/oauth{id}.json", "{\"oauth_secret\": \"qwertyuiopas\",\n \"ENCRYPTION_KEY\": \"qwertyuiopasdfgh\", \"api_key\": \"k\"}\nsession_secret = 'qwertyuiopas'"),
    Seed("src/url{id}.ts", "url = base + '?api_key=' + k\napi_key=abc&x\ncookie_secret = 'qwertyuiopas'"),
    Seed("src/session{id}.py", "session.timeout = 0\nsession.cookie.secure = False\njwt.encode({'a': 1}, k)\n@app.post('/x')"),
    Seed("src/exp{id}.py", "jwt.encode({'a': 1}, k)\nexp = 5\n@app.post('/x') csrf\ncsrf_protect = False"),
    Seed("conf/cors{id}.yaml", "Access-Control-Allow-Origin: *\ncors_origin = '*'\ncookie.secure = False\ndebug = true"),
    Seed("src/input{id}.py", "name = request.args['name']\nf = open(base + '../x')\ny = request.path"),
    Seed("src/valid{id}.py", "name = request.args['name']\nname = validate(name)\nf = File.ReadAllText(p + '../../x', argv)"),
    Seed("web/in{id}.php", "$n = $_GET['x'];\nfile_get_contents($_GET['u']);\nopen($p . '../x');"),
    Seed("src/log{id}.py", "logger.info('u ' + name)\nlog.info(password)\nlog.info('a' + b) user"),
    Seed("src/log{id}.js", "console.log(password)\nconsole.log('a' + b) request\nsocial security"),
    Seed("conf/store{id}.yml", "storage_encryption = False\nencrypt_at_rest = False\nCI_SECRET: \"qwertyuiopas\""),
    Seed("src/err{id}.py", "raise ValueException(email)\nerror(password)\nregistry = \"http://pkg.local\""),
    # vulnerabilities with neighbourhood guards
    Seed("src/xml{id}.py", "tree = xml.etree.ElementTree.parse(f)\nlxml.etree.parse(f)"),
    Seed("src/Xml{id}.java", "DocumentBuilderFactory.newInstance();\nf.setFeature(x);\nin.readObject();"),
    Seed("src/fetch{id}.py", "r = requests.get(url)\nurllib.urlopen(u)"),
    Seed("src/guarded{id}.py", "r = requests.get(url)\nallowlist(url)"),
    Seed("src/load{id}.py", "obj = pickle.loads(blob)\nyaml.load(text)\nd = random.randint(1, 2)"),
    Seed("src/path{id}.py", "f = open(root + '../x')\ng = 1"),
    Seed("src/path{id}.js", "readFile(p + '../x')\nbasename(p)\nn = Math.random()"),
    Seed("src/race{id}.py", "if p.exists():\n    a = 1\n    f = open(p)\n    b = 2"),
    Seed("src/near{id}.js", "fs.exists(p)\nopen(p)\nx\ny\nz\nwriteFile(p)"),
    Seed("src/iv{id}.java", 'iv = "0000"\nPBKDF2 iterations = 100\nbcrypt rounds = 4\nnew Random()'),
    Seed("web/store{id}.tsx", "localStorage.setItem('t', token)\nsessionStorage.github_token = my_token\n// localStorage.setItem('t', token)"),
    Seed("web/store{id}.vue", "sessionStorage.setItem('github_access_token', t)\nlocalStorage.setItem('api_key', k)"),
    # pipelines, containers, databases, configuration files
    Seed(".github/workflows/ci{id}.yml", "password: \"Zq81rT0pLm\"\nAWS_KEY = 'AAAAAAAAAAAA'\nrun: docker pull app:latest"),
    Seed("ops/jenkins{id}.yaml", "pipeline_secret = 'qwertyuiopas'\ncosign verify\ntrivy fs\nsecurity scan"),
    Seed("deploy/docker-compose.yml", "user: root\nvolumes:\n  - /var/run/docker.sock:/var/run/docker.sock\nallow_origins = ['http://localhost:3000']"),
    Seed("deploy/k8s{id}.yaml", "securityContext:\n  runAsUser: 0\n  allowPrivilegeEscalation: true"),
    Seed("src/routes{id}.py", "@login_required\ndef f(): pass"),
    Seed("src/audited{id}.py", "@require_auth\nself.logger(x)"),
    Seed("db/conn{id}.java", 'url = "jdbc:mysql://h/db";\npassword = "";'),
    Seed("db/lite{id}.sql", "sqlite:///x.db\npassword = 'abc'"),
    Seed("src/settings.py", "allow_origins = ['http://localhost']\nCORS(app, allow_origins=['*'])\nDB = 'sqlite:///x'"),
    Seed("src/database{id}.py", "import os\nallow_origins=['http://localhost']\nDATABASE_URL = 'sqlite://x' # sqlcipher"),
    # workspace classification and practice evidence
    Seed("README.md", "A security scanner for clusters"),
    Seed("readme.md", "Intentionally broken tutorial"),
    Seed("package.json", '{"dependencies": {"auth0": "1", "express": "4"}, "devDependencies": {"bcryptjs": "2"}, "note": ', "json"),
    Seed("package-lock.json", '{"name": "x", "note": ', "json"),
    Seed("requirements.txt", "flask\ncryptography"),
    Seed("go.mod", "module x"),
    Seed("main.py", "import os"),
    Seed("api/consent{id}.py", "@app.post('/api/consent')\nx = 1"),
    Seed("api/export{id}.ts", "router.get('/me/export')\nexpress.delete('/user/erase')"),
    Seed("db/schema{id}.sql", "CREATE TABLE user_consent (id int)\nconsent boolean"),
    Seed("db/migration{id}.py", "op.add_column('consent', Column())\nmodel"),
    Seed("conf/audit{id}.yaml", "audit_log_enabled: true\nlogging.enabled = yes\nlog_retention: 30\nretention_days: 90"),
    Seed("conf/tls{id}.conf", "tls_enabled = true\nSSL_MODE = true\nencryption_at_rest: enabled\nmfa_required: true\nmfa_enabled = yes"),
    Seed("conf/backup{id}.env", "backup_enabled = true\nbackup_frequency: 7\ndata_retention: 10\nretention policy"),
    Seed("infra/aws{id}.tf", "enable_logging = true # cloudtrail\nsse_algorithm = \"AES256\"\nmfa_enabled = true"),
    Seed("api/sym{id}.py", "import consent_lib\nfrom consents import x\n@audit_trail\ndef f(user):\n    export_user_data(user)\n    delete_user(user)\nclass AuditMiddleware: pass\n", "hash"),
    Seed("api/sym2{id}.py", "def g(request):\n    logger.info('user access')\n    erase_personal_data(1)\n    check_consent(2)\n", "hash"),
]
N_SEEDS = len(SEEDS)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files table: one file per document and per page."""
    seeds = "array(" + ", ".join(
        f"named_struct('path', {lit(s.path)}, 'head', {lit(s.head)}, 'style', {lit(s.style)})" for s in SEEDS) + ")"
    docs = (
        tables(spark, sf_dir, "documents").select("doc_id", "source", "text")
        .withColumn("seed", F.expr(f"{seeds}[cast(doc_id % {N_SEEDS} AS int)]"))
        .selectExpr(
            "concat(source, '-', cast(doc_id div 200 AS string)) AS workspace",
            "replace(seed.path, '{id}', cast(doc_id AS string)) AS path",
            f"""CASE seed.style
                WHEN 'hash' THEN concat(seed.head, '# ', replace(text, '\\n', '\\n# '))
                WHEN 'json' THEN concat(seed.head, '"', regexp_replace(text, '[^A-Za-z0-9 ]', ' '), '"}}')
                ELSE CASE WHEN (doc_id div {N_SEEDS}) % 2 = 0 THEN concat(seed.head, '\\n', text)
                          ELSE concat(text, '\\n', seed.head) END END AS content""",
        )
    )
    pages = tables(spark, sf_dir, "pages").selectExpr(
        "concat('web-', cast(page_id div 25 AS string)) AS workspace",
        "concat('site/p', cast(page_id AS string), '.html') AS path",
        "html AS content",
    )
    return spread(path_attributes(docs.unionByName(pages)), "workspace", "path")
