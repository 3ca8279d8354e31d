"""Small inline corpora, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.plans.scan import as_files

JS = {
    "src/a.js": """eval(input)
eval('1 + 1')
eval( 'x')
child_process.exec("ls " + dir)
child_process.exec("ls")
el.innerHTML = x
el.innerHTML == x
el.innerHTML += y
document.write(x)
obj.__proto__[key] = 1
a.constructor.prototype.b = 2
const apiKey = "abcdefghijklmnop1234"
const apiKey = "short"
Math.random()
db.query(`select ${id}`)
db.query(`select 1`)
rejectUnauthorized: false
""",
    "src/b.tsx": """<div dangerouslySetInnerHTML={{__html: x}} />
res.redirect(req.query.next)
serialize.unserialize(data)
jwt.sign({a: 1}, "secret")
const app = express()
let token = 1 + Math.random()
res.cookie("a", b)
JSON.parse(text)
app.post("/x", handler)
// eval(comment)
* eval(block)
eval(ok) // nosec
eval(ok) // tool: nosec

   <!-- document.write(x) -->""",
    "lib/c.mjs": "el.innerHTML=\nsecret: 'ABCDEFGHIJKLMNOPQRSTUV'\n",
    "notes.md": "eval(x)\n",
}
AUTH = {
    "app/views.py": """jwt.decode(t, verify=False)
algorithm = "none"
if token == "abcd1234":
if token == "abc":
role = request.args.get("role")
item = Item.objects.get(id=item_id)
item = Item.objects.get(id=request.user)
x = request.json["role"]
if password == "admin":
if password == "admin123":
app.run(host="0", debug=True)
# app.run(debug=True)
app.run(debug=True)  # noqa
app.run(debug=True)  # nosec
""",
    "web/api.js": "if (req.query.admin) {}\nUser.findById(req.params.id)\nreq.body.role\n",
    "app/tests/views.py": "app.run(debug=True)\n",
    "app/views_test.py": "app.run(debug=True)\n",
    "conf/app.yaml": 'password == "admin"\n',
}
_FILL = "\n".join(f"x{i} = {i}" for i in range(48))
ROUTES = {
    "web/app.py": """@app.route("/users")
def users(): pass
@app.get("/items")
def items(): pass
@app.route("/health")
@app.route("plain")
@router.post("/auth/login")
CORS(app, origins="*", supports_credentials=True)
x = 1
""",
    "web/guarded.py": f'@app.route("/near")\n{_FILL}\n@login_required\ny = 1\n@app.route("/after")\n',
    "web/far.py": f'@app.route("/far")\n{_FILL}\nz = 1\n@login_required\n',
    "web/limited.js": "const limit = rateLimit({})\nrouter.post('/token', issue)\napp.use('/static/x', serve)\n",
    "web/urls.py": "    path('accounts/reset', reset)\n    re_path(r'^x', v)\nPath('test.py')\n",
    "web/nest.ts": "@Get()\n@Post('login')\n@Post('users/login')\nexport async function GET\n",
    "web/open.py": "allow_credentials=True\na\nb\nc\nd\nresp['Access-Control-Allow-Origin'] = '*'\n",
    "web/open_far.py": "allow_credentials=True\na\nb\nc\nd\ne\nresp['Access-Control-Allow-Origin'] = '*'\n",
    "tests/app.py": '@app.route("/users")\n',
}
PYTHON = {
    "p/a.py": """import hashlib
eval(x)
eval("1")
exec(f"a{b}")
pickle.loads(d)
subprocess.run(f"ls {d}", shell=True)
subprocess.run("ls", shell=True)
cur.execute(f"select {x}")
cur.execute("a" + b)
cur.execute("a %s" % b)
get_db().execute(f"x")
token = str(random.randint(0, 9))
n = random.randint(0, 9)
hashlib.md5(b)
yaml.load(f)
yaml.load(f, Loader=yaml.SafeLoader)
yaml.load(f, Loader=yaml.FullLoader)
try:
    pass
except Exception:
    pass
assert user.is_admin
DB_PASSWORD = "hunter2hunter2"
password = "changeme"
self.api_key = "0123456789"
token: str = "0123456789"
""",
    "p/b.py": "def broken(:\n",
    "p/d.py": 'eval(user_input)\nhashlib.sha1(b)\nname = tempfile.mktemp()\nresponse.set_cookie("a", b)\n',
    "p/c.js": "eval(x)\n",
}
#: What the rules find in PYTHON, derived by hand: path, first and last line, title, severity.
PYTHON_FOUND = (
    ("p/a.py", 2, 2, "Dangerous use of `eval()` with dynamic argument", "HIGH"),
    ("p/a.py", 4, 4, "Dangerous use of `exec()` with dynamic argument", "HIGH"),
    ("p/a.py", 5, 5, "Insecure deserialization via `pickle`", "HIGH"),
    ("p/a.py", 6, 6, "Shell Injection — `subprocess` with `shell=True` and dynamic command", "CRITICAL"),
    ("p/a.py", 8, 8, "SQL Injection — f-string in `.execute()` call", "HIGH"),
    ("p/a.py", 9, 9, "SQL Injection — String concatenation in `.execute()` call", "HIGH"),
    ("p/a.py", 12, 12, "Weak Randomness Used for Security-Sensitive Token", "MEDIUM"),
    ("p/a.py", 14, 14, "Weak Hashing Algorithm — `hashlib.md5`", "MEDIUM"),
    ("p/a.py", 15, 15, "Insecure `yaml.load()` — Missing SafeLoader", "HIGH"),
    ("p/a.py", 17, 17, "Insecure `yaml.load()` — Missing SafeLoader", "HIGH"),
    ("p/a.py", 20, 21, "Broad Exception Silently Swallowed", "LOW"),
    ("p/a.py", 22, 22, "`assert` Used for Security/Auth Check", "MEDIUM"),
    ("p/a.py", 23, 23, "Hardcoded Credential in Variable `db_password`", "HIGH"),
    ("p/a.py", 25, 25, "Hardcoded Credential in Variable `api_key`", "HIGH"),
    ("p/d.py", 1, 1, "Dangerous use of `eval()` with dynamic argument", "HIGH"),
    ("p/d.py", 2, 2, "Weak Hashing Algorithm — `hashlib.sha1`", "MEDIUM"),
)
#: One text for each secret format; the next line is a near miss.
SECRET_LINES = {
    "SEC1a": ("AKIA" + "A1" * 8, "AKIA" + "a1" * 8), "SEC1b": ("aws_secret_key = '" + "a1B2" * 10 + "'", "aws_secret_key = 'short'"),
    "SEC1c": ("sk_live_" + "a" * 16, "sk_live_abc"), "SEC1d": ("sk_test_" + "a" * 16, "sk_test_x"), "SEC1e": ("ghp_" + "a" * 20, "ghp_short"),
    "SEC1f": ("xoxb-1234567890", "xoxc-1234567890"), "SEC1g": ("postgres://u:p@h/db", "postgres://h/db"),
    "SEC1h": ("-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----"), "SEC1i": ('token = "' + "a" * 16 + '"', 'token = "short"'),
    "SEC1j": ("Bearer " + "a" * 16, "Bearer x"), "SEC1k": ("eyJa.b.c", "eyJa.b"), "SEC1l-1": ("SG." + "a" * 16 + "." + "b" * 16, "SG.a.b"),
    "SEC1l-2": ("AC" + "0a" * 16, "AC12"), "SEC1l-3": ("key-" + "0a" * 16, "key-0a"), "SEC1l-4": ("AIza" + "a" * 35, "AIza1"),
    "SEC1l-5": ("npm_" + "a" * 36, "npm_a"), "SEC1l-6": ("dckr_pat_" + "a" * 20, "dckr_pat_a"), "SEC1l-7": ("AccountKey=" + "a" * 40, "AccountKey=a"),
    "SEC1l-8": ("shpat_" + "0a" * 16, "shpat_0a"), "SEC1l-9": ("dop_v1_" + "0a" * 32, "dop_v1_0a"), "SEC1l-10": ("pypi-" + "a" * 16, "pypi-a"),
    "SEC1l-11": ("heroku key 01234567-89ab-cdef-0123-456789abcdef", "heroku 01234567"),
}
SECRET_FILES = {f"keys/{k}.txt": "\n".join(v) + "\n" for k, v in SECRET_LINES.items()} | {
    "keys/random.txt": 'x = "aB3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xY"\ny = "' + "ab" * 20 + '"\nz = "short", "qW8eR2tY6uI0oP4aS9dF3gH7jK1lZ5xC"\n',
}
PAGES = {"pages/inline.js": "<script>\n  document.write(location.hash)\n  el.innerHTML = x\n  // eval(x)\n</script>\n"}
MANIFESTS = {
    "a/requirements.txt": "# c\nflask==2.0.1\n-r other.txt\nrequests>=2.25.0,<3\nplain\n  pyyaml ~= 5.3.1 ; x\nextra[a]==1.0\n",
    "b/package.json": '{\n  "dependencies": {\n    "express": "^4.17.1",\n    "lodash": "~4.17.0"\n  },\n  "devDependencies": {"jest": ">=26.0.0"}\n}\n',
    "c/go.mod": "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgolang.org/x/net v0.1.0 // indirect\n)\nrequire y v1.0.0\n",
    "d/Pipfile": '[[source]]\nurl = "x"\n[packages]\nflask = "==1.0"\nany = "*"\n[requires]\npython = "3.8"\n[dev-packages]\npytest = ">=5.1"\n',
    "e/pyproject.toml": '[project]\ndependencies = [\n  "httpx>=0.20,<1",\n  "rich==10.0.0",\n  "plain",\n]\n[tool]\nx = "y>=1"\n',
    "f/package.json": "{bad json",
}
DEPS_FOUND = {
    "deps_requirements": (("a/requirements.txt", "flask", "2.0.1", 2), ("a/requirements.txt", "requests", "2.25.0", 4), ("a/requirements.txt", "pyyaml", "5.3.1", 6)),
    "deps_package_json": (("b/package.json", "express", "4.17.1", 3), ("b/package.json", "lodash", "4.17.0", 4), ("b/package.json", "jest", "26.0.0", 6)),
    "deps_go_mod": (("c/go.mod", "github.com/a/b", "1.2.3", 3), ("c/go.mod", "golang.org/x/net", "0.1.0", 4)),
    "deps_pipfile": (("d/Pipfile", "flask", "1.0", 4), ("d/Pipfile", "any", "*", 5), ("d/Pipfile", "pytest", "5.1", 9)),
    "deps_pyproject": (("e/pyproject.toml", "httpx", "0.20,<1", 3), ("e/pyproject.toml", "rich", "10.0.0", 4)),
}
#: Advisories: ecosystem, package, version, order, id, aliases, summary, scores, fixes of the ranges.
ADVISORIES = (
    ("PyPI", "flask", "2.0.1", 0, "PYSEC-1", ["CVE-2023-1"], "cookie", ["7.5"], ["2.2.5", "2.3.2"]),
    ("PyPI", "flask", "2.0.1", 1, "GHSA-1", ["CVE-2023-1", "CVE-2023-2"], "again", ["9.8"], []),
    ("PyPI", "flask", "2.0.1", 2, "CVE-2023-3", [], "third", ["CVSS:3.1/AV:N"], []),
    ("PyPI", "pyyaml", "5.3.1", 0, "PYSEC-2", [], "no cve", [], ["5.4"]),
    ("npm", "lodash", "4.17.0", 0, "GHSA-2", ["CVE-2021-9", "CVE-2021-8", "CVE-2021-7"], "pollution", ["9.1"], ["4.17.21"]),
    ("PyPI", "any", "*", 0, "PYSEC-3", ["CVE-1-1"], "never", ["9.9"], []),
)
#: Advisories by range: ecosystem, package, id, listed versions, and the events of each range (introduced, fixed, last affected).
RANGED = (
    ("PyPI", "requests", "R-1", [], [[("2.0", None, None), (None, "2.25.0", None)], [("2.24.9", None, None), (None, "2.25.0.post1", None)]]),
    ("npm", "express", "R-2", [], [[("4.17.1", None, None), (None, "4.18.0", None)]]),
    ("npm", "jest", "R-3", [], [[("0", None, None), (None, "26.0.0", None)]]),
    ("PyPI", "rich", "R-4", [], [[("0", None, None), (None, None, "10.0.0")]]),
    ("Go", "github.com/a/b", "R-5", [], [[("1.2.4", None, None)]]),
    ("Go", "golang.org/x/net", "R-6", [], [[("v0.1.0-rc1", None, None)]]),
    ("PyPI", "pytest", "R-7", ["5.0", "5.1"], []),
    ("npm", "lodash", "R-8", [], [[("4.17.0-beta", None, None), (None, "4.17", None), ("4.17.1", None, None)]]),
    ("npm", "flask", "R-9", [], [[("0", None, None)]]),
)
#: What is reported, derived by hand: file, line, severity, title.
ADVISORIES_FOUND = (
    ("a/requirements.txt", 2, "HIGH", "Vulnerable Dependency — flask 2.0.1 (CVE-2023-1)"),
    ("a/requirements.txt", 2, "LOW", "Vulnerable Dependency — flask 2.0.1 (CVE-2023-3)"),
    ("a/requirements.txt", 6, "HIGH", "Vulnerable Dependency — pyyaml 5.3.1 (PYSEC-2)"),
    ("b/package.json", 4, "CRITICAL", "Vulnerable Dependency — lodash 4.17.0 (CVE-2021-9, CVE-2021-8)"),
    ("a/requirements.txt", 4, "HIGH", "Vulnerable Dependency — requests 2.25.0 (R-1)"),
    ("b/package.json", 3, "HIGH", "Vulnerable Dependency — express 4.17.1 (R-2)"),
    ("c/go.mod", 4, "HIGH", "Vulnerable Dependency — golang.org/x/net 0.1.0 (R-6)"),
    ("d/Pipfile", 9, "HIGH", "Vulnerable Dependency — pytest 5.1 (R-7)"),
    ("e/pyproject.toml", 4, "HIGH", "Vulnerable Dependency — rich 10.0.0 (R-4)"),
)
#: Paths with sizes, and whether they are kept under the globs ``*.log``, ``out/``, ``secret.txt``.
GLOBS = ("*.log", "out/", "secret.txt")
PATHS = (
    ("a/b.py", 10, True, "python"), ("node_modules/x.js", 10, False, "javascript"), ("a/pkg.egg-info/t.txt", 10, False, None),
    (".env", 10, False, None), (".github/ci.yml", 10, True, "yaml"), ("a/.hidden/x.txt", 10, False, None), ("a/x.log", 10, False, None),
    ("out/a.py", 10, False, "python"), ("b/out/a.py", 10, True, "python"), ("c/secret.txt", 10, False, None), ("big.bin", 1_024_001, False, None),
    ("edge.bin", 1_024_000, True, None), ("README.md", 10, True, None), ("A.PY", 10, True, "python"), (".bashrc", 10, False, None),
    ("build/x.c", 10, False, "c"), ("src/main.tf", 10, True, "hcl"),
)
RESPONSES = (
    ("r/a.py", '```json\n[{"severity": "high", "line_start": 3, "line_end": 4, "title": "T", "description": "D", "remediation_hint": "R", "cwe": "CWE-1", "confidence": 0.9}]\n```'),
    ("r/b.py", 'Sure: [{"severity": "odd", "title": "U"}] done'),
    ("r/c.py", "[]"),
    ("r/d.py", "no json"),
    ("r/e.py", '[{"line_start": "x", "title": "bad"}, {"line_start": 7, "cwe": ""}]'),
)
RESPONSES_FOUND = (
    ("r/a.py", 3, 4, "HIGH", "CWE-1", "T", 0.9),
    ("r/b.py", 1, 1, "MEDIUM", None, "U", 0.7),
    ("r/e.py", 7, 7, "MEDIUM", None, "Logic Bug Detected", 0.7),
)


def files(spark: SparkSession, *corpora: dict[str, str]) -> DataFrame:
    rows = [item for c in corpora for item in c.items()]
    return as_files(spark.createDataFrame(rows, "path string, content string"), F.col("path"), "content")


def advisories(spark: SparkSession) -> DataFrame:
    rows = [
        (*a[:6], a[6], [(s,) for s in a[7]], [([([(None, f, None)],) for f in a[8]], None)])
        for a in ADVISORIES
    ]
    rows += [(e, p, None, 0, i, [], "by range", [], [([(events,) for events in ranges], versions)]) for e, p, i, versions, ranges in RANGED]
    from sievelight.operators.dependencies import ADVISORY

    return spark.createDataFrame(rows, ADVISORY)


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    """``(VALUES ...) v(columns)`` for SQL."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") v({columns})"


def files_sql(*corpora: dict[str, str]) -> str:
    return "SELECT * FROM " + values([item for c in corpora for item in c.items()], "path, content")
