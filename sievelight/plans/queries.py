"""The registered queries over tables and inline corpora, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.paths import LANGUAGES, keep_files, language_of
from sievelight.functions.text import content_hash, entropy, explode_lines, is_high_entropy_base64, redact
from sievelight.model import FINDING_COLUMNS, SEVERITIES, severity_order
from sievelight.operators import api_surface, dependencies, line_rules, merge, model_review, python_ast
from sievelight.plans import corpora, report
from sievelight.plans.corpora import literal, values
from sievelight.plans.scan import as_files
from sievelight.sources import manifests, rules
from sievelight.sources.rules import Rule

COLUMNS = ["id", "file", "line_start", "title", "severity", "cwe", "confidence"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return as_files(table, F.concat(F.lit("documents/"), F.col("doc_id"), F.lit(".txt")), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as scripts, so that the script rules read them, and an inline page that they find faults in."""
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = as_files(table, F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".js")), "html")
    return rows.unionByName(corpora.files(spark, corpora.PAGES))


DOCUMENTS_SQL = "SELECT 'documents/' || doc_id || '.txt' AS path, text AS content FROM documents WHERE text IS NOT NULL"
PAGES_SQL = "SELECT 'pages/' || page_id || '.js' AS path, html AS content FROM pages WHERE html IS NOT NULL"
LINES = """
s AS (SELECT path, string_split(content, chr(10)) AS l0 FROM f),
l AS (SELECT path, CASE WHEN l0[-1] = '' THEN l0[1 : len(l0) - 1] ELSE l0 END AS l FROM s),
n AS (SELECT path, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM l)"""
#: What takes back a match that looks ahead.
_UNLESS = {"AB4": r"(?i)\.objects\.get\s*\(\s*(?:id|pk)\s*=\s*\w+\.(?:user|owner|created_by)"}
_AB4 = r"(?i)\.objects\.get\s*\(\s*(?:id|pk)\s*=|\.findById\s*\(\s*req\.|\.find_by_id\s*\(\s*params"
SCRIPT_SKIP = r"^\s*$|^\s*(?://|\*|/\*|<!--)|# nosec|// (?:\w+: )?nosec"
CODE_SKIP = r"^\s*$|^\s*(?:#|//|\*|<!--|--)|# (?:\w+: )?nosec|# noqa"


def rules_sql(pack: list[Rule], files: str, scanner: str, where: str = "TRUE") -> str:
    """Findings of a pack with all their columns."""
    rows = [(r.name, r.title, _AB4 if r.code == "AB4" else r.re2 or r.pattern, _UNLESS.get(r.code), r.severity, r.cwe, r.advice, r.confidence) for r in pack]
    table = values(rows, "name, title, pattern, unless, severity, cwe, advice, confidence")
    return f"""WITH f AS ({files}),{LINES},
r AS (SELECT * FROM {table})
SELECT substr(sha256(path || ':' || line_no || ':' || name || ':{scanner}'), 1, 12) AS id, '{scanner}' AS scanner, severity, cwe, path AS file,
       CAST(line_no AS INT) AS line_start, CAST(line_no AS INT) AS line_end, title, name || ' at line ' || line_no || '.' AS description,
       advice AS remediation_hint, CAST(confidence AS DOUBLE) AS confidence, rtrim(line, ' ') AS code_snippet
FROM n JOIN r ON regexp_matches(line, pattern) AND NOT coalesce(regexp_matches(line, unless), FALSE) WHERE {where}"""


def shown(sql: str) -> str:
    """Of the findings of a statement the columns that queries return."""
    return f"SELECT {', '.join(COLUMNS)} FROM ({sql})"


_NOT_TEST = r"NOT regexp_matches(path, '(?i)(?:^|[\\/])(?:tests?|spec|__tests__)[\\/]|(?:_test|\.test|\.spec|_spec)\.[a-z]+$')"
_SCRIPT = f"regexp_matches(path, '\\.(?:js|jsx|ts|tsx|mjs|cjs)$') AND NOT regexp_matches(line, {literal(SCRIPT_SKIP)})"
_SECRETS_SQL = rules_sql(rules.SECRETS, DOCUMENTS_SQL, "secrets")
_JS_FILES = corpora.files_sql(corpora.JS)
_JS_SQL = rules_sql(rules.JS, _JS_FILES, "sast_js_ts", _SCRIPT)


@query(shown(_SECRETS_SQL))
def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known secret formats in all documents."""
    return line_rules.known_secrets(documents(spark, sf_dir)).select(*COLUMNS)


_LITERALS = f"""WITH f AS ({DOCUMENTS_SQL} UNION ALL {corpora.files_sql(corpora.JS)}),{LINES},
q AS (SELECT DISTINCT path, line_no, unnest(regexp_extract_all(line, '[''"]([A-Za-z0-9+/=_\\-]{{8,}})[''"]', 1)) AS literal FROM n),
c AS (SELECT path, line_no, literal, unnest(string_split(literal, '')) AS c FROM q),
p AS (SELECT path, line_no, literal, c, count(*) / length(literal) AS p FROM c GROUP BY path, line_no, literal, c)
SELECT path AS file, CAST(line_no AS INT) AS line_start, literal, round(sum(-p * log2(p)), 6) AS entropy,
       length(literal) >= 16 AND sum(-p * log2(p)) > 4.0 AS random_base64
FROM p GROUP BY path, line_no, literal"""


@query(_LITERALS)
def secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of every quoted literal of eight characters and more."""
    files = documents(spark, sf_dir).unionByName(corpora.files(spark, corpora.JS))
    lines = explode_lines(files.where(F.col("content").rlike("['\"]")))
    quoted = F.regexp_extract_all("line", F.lit(r"['\"]([A-Za-z0-9+/=_\-]{8,})['\"]"), F.lit(1))
    rows = lines.where(F.col("line").rlike("['\"]")).select(F.col("path").alias("file"), F.col("line_no").alias("line_start"), F.explode(quoted).alias("literal")).distinct()
    return rows.withColumns({"entropy": F.round(entropy(F.col("literal")), 6), "random_base64": is_high_entropy_base64(F.col("literal"))})


@query(f"""WITH f AS ({DOCUMENTS_SQL}),{LINES}
SELECT path AS file, CAST(line_no AS INT) AS line_start,
       regexp_replace(line, '([''"])([A-Za-z0-9+/=_\\-]{{4}})[A-Za-z0-9+/=_\\-]{{12,}}([A-Za-z0-9+/=_\\-]{{4}})([''"])', '\\1\\2***\\3\\4', 'g') AS redacted
FROM n WHERE regexp_matches(line, '[''"][A-Za-z0-9+/=_\\-]{{20,}}[''"]')""")
def redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that quote a long token, with the token redacted."""
    token = r"['\"][A-Za-z0-9+/=_\-]{20,}['\"]"
    files = documents(spark, sf_dir)
    lines = explode_lines(files.where(F.col("content").rlike(token))).where(F.col("line").rlike(token))
    return lines.select(F.col("path").alias("file"), F.col("line_no").alias("line_start"), redact(F.col("line")).alias("redacted"))


@query(shown(_JS_SQL))
def js_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All script rules on the inline scripts."""
    return line_rules.js_findings(corpora.files(spark, corpora.JS)).select(*COLUMNS)


_PAGES = rules_sql(rules.JS, f"{PAGES_SQL} UNION ALL {corpora.files_sql(corpora.PAGES)}", "sast_js_ts", _SCRIPT)


@query(shown(_PAGES))
def js_rules_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All script rules on all web pages and an inline one."""
    return line_rules.js_findings(pages(spark, sf_dir)).select(*COLUMNS)


@query(shown(rules_sql(rules.AUTH, corpora.files_sql(corpora.AUTH), "auth_bypass", f"{_NOT_TEST} AND NOT regexp_matches(path, '\\.(?:yaml|yml|json|toml)$') AND NOT regexp_matches(line, {literal(CODE_SKIP)})")))
def auth_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All access rules on the inline files."""
    return line_rules.auth_findings(corpora.files(spark, corpora.AUTH)).select(*COLUMNS)


@query(shown(rules_sql([r for r in rules.EXTENDED if "(?!" not in r.pattern], corpora.files_sql(corpora.AUTH, corpora.PYTHON), "extended", f"NOT regexp_matches(line, {literal(CODE_SKIP)})")))
def extended_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opt-in pack, but for the rules that look ahead, on the inline files."""
    pack = [r for r in rules.EXTENDED if "(?!" not in r.pattern]
    return line_rules.extended_findings(corpora.files(spark, corpora.AUTH, corpora.PYTHON), pack).select(*COLUMNS)


@query(shown(rules_sql(rules.EXTENDED, corpora.files_sql(corpora.AUTH, corpora.PYTHON), "extended", f"NOT regexp_matches(line, {literal(CODE_SKIP)})")))
def extended_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole opt-in pack on the inline files."""
    return line_rules.extended_findings(corpora.files(spark, corpora.AUTH, corpora.PYTHON)).select(*COLUMNS)


_ROUTES = f"""WITH f AS ({corpora.files_sql(corpora.ROUTES)}),{LINES},
p AS (SELECT * FROM {values([(k, n, p, "([^" in p) for k, (n, p) in enumerate(api_surface.ROUTES)], "ord, framework, pattern, has")}),
m AS (SELECT n.path, line_no, line, ord, framework, l.l,
             CASE WHEN NOT has THEN '/' WHEN framework = 'nestjs' AND regexp_extract(line, pattern, 1) = '' THEN '/' ELSE regexp_extract(line, pattern, 1) END AS route
      FROM n JOIN l USING (path) JOIN p ON regexp_matches(line, pattern) WHERE {_NOT_TEST.replace("path", "n.path")}),
g AS (SELECT path, line_no, line, ord, framework, route,
             array_to_string(l[greatest(line_no - 51, 0) + 1 : least(len(l), line_no + 49)], chr(10)) AS context
      FROM m WHERE route = '' OR contains(route, '/'))"""


def _route_sql(key: str, title: str, severity: str, where: str) -> str:
    return f"""{_ROUTES},
b AS (SELECT *, row_number() OVER (PARTITION BY path, line_no, route ORDER BY ord) AS k FROM g WHERE {where})
SELECT substr(sha256(path || ':' || line_no || ':{key}' || route || ':api_surface'), 1, 12) AS id, path AS file, CAST(line_no AS INT) AS line_start,
       '{title} `' || route || '`' AS title, '{severity}' AS severity, framework FROM b WHERE k = 1"""


def _route_rows(found: DataFrame) -> DataFrame:
    return found.select("id", "file", "line_start", "title", "severity", F.regexp_extract("description", r"\(([a-z]+)\) shows", 1).alias("framework"))


@query(f"{_ROUTES} SELECT path, CAST(line_no AS INT) AS line_no, framework, route, length(context) AS context_chars FROM g")
def api_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and the size of what stands around them."""
    found = api_surface.routes(corpora.files(spark, corpora.ROUTES))
    return found.select("path", F.col("line_no").cast("int"), "framework", "route", F.length("context").cast("long").alias("context_chars"))


@query(_route_sql("missing_auth_", "Missing Authentication on Route", "HIGH", f"NOT regexp_matches(context, {literal(api_surface.AUTH)}) AND NOT regexp_matches(route, {literal(api_surface.PUBLIC)})"))
def api_missing_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route_rows(api_surface.missing_auth(api_surface.routes(corpora.files(spark, corpora.ROUTES))))


@query(_route_sql("missing_ratelimit_", "Missing Rate Limiting on Sensitive Route", "MEDIUM", f"regexp_matches(CASE WHEN route = '' THEN line ELSE route END, {literal(api_surface.SENSITIVE)}) AND NOT regexp_matches(context, {literal(api_surface.LIMITER)})"))
def api_missing_ratelimit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route_rows(api_surface.missing_rate_limit(api_surface.routes(corpora.files(spark, corpora.ROUTES))))


@query(f"""WITH f AS ({corpora.files_sql(corpora.ROUTES)}),{LINES}
SELECT path AS file, CAST(line_no AS INT) AS line_start, 'CWE-942' AS cwe FROM n JOIN l USING (path)
WHERE {_NOT_TEST.replace("path", "n.path")} AND regexp_matches(line, {literal(api_surface.OPEN_ORIGIN)})
  AND regexp_matches(array_to_string(l[greatest(line_no - 6, 0) + 1 : least(len(l), line_no + 4)], chr(10)), {literal(api_surface.CREDENTIALS)})""")
def api_cors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api_surface.open_origins(corpora.files(spark, corpora.ROUTES)).select("file", "line_start", "cwe")


@query(f"SELECT file, CAST(line_start AS INT) AS line_start, CAST(line_end AS INT) AS line_end, title, severity FROM {values(corpora.PYTHON_FOUND, 'file, line_start, line_end, title, severity')}")
def py_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax-tree rules on the inline Python files; the SQL states what was derived by hand."""
    return python_ast.python_findings(corpora.files(spark, corpora.PYTHON)).select("file", "line_start", "line_end", "title", "severity")


def _deps_query(name: str, parser) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = parser(corpora.files(spark, corpora.MANIFESTS).where(F.col("name") == target))
        return found.select("path", "package", "version", "line_no")

    target = next(n for n, p in manifests.PARSERS.items() if p is parser)
    run.__name__ = name
    run.__doc__ = f"Dependencies of the inline {target}."
    query(f"SELECT path, package, version, CAST(line_no AS INT) AS line_no FROM {values(corpora.DEPS_FOUND[name], 'path, package, version, line_no')}")(run)


for _name, _parser in zip(corpora.DEPS_FOUND, (manifests.requirements, manifests.package_json, manifests.go_mod, manifests.pipfile, manifests.pyproject)):
    _deps_query(_name, _parser)


@query(f"SELECT file, CAST(line_start AS INT) AS line_start, severity, title FROM {values(corpora.ADVISORIES_FOUND, 'file, line_start, severity, title')}")
def deps_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dependencies.dependency_findings(corpora.files(spark, corpora.MANIFESTS), corpora.advisories(spark))
    return found.select("file", "line_start", "severity", "title")


_PATH_ROWS = values([p[:2] for p in corpora.PATHS], "path, size")


@query(f"SELECT path, keep FROM {values([(p[0], p[2]) for p in corpora.PATHS], 'path, keep')}")
def walk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([p[:2] for p in corpora.PATHS], "path string, size long")
    return rows.select("path", keep_files(F.col("path"), F.col("size"), list(corpora.GLOBS)).alias("keep"))


@query(f"SELECT path, l.language FROM {_PATH_ROWS} LEFT JOIN (SELECT * FROM {values(LANGUAGES.items(), 'suffix, language')}) l ON lower(regexp_extract(string_split(path, '/')[-1], '.(\\.[^./]+)$', 1)) = l.suffix")
def language_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([p[:1] for p in corpora.PATHS], "path string")
    return rows.select("path", language_of(F.col("path")).alias("language"))


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, twice, and script findings of all pages and inline scripts."""
    secrets = line_rules.known_secrets(documents(spark, sf_dir))
    scripts = line_rules.js_findings(pages(spark, sf_dir).unionByName(corpora.files(spark, corpora.JS)))
    return merge.union([secrets, secrets, scripts])


_ALL_SQL = f"""x AS (SELECT * FROM ({_SECRETS_SQL}) UNION ALL SELECT * FROM ({_SECRETS_SQL})
      UNION ALL SELECT * FROM ({_JS_SQL}) UNION ALL SELECT * FROM ({_PAGES})),
d AS (SELECT DISTINCT * FROM x),
o AS (SELECT *, list_position({list(SEVERITIES)}, severity) - 1 AS sev FROM d)"""


@query(f"WITH {_ALL_SQL} SELECT {', '.join(COLUMNS)} FROM d")
def findings_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.distinct_first(_all(spark, sf_dir)).select(*COLUMNS)


@query(f"WITH {_ALL_SQL} SELECT {', '.join(COLUMNS)} FROM o WHERE sev <= 1")
def min_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge([_all(spark, sf_dir)], "HIGH").select(*COLUMNS)


@query(f"WITH {_ALL_SQL} SELECT id, file, line_start, severity FROM o ORDER BY sev, file, line_start")
def findings_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.ordered(merge.merge([_all(spark, sf_dir)])).select("id", "file", "line_start", "severity")


@query(f"WITH {_ALL_SQL} SELECT count(*) AS total, {', '.join(f'count(*) FILTER (severity = {literal(s)}) AS {s.lower()}' for s in SEVERITIES)} FROM d")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(merge.merge([_all(spark, sf_dir)]))


@query(f"WITH {_ALL_SQL} SELECT file, count(*) AS findings, CAST(min(sev) AS INT) AS worst FROM o GROUP BY file")
def by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_file(merge.merge([_all(spark, sf_dir)]))


@query(f"WITH {_ALL_SQL} SELECT scanner, severity, cwe, count(*) AS findings FROM d GROUP BY CUBE (scanner, severity, cwe)")
def findings_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cube(merge.merge([_all(spark, sf_dir)]))


_CHECK_ROWS = [(k, item, s[0] if s else "", "|".join(c)) for k, (item, s, c) in enumerate(report.CHECKS)]


@query(f"""WITH {_ALL_SQL}, k AS (SELECT * FROM {values(_CHECK_ROWS, "ord, item, s, c")})
SELECT CAST(ord AS INT) AS ord, item FROM k
WHERE s = '' OR EXISTS (SELECT 1 FROM d WHERE d.scanner = k.s OR list_contains(string_split(k.c, '|'), d.cwe))""")
def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.checklist(merge.merge([_all(spark, sf_dir)]))


@query(f"WITH {_ALL_SQL} SELECT CAST(coalesce(max(CASE WHEN sev <= 1 THEN 2 ELSE 0 END), 0) AS INT) AS exit_code FROM o")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.gate(merge.merge([_all(spark, sf_dir)]))


@query(f"SELECT file, CAST(line_start AS INT) AS line_start, CAST(line_end AS INT) AS line_end, severity, CAST(cwe AS VARCHAR) AS cwe, title, CAST(confidence AS DOUBLE) AS confidence FROM {values(corpora.RESPONSES_FOUND, 'file, line_start, line_end, severity, cwe, title, confidence')}")
def llm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(corpora.RESPONSES, "path string, response string")
    return model_review.parse_responses(rows).select("file", "line_start", "line_end", "severity", "cwe", "title", "confidence")


_REDACTED = r"""regexp_replace(code_snippet, '([''"])([A-Za-z0-9+/=_\-]{4})[A-Za-z0-9+/=_\-]{12,}([A-Za-z0-9+/=_\-]{4})([''"])', '\1\2***\3\4', 'g')"""
_BLOCK = f"""'### [' || severity || '] ' || title || chr(10) || '**File:** `' || file || '`, lines ' || line_start || '–' || line_end || '  ' || chr(10)
  || '**CWE:** ' || cwe || '  ' || chr(10) || '**Scanner:** ' || scanner || '  ' || chr(10)
  || '**Confidence:** ' || CAST(trunc(confidence * 100) AS INT) || '%' || chr(10) || chr(10) || '**Issue:** ' || description || chr(10) || chr(10)
  || '**Fix instructions:** ' || remediation_hint || chr(10)
  || CASE WHEN code_snippet = '' THEN '' ELSE chr(10) || '```' || chr(10) || {_REDACTED} || chr(10) || '```' || chr(10) END"""


@query(f"WITH {_ALL_SQL}, k AS (SELECT id, file, {_BLOCK} AS b FROM d) SELECT id, file, sha256(b) AS block_sha256, length(b) AS block_chars FROM k")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown block of each finding, by its digest and length."""
    found = report.blocks(merge.merge([_all(spark, sf_dir)]))
    return found.select("id", "file", F.sha2("block", 256).alias("block_sha256"), F.length("block").cast("long").alias("block_chars"))


_OBJECT = ", ".join(f"'{c}', {c}" for c in FINDING_COLUMNS)


@query(f"WITH {_ALL_SQL} SELECT id, CAST(json_object({_OBJECT}) AS VARCHAR) AS json FROM d")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding as a JSON object."""
    return report.json_rows(merge.merge([_all(spark, sf_dir)]))


@query(f"WITH {_ALL_SQL} SELECT file, CAST(count(*) AS INT) AS n, string_agg(severity || ' ' || line_start || ' ' || title, '|' ORDER BY sev, line_start, title) AS listed FROM o GROUP BY file")
def findings_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of each file, the gravest first."""
    line = lambda f: F.concat(f["severity"], F.lit(" "), f["line_start"].cast("string"), F.lit(" "), f["title"])
    found = report.file_findings(merge.merge([_all(spark, sf_dir)]))
    # what ties in severity is listed by line and title here, as no order is promised there but that in which it was made
    rank = lambda f: F.struct(severity_order(f["severity"]), f["line_start"], f["title"], line(f))
    listed = F.transform(F.array_sort(F.transform("findings", rank)), lambda x: x["col4"])
    return found.select("file", "n", F.array_join(listed, "|").alias("listed"))


_RANDOM_SQL = f"""WITH f AS ({corpora.files_sql(corpora.SECRET_FILES)}),{LINES},
q AS (SELECT DISTINCT path, line_no, unnest(regexp_extract_all(line, '[''"]([A-Za-z0-9+/=_\\-]{{20,}})[''"]', 1)) AS literal FROM n),
c AS (SELECT path, line_no, literal, unnest(string_split(literal, '')) AS c FROM q),
p AS (SELECT path, line_no, literal, c, count(*) / length(literal) AS p FROM c GROUP BY path, line_no, literal, c),
e AS (SELECT path, line_no, literal FROM p GROUP BY path, line_no, literal HAVING sum(-p * log2(p)) > 4.5)
SELECT DISTINCT substr(sha256(path || ':' || line_no || ':High-Entropy String Literal:secrets'), 1, 12) AS id, path AS file, CAST(line_no AS INT) AS line_start,
       'High-Entropy String Literal' AS title, 'HIGH' AS severity, 'CWE-798' AS cwe, CAST(0.6 AS DOUBLE) AS confidence FROM e"""


@query(f"{shown(rules_sql(rules.SECRETS, corpora.files_sql(corpora.SECRET_FILES), 'secrets'))} UNION ALL SELECT * FROM ({_RANDOM_SQL})")
def secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret format, its near miss, and literals that look random."""
    return line_rules.secret_findings(corpora.files(spark, corpora.SECRET_FILES)).select(*COLUMNS)


@query(f"""WITH f AS ({corpora.files_sql(corpora.ROUTES)}),{LINES},
p AS (SELECT * FROM {values([(k, n, p, "|".join(a), "|".join(r)) for k, (n, p, a, r) in enumerate(api_surface.PACKS)], "ord, framework, pattern, auth, lim")}),
m AS (SELECT n.path, line_no, ord, framework, CASE WHEN regexp_extract(line, pattern, 1) = '' THEN '/' ELSE regexp_extract(line, pattern, 1) END AS route, auth, lim,
             array_to_string(l.l[greatest(line_no - 51, 0) + 1 : least(len(l.l), line_no + 49)], chr(10)) AS context
      FROM n JOIN l USING (path) JOIN p ON regexp_matches(line, pattern) WHERE {_NOT_TEST.replace("path", "n.path")})
SELECT path, CAST(line_no AS INT) AS line_no, framework, route,
       len([x FOR x IN string_split(auth, '|') IF contains(context, x)]) > 0 AS guarded,
       len([x FOR x IN string_split(lim, '|') IF contains(context, x)]) > 0 AS limited,
       len([x FOR x IN {list(api_surface.PACK_SENSITIVE)} IF contains(lower(route), x)]) > 0 AS sensitive,
       len([x FOR x IN {list(api_surface.PACK_PUBLIC)} IF starts_with(route, x)]) > 0 AS public FROM m""")
def route_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes as the opt-in packs of the frameworks judge them."""
    found = api_surface.pack_routes(corpora.files(spark, corpora.ROUTES))
    return found.select("path", F.col("line_no").cast("int").alias("line_no"), "framework", "route", "guarded", "limited", "sensitive", "public")


@query(f"SELECT path AS file, sha256(content) AS sha256 FROM ({DOCUMENTS_SQL})")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("path").alias("file"), content_hash(F.col("content")).alias("sha256"))


_BEFORE = rules_sql([r for r in rules.JS_BUILTIN], _JS_FILES, "sast_js_ts", _SCRIPT)


@query(f"SELECT id, title FROM ({_JS_SQL}) WHERE id NOT IN (SELECT id FROM ({_BEFORE}))")
def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that the second pack of script rules adds to the first."""
    files = corpora.files(spark, corpora.JS)
    return merge.new_findings(line_rules.js_findings(files, rules.JS_BUILTIN), line_rules.js_findings(files)).select("id", "title")


