"""Routes and what guards them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.paths import is_test_path
from sievelight.functions.text import lines_of
from sievelight.model import finding

# Route patterns in the order in which the first one names a route.
ROUTES = (
    ("flask", r"(?i)@(?:app|blueprint|bp|\w+)\.route\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("fastapi", r"(?i)@(?:router|app)\.(?:get|post|put|delete|patch|options|head)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("express", r"(?i)(?:app|router)\.(?:get|post|put|delete|patch|use)\s*\(\s*['\"`]([^'\"`]+)['\"`]"),
    ("nextjs", r"export\s+(?:default\s+function|async\s+function|const)\s+(?:handler|GET|POST|PUT|DELETE|PATCH)"),
    ("django", r"(?i)^\s*(?:re_)?path\s*\(\s*r?['\"]([^'\"]+)['\"]"),
    ("nestjs", r"@(?:Get|Post|Put|Delete|Patch|Options)\s*\(\s*['\"]?([^'\"\)]+)?['\"]?\s*\)"),
)
# Signs of a login, of a limiter, of sensitive and public routes, of open origins and of credentials.
AUTH = (
    r"(?i)@(?:login_required|auth_required|jwt_required|require_http_methods|permission_required|token_required|requires_auth|authenticated)"
    r"|Depends\s*\(\s*(?:get_current_user|get_user|verify_token|oauth2_scheme|authenticate)|requireAuth|isAuthenticated|verifyToken|checkAuth"
    r"|authenticate\s*\(|@UseGuards\s*\(\s*\w*Auth|middleware\s*\(\s*auth|passport\.authenticate|authMiddleware"
)
LIMITER = (
    r"(?i)@limiter\.|flask_limiter|slowapi|@Throttle|@UseGuards\s*\(\s*ThrottlerGuard|express-rate-limit|rateLimit\s*\(|rate_limit\s*\("
    r"|RateLimit|@ratelimit|throttle\s*\("
)
SENSITIVE = r"(?i)(?:auth|login|register|signup|password|reset|forgot|verify|upload|webhook|otp|token|mfa)"
PUBLIC = r"(?i)^/?(?:$|health/?|status/?|docs/?|redoc/?|openapi/?|metrics/?|favicon|robots\.txt|static/)"
OPEN_ORIGIN = r"(?i)CORS\s*\([^)]*origins?\s*=\s*['\"]?\*['\"]?|Access-Control-Allow-Origin['\"]?\s*[=:]\s*['\"]?\*"
CREDENTIALS = r"(?i)credentials\s*=\s*True|allow_credentials\s*=\s*true"
# The opt-in packs, by framework: the route pattern, signs of a login, signs of a limiter.
PACKS = (
    ("flask", r"@(?:app|blueprint|bp|\w+)\.route\s*\(\s*['\"]([^'\"]+)['\"]",
     ("@login_required", "@token_required", "@requires_auth", "@jwt_required", "@permission_required"), ("@limiter.", "flask_limiter", "slowapi")),
    ("fastapi", r"@(?:router|app)\.(?:get|post|put|delete|patch|options|head)\s*\(\s*['\"]([^'\"]+)['\"]",
     ("Depends(get_current_user", "Depends(verify_token", "Depends(authenticate", "oauth2_scheme"), ("slowapi", "RateLimit", "rate_limit")),
    ("express", r"(?:app|router)\.(?:get|post|put|delete|patch|use)\s*\(\s*['\"`]([^'\"`]+)['\"`]",
     ("requireAuth", "isAuthenticated", "verifyToken", "passport.authenticate", "authMiddleware", "authenticate("), ("express-rate-limit", "rateLimit(", "limiter(")),
    ("nestjs", r"@(?:Get|Post|Put|Delete|Patch|Options)\s*\(\s*['\"]?([^'\")\s]+)?['\"]?\s*\)",
     ("@UseGuards(AuthGuard", "@UseGuards(JwtAuthGuard", "@UseGuards(RolesGuard"), ("@Throttle(", "@UseGuards(ThrottlerGuard")),
    ("django", r"(?:path|re_path)\s*\(\s*['\"]([^'\"]+)['\"]",
     ("@login_required", "@permission_required", "IsAuthenticated", "TokenAuthentication"), ("throttle_classes", "django-ratelimit", "@ratelimit(")),
)
PACK_SENSITIVE = (
    "auth", "login", "logout", "register", "signup", "password", "reset", "forgot", "verify", "upload", "webhook", "otp", "token", "mfa", "admin",
    "pay", "checkout", "billing",
)
PACK_PUBLIC = ("/health", "/status", "/docs", "/redoc", "/openapi", "/metrics", "/favicon", "/robots.txt", "/static/", "/assets/")
LANGUAGES = ("python", "javascript", "typescript")
NAMES = ("urls.py", "routes.js", "routes.ts", "router.js", "router.ts")
#: Lines before a route that may guard it; as many follow, with the route's own.
WINDOW, ORIGIN_WINDOW = 50, 5


def _source(files: DataFrame) -> DataFrame:
    gate = F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False)) | F.col("name").isin(*NAMES)
    kept = files.where(gate & ~is_test_path(F.col("path")))
    return kept.select("path", lines_of(F.col("content")).alias("lines"))


def _around(width: int) -> Column:
    """The lines from ``width`` before the line to ``width - 1`` behind it, as one text."""
    start = F.greatest(F.col("pos") - width, F.lit(0))
    end = F.least(F.size("lines"), F.col("pos") + width)
    return F.array_join(F.slice("lines", start + 1, end - start), "\n")


def _matching(source: DataFrame, met) -> DataFrame:
    """``path, lines, pos, line`` of the lines that match; the file's lines are copied for those alone."""
    numbered = F.transform("lines", lambda line, pos: F.struct(pos.alias("pos"), line.alias("line")))
    hits = F.filter(numbered, lambda x: met(x["line"]))
    return source.select("path", "lines", F.explode(hits).alias("hit")).select("path", "lines", "hit.*")


def routes(files: DataFrame) -> DataFrame:
    """``path, line_no, line, ord, framework, route, context`` of every route pattern that a line matches.

    A pattern without a group, or whose group took no part, names the route
    ``/`` or an empty one.  Names without a slash are no routes.
    """
    any_route = lambda line: reduce(lambda a, b: a | b, [line.rlike(p) for _, p in ROUTES])
    rows = _matching(_source(files), any_route)
    named = F.array(*[
        F.when(F.col("line").rlike(p), F.struct(F.lit(k).alias("ord"), F.lit(name).alias("framework"), (F.regexp_extract("line", p, 1) if "([^" in p else F.lit("/")).alias("route")))
        for k, (name, p) in enumerate(ROUTES)
    ])
    rows = rows.withColumn("found", F.explode(F.filter(named, lambda x: x.isNotNull())))
    # a bare decorator has a group that took no part, and stands for the root
    route = F.when((F.col("found.framework") == "nestjs") & (F.col("found.route") == ""), F.lit("/")).otherwise(F.col("found.route"))
    rows = rows.select("path", (F.col("pos") + 1).alias("line_no"), "line", "found.ord", "found.framework", route.alias("route"), _around(WINDOW).alias("context"))
    return rows.where((F.col("route") == "") | F.col("route").contains("/"))


def _first(rows: DataFrame) -> DataFrame:
    """Of several frameworks on one line the first one names the route."""
    keys = ["path", "line_no", "route"]
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("r"))
    return best.select(*keys, "r.*")


def _route_finding(rows: DataFrame, key: str, title: str, severity: str, cwe: str, text: str, advice: str, confidence: float, place: int) -> DataFrame:
    columns = finding(
        "api_surface", F.lit(severity), F.lit(cwe), F.col("path"), F.col("line_no"), F.concat(F.lit(key), F.col("route")),
        F.concat(F.lit(title + " `"), F.col("route"), F.lit("`")), F.concat(F.lit("Route `"), F.col("route"), F.lit("` ("), F.col("framework"), F.lit(") " + text)),
        F.lit(advice), F.lit(confidence), F.rtrim(F.col("line")), F.col("line_no").cast("long") * 1000 + F.col("ord") * 2 + place,
    )
    return rows.select(*columns)


def missing_auth(found: DataFrame) -> DataFrame:
    rows = _first(found.where(~F.col("context").rlike(AUTH) & ~F.col("route").rlike(PUBLIC)))
    return _route_finding(rows, "missing_auth_", "Missing Authentication on Route", "HIGH", "CWE-306", "shows no login check nearby.", "Require a login on every route that is not public.", 0.70, 0)


def missing_rate_limit(found: DataFrame) -> DataFrame:
    named = F.when(F.col("route") == "", F.col("line")).otherwise(F.col("route"))
    rows = _first(found.where(named.rlike(SENSITIVE) & ~F.col("context").rlike(LIMITER)))
    return _route_finding(rows, "missing_ratelimit_", "Missing Rate Limiting on Sensitive Route", "MEDIUM", "CWE-770", "shows no limiter nearby.", "Limit how often the route may be called.", 0.80, 1)


def open_origins(files: DataFrame) -> DataFrame:
    rows = _matching(_source(files), lambda line: line.rlike(OPEN_ORIGIN))
    rows = rows.where(_around(ORIGIN_WINDOW).rlike(CREDENTIALS)).withColumn("line_no", F.col("pos") + 1)
    columns = finding(
        "api_surface", F.lit("MEDIUM"), F.lit("CWE-942"), F.col("path"), F.col("line_no"), F.lit("cors_wildcard_with_creds"),
        F.lit("Overly Permissive CORS — Wildcard with Credentials"), F.lit("All origins are allowed together with credentials."),
        F.lit("Name the origins that may send credentials."), F.lit(0.90), F.rtrim(F.col("line")), F.col("line_no").cast("long") * 1000 + (1 << 40),
    )
    return rows.select(*columns)


def api_findings(files: DataFrame) -> DataFrame:
    found = routes(files)
    return missing_auth(found).unionByName(missing_rate_limit(found)).unionByName(open_origins(files))


def pack_routes(files: DataFrame) -> DataFrame:
    """``path, line_no, line, ord, framework, route, context, guarded, limited, sensitive, public`` by the opt-in packs.

    A framework's routes are judged by its own signs alone, which are plain
    texts looked for around the route.
    """
    any_route = lambda line: reduce(lambda a, b: a | b, [line.rlike(p) for _, p, *_ in PACKS])
    holds = lambda text, signs: reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in signs])
    rows = _matching(_source(files), any_route).withColumn("context", _around(WINDOW)).drop("lines")
    named = F.array(*[
        F.when(F.col("line").rlike(p), F.struct(
            F.lit(k).alias("ord"), F.lit(name).alias("framework"), F.regexp_extract("line", p, 1).alias("route"),
            holds(F.col("context"), auth).alias("guarded"), holds(F.col("context"), limit).alias("limited"),
        ))
        for k, (name, p, auth, limit) in enumerate(PACKS)
    ])
    rows = rows.withColumn("found", F.explode(F.filter(named, lambda x: x.isNotNull())))
    rows = rows.select("path", (F.col("pos") + 1).alias("line_no"), "line", "context", "found.*")
    rows = rows.withColumn("route", F.when(F.col("route") == "", "/").otherwise(F.col("route")))
    public = reduce(lambda a, b: a | b, [F.col("route").startswith(p) for p in PACK_PUBLIC])
    return rows.withColumns({"sensitive": holds(F.lower("route"), PACK_SENSITIVE), "public": public})


def pack_findings(files: DataFrame) -> DataFrame:
    """Findings of the opt-in packs: routes that nothing guards, and sensitive ones that nothing limits."""
    found = pack_routes(files)
    open_ = _first(found.where(~F.col("guarded") & ~F.col("public")).select("path", "line_no", "line", "ord", "framework", "route"))
    free = _first(found.where(F.col("sensitive") & ~F.col("limited")).select("path", "line_no", "line", "ord", "framework", "route"))
    return _route_finding(
        open_, "pack_auth_", "No Login Check of the Framework on Route", "HIGH", "CWE-306", "shows no login check nearby.", "Require a login on every route that is not public.", 0.70, 0,
    ).unionByName(_route_finding(
        free, "pack_limit_", "No Limiter of the Framework on Sensitive Route", "MEDIUM", "CWE-770", "shows no limiter nearby.", "Limit how often the route may be called.", 0.80, 1,
    ))
