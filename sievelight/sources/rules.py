"""Rule packs: regular expressions with what a match means.

A pattern is written for the JVM.  Where it looks ahead, ``re2`` says the same
for engines that cannot.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property
from re import _constants as op
from re import _parser as parser


def _literals(items) -> tuple[str, ...] | None:
    """Texts of which every match holds at least one; None if there is no such set."""
    found, run = [], ""

    def close() -> None:
        nonlocal run
        if run:
            found.append((run,))
        run = ""

    for kind, value in items:
        if kind is op.LITERAL and chr(value).isascii():
            run += chr(value)
            continue
        close()
        if kind is op.SUBPATTERN and not value[1]:
            inner = _literals(value[-1])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0]:
            inner = _literals(value[2])
        elif kind is op.BRANCH:
            parts = [_literals(p) for p in value[1]]
            inner = None if None in parts else tuple(dict.fromkeys(x for p in parts for x in p))
        else:
            inner = None
        if inner:
            found.append(inner)
    close()
    # the set whose shortest text is longest lets the least through
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


@dataclass(frozen=True)
class Rule:
    pack: str
    code: str
    name: str
    pattern: str
    severity: str
    cwe: str
    advice: str
    confidence: float
    re2: str | None = None

    @cached_property
    def needs(self) -> tuple[tuple[str, bool], ...] | None:
        """Texts of which a line must hold one to match; None if any line may match.

        Where the flag says so, the text is in lower case and any case counts.
        """
        parsed = parser.parse(self.pattern)
        found, any_case = _literals(parsed), bool(parsed.state.flags & re.IGNORECASE)
        return found and tuple((x.lower() if any_case else x, any_case) for x in found)

    @property
    def title(self) -> str:
        return f"[{self.code}] {self.name}" if self.pack in ("js", "js-extra") else self.name


def _rules(pack: str, rows: list[tuple], confidence: float | None = None) -> list[Rule]:
    out = []
    for code, name, pattern, severity, cwe, own, advice, *re2 in rows:
        out.append(Rule(pack, code, name, pattern, severity, f"CWE-{cwe}", advice, own if own is not None else confidence, *re2))
    return out


# Names, patterns, severities and confidences of the script rules.
JS_BUILTIN = _rules("js", [
    ("JS001", "eval() with Dynamic Argument", r"\beval\s*\(\s*(?!['\"`])", "HIGH", 78, .85, "Parse data with JSON.parse and keep input out of eval.", r"\beval\s*\((?:[^'\"`]|$)"),
    ("JS002", "child_process.exec with String Concatenation", r"child_process\.exec\s*\(\s*[^,)\n]*\+", "CRITICAL", 78, .90, "Call execFile with a list of arguments."),
    ("JS003", "innerHTML Assignment (XSS Risk)", r"\.innerHTML\s*[+]?=(?!=)", "HIGH", 79, .80, "Set textContent, or sanitise the markup first.", r"\.innerHTML\s*[+]?=(?:[^=]|$)"),
    ("JS004", "document.write() Usage (XSS Risk)", r"document\.write\s*\(", "MEDIUM", 79, .75, "Change the page through DOM methods."),
    ("JS005", "Prototype Pollution Pattern", r"__proto__\s*[\[.]|constructor\s*\.\s*prototype\s*[\[.]", "HIGH", 1321, .85, "Reject such keys at the border and use maps without a prototype."),
    ("JS006", "Hardcoded Secret in JS/TS Source", r"(?i)(?:apiKey|api_key|apiSecret|secret|password|token|authToken)\s*[:=]\s*['\"`][A-Za-z0-9+/=_\-]{16,}['\"`]", "HIGH", 798, .80, "Read it from the environment and rotate it."),
    ("JS007", "Math.random() Used for Security Token", r"Math\.random\s*\(\s*\)", "MEDIUM", 338, .65, "Draw from crypto.randomBytes."),
    ("JS008", "SQL Injection via Template Literal", r"\.query\s*\(\s*`[^`]*\$\{", "HIGH", 89, .90, "Bind parameters."),
    ("JS009", "SSL Certificate Verification Disabled", r"rejectUnauthorized\s*:\s*false", "HIGH", 295, .95, "Leave certificate checks on."),
    ("JS010", "Dangerous dangerouslySetInnerHTML (React XSS)", r"dangerouslySetInnerHTML\s*=\s*\{", "HIGH", 79, .85, "Pass only sanitised markup."),
    ("JS011", "open() Redirect via User-Controlled URL", r"(?i)(?:window\.location|res\.redirect|router\.push)\s*\(\s*req\.", "MEDIUM", 601, .75, "Redirect to listed targets only."),
    ("JS012", "Insecure Deserialization via node-serialize", r"serialize\.unserialize\s*\(", "CRITICAL", 502, .95, "Use plain JSON for untrusted input."),
    ("JS013", "JWT Signed with Weak Algorithm (none/HS256 with hardcoded secret)", r"(?i)jwt\.sign\s*\([^)]*,\s*['\"][^'\"]{1,20}['\"]", "MEDIUM", 347, .70, "Sign with a key pair or a secret from the environment."),
    ("JS014", "Missing helmet() Security Headers (Express)", r"(?i)const\s+app\s*=\s*express\s*\(\s*\)", "LOW", 693, .50, "Add the helmet middleware first."),
    ("JS015", "Insecure Random via Math for Security Use", r"(?i)(?:token|session|nonce|secret|csrf)\s*[=+]=?\s*.*Math\.random", "HIGH", 338, .85, "Draw from crypto.randomBytes."),
])
# The second pack of script rules; its names differ by case, so both packs report.
JS_EXTRA = _rules("js-extra", [
    ("JS001", "eval() with dynamic argument", r"\beval\s*\(\s*(?!['\"`])", "HIGH", 78, None, "Keep input out of eval.", r"\beval\s*\((?:[^'\"`]|$)"),
    ("JS002", "child_process.exec with string concatenation", r"child_process\.exec\s*\(\s*[^,)]*\+", "CRITICAL", 78, None, "Call execFile with a list."),
    ("JS003", "innerHTML assignment (XSS risk)", r"\.innerHTML\s*=", "HIGH", 79, None, "Set textContent or sanitise."),
    ("JS004", "document.write() (XSS risk)", r"document\.write\s*\(", "MEDIUM", 79, None, "Use DOM methods."),
    ("JS005", "Prototype pollution pattern", r"__proto__\s*\[|constructor\s*\.\s*prototype\s*\[", "HIGH", 1321, None, "Check keys before assignment."),
    ("JS006", "Hardcoded secret in JS/TS source", r"(?:apiKey|api_key|secret|password|token)\s*[:=]\s*['\"`][A-Za-z0-9+/=_\-]{16,}['\"`]", "HIGH", 798, None, "Read it from the environment."),
    ("JS007", "Math.random() for security token", r"Math\.random\s*\(\s*\)", "MEDIUM", 338, None, "Draw from crypto."),
    ("JS008", "SQL injection via template literal", r"\.query\s*\(\s*`[^`]*\$\{", "HIGH", 89, None, "Bind parameters."),
    ("JS009", "Insecure cookie without Secure/HttpOnly", r"res\.cookie\s*\([^)]*\)", "MEDIUM", 614, None, "Set secure and httpOnly."),
    ("JS010", "JSON.parse on untrusted input without try/catch", r"JSON\.parse\s*\(", "LOW", 20, None, "Catch what JSON.parse throws."),
    ("JS011", "Missing CSRF protection on state-changing route", r"app\.(?:post|put|delete|patch)\s*\([^)]*\)", "MEDIUM", 352, None, "Add a CSRF check to the route."),
    ("JS012", "Disabled SSL verification in Axios/fetch", r"rejectUnauthorized\s*:\s*false", "HIGH", 295, None, "Leave certificate checks on."),
], .75)
JS = JS_BUILTIN + JS_EXTRA

# The access rules.
AUTH = _rules("auth", [
    ("AB1", "JWT Signature Verification Bypass", r"(?i)algorithm\s*=\s*['\"]none['\"]|algorithms\s*=\s*\[['\"]none['\"]\]|options\s*=\s*\{[^}]*['\"]verify['\"]?\s*:\s*False|jwt\.decode\s*\([^)]*verify\s*=\s*False", "CRITICAL", 347, None, "Pin one strong algorithm and verify every token."),
    ("AB2", "Non-Constant-Time Comparison of Secret Value", r"(?i)(?:token|secret|password|hash|sig|hmac|api_key)\s*==\s*['\"][^'\"]{4,}['\"]", "HIGH", 208, None, "Compare with hmac.compare_digest."),
    ("AB3", "Client-Controlled Privilege via Request Parameter", r"(?i)request\.(?:args|params|GET|POST|query)\.get\s*\(\s*['\"](?:admin|role|is_admin|superuser|root)['\"]|req\.(?:query|params|body)\.(?:admin|role|is_admin|superuser)\b|request\.headers\.get\s*\(\s*['\"](?:X-Admin|X-Role|X-User-Role)['\"]", "CRITICAL", 639, None, "Take privileges from the session on the server."),
    ("AB4", "Direct Object Lookup Without Ownership Check (IDOR)", r"(?i)\.objects\.get\s*\(\s*(?:id|pk)\s*=(?!\s*\w+\.(?:user|owner|created_by))|\.findById\s*\(\s*req\.|\.find_by_id\s*\(\s*params", "HIGH", 639, None, "Filter the lookup by owner."),
    ("AB5", "Authorization Role Sourced from Untrusted Request Data", r"(?i)request\.(?:json|form|POST|data)\s*(?:\[|\.get\s*\(\s*)['\"](?:role|is_admin|admin|permission)['\"]|req\.body\.(?:role|is_admin|admin|permission)\b|request\.cookies\.get\s*\(\s*['\"](?:role|is_admin|admin)['\"]", "HIGH", 602, None, "Load roles from a signed session."),
    ("AB6", "Hardcoded Backdoor Credential in Comparison", r"(?i)(?:password|passwd)\s*==\s*['\"](?:admin|password|123456|test|root|letmein|qwerty)['\"]|(?:username|user)\s*==\s*['\"](?:admin|root|superuser)['\"]", "CRITICAL", 798, None, "Remove it and check hashed passwords."),
    ("AB7", "Debug Mode Enabled in Application", r"(?i)app\.run\s*\([^)]*debug\s*=\s*True|DEBUG\s*=\s*True\s*(?:#[^\n]*)?\n", "HIGH", 94, None, "Turn debug mode off in production."),
], .75)

#: Secrets by their public formats; this pack is a design of its own.
SECRETS = _rules("secrets", [
    ("SEC1a", "AWS Access Key ID", r"\bAKIA[0-9A-Z]{16}\b", "CRITICAL", 798, .95, "Revoke the key and use a role."),
    ("SEC1b", "AWS Secret Access Key", r"(?i)aws.{0,20}secret.{0,20}['\"][A-Za-z0-9/+=]{40}['\"]", "CRITICAL", 798, .90, "Revoke the key and use a role."),
    ("SEC1c", "Stripe Live Key", r"\bsk_live_[0-9A-Za-z]{16,}", "CRITICAL", 798, .95, "Roll the key."),
    ("SEC1d", "Stripe Test Key", r"\bsk_test_[0-9A-Za-z]{16,}", "MEDIUM", 798, .90, "Move it to the environment."),
    ("SEC1e", "GitHub Token", r"\b(?:ghp_|gho_|github_pat_)[0-9A-Za-z_]{20,}", "CRITICAL", 798, .95, "Revoke the token."),
    ("SEC1f", "Slack Token", r"\bxox[ab]-[0-9A-Za-z-]{10,}", "HIGH", 798, .90, "Revoke the token."),
    ("SEC1g", "Database URL with Credentials", r"\b[a-z][a-z0-9+]*://[^\s:/@]+:[^\s@/]+@", "CRITICAL", 798, .85, "Take the credentials out of the URL."),
    ("SEC1h", "PEM Private Key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "CRITICAL", 321, .95, "Replace the key pair."),
    ("SEC1i", "Generic API Key Assignment", r"(?i)(?:api_?key|api_?secret|auth_?token|access_?key|secret|password|token)\s*[:=]\s*['\"][A-Za-z0-9+/=_\-]{16,}['\"]", "HIGH", 798, .80, "Read it from the environment and rotate it."),
    ("SEC1j", "Bearer Token Literal", r"(?i)bearer\s+[A-Za-z0-9._~+/=-]{16,}", "HIGH", 798, .80, "Read the token at run time."),
    ("SEC1k", "JWT Literal", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "MEDIUM", 798, .80, "Take the token out of the source."),
    ("SEC1l-1", "SendGrid Key", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", "CRITICAL", 798, .95, "Revoke the key."),
    ("SEC1l-2", "Twilio Account Key", r"\b(?:AC|SK)[0-9a-f]{32}\b", "HIGH", 798, .80, "Revoke the key."),
    ("SEC1l-3", "Mailgun Key", r"\bkey-[0-9a-f]{32}\b", "HIGH", 798, .85, "Revoke the key."),
    ("SEC1l-4", "Google or Firebase API Key", r"\bAIza[0-9A-Za-z_-]{35}", "HIGH", 798, .90, "Restrict or replace the key."),
    ("SEC1l-5", "npm Token", r"\bnpm_[A-Za-z0-9]{36}", "CRITICAL", 798, .95, "Revoke the token."),
    ("SEC1l-6", "Docker Hub Token", r"\bdckr_pat_[A-Za-z0-9_-]{20,}", "CRITICAL", 798, .95, "Revoke the token."),
    ("SEC1l-7", "Azure Storage Key", r"AccountKey=[A-Za-z0-9+/=]{40,}", "CRITICAL", 798, .90, "Rotate the account key."),
    ("SEC1l-8", "Shopify Token", r"\bshp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}", "CRITICAL", 798, .95, "Revoke the token."),
    ("SEC1l-9", "DigitalOcean Token", r"\bdo[opr]_v1_[0-9a-f]{64}", "CRITICAL", 798, .95, "Revoke the token."),
    ("SEC1l-10", "PyPI Token", r"\bpypi-[A-Za-z0-9_-]{16,}", "CRITICAL", 798, .95, "Revoke the token."),
    ("SEC1l-11", "Heroku API Key", r"(?i)heroku.{0,20}[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "HIGH", 798, .85, "Rotate the key."),
])

def _lacks(word: str) -> str:
    """RE2 for a rest of line without ``word``, whose first letter stands in it once."""
    first = word[0]
    begun = [word[1:k] for k in range(1, len(word))]
    again = "|".join(b + first for b in begun)
    off = "|".join(f"{b}[^{first}{word[len(b) + 1]}]" for b in begun)
    return f"(?:[^{first}]|{first}(?:{again})*(?:{off}))*(?:{first}(?:{again})*(?:{'|'.join(begun)}))?$"


# Rules that exist as documentation only; off unless asked for.
EXTENDED = _rules("extended", [
    ("PY001", "Unsafe eval() with dynamic argument", r"eval\s*\([^)]+[a-zA-Z_]", "HIGH", 78, None, "Evaluate literals only."),
    ("PY002", "Unsafe exec() with dynamic argument", r"exec\s*\(\s*(?![\'\"]{1}[^\'\"]*[\'\"]{1}\s*\))", "HIGH", 78, None, "Do not build code from text.", r"exec\s*\((?:[^'\"]|$|['\"][^'\"]*(?:$|['\"]\s*(?:[^\s)]|$)))"),
    ("PY003", "pickle.loads on potentially untrusted data", r"pickle\.loads?\s*\(", "HIGH", 502, None, "Use a data format."),
    ("PY004", "subprocess with shell=True", r"subprocess\.\w+\s*\([^)]*shell\s*=\s*True", "CRITICAL", 78, None, "Pass a list of arguments."),
    ("PY005", "SQL injection via string formatting", r"\.execute\s*\(\s*['\"].*%[sd].*['\"]|\.execute\s*\(\s*f['\"]", "HIGH", 89, None, "Bind parameters."),
    ("PY006", "Use of random for security tokens", r"random\.(?:random|randint|choice|token_hex)\s*\(", "MEDIUM", 338, None, "Use the secrets module."),
    ("PY007", "MD5 hash usage", r"hashlib\.md5\s*\(", "MEDIUM", 327, None, "Use SHA-256."),
    ("PY008", "SHA1 hash usage", r"hashlib\.sha1\s*\(", "MEDIUM", 327, None, "Use SHA-256."),
    ("PY009", "yaml.load without SafeLoader", r"yaml\.load\s*\(\s*(?!.*SafeLoader)", "HIGH", 502, None, "Use safe_load.", r"yaml\.load\s*\(" + _lacks("SafeLoader")),
    ("PY010", "Broad exception silently swallowed", r"except\s*(?:Exception|:)\s*:\s*\n\s*pass", "LOW", 390, None, "Handle or log it."),
    ("PY011", "assert used for security check", r"assert\s+.*(?:auth|admin|permission|role|user|access|login)", "MEDIUM", 617, None, "Raise an error."),
    ("PY012", "Hardcoded credential in variable", r"(?:password|secret|api_key|token)\s*=\s*['\"][^'\"]{8,}['\"]", "HIGH", 798, None, "Read it from the environment."),
    ("PY013", "Flask debug mode enabled", r"app\.run\s*\([^)]*debug\s*=\s*True", "HIGH", 94, None, "Turn debug mode off."),
    ("PY014", "Insecure SSL/TLS verify=False", r"verify\s*=\s*False", "HIGH", 295, None, "Verify certificates."),
    ("PY015", "tempfile.mktemp usage (TOCTOU)", r"tempfile\.mktemp\s*\(", "MEDIUM", 377, None, "Use NamedTemporaryFile."),
    ("AY1", "JWT algorithm=none bypass", r"algorithm\s*=\s*['\"]none['\"]|algorithms\s*=\s*\[['\"]none['\"]\]", "CRITICAL", 347, None, "Pin an algorithm."),
    ("AY2", "JWT verify=False bypass", r"options\s*=\s*\{[^}]*['\"]verify['\"]?\s*:\s*False|verify\s*=\s*False", "CRITICAL", 347, None, "Verify signatures."),
    ("AY3", "Non-constant-time secret comparison", r"(?:token|secret|password|hash|sig|hmac)\s*==\s*\S|\S\s*==\s*(?:token|secret|password|hash)", "HIGH", 208, None, "Compare in constant time."),
    ("AY4", "Client-controlled admin flag in request params", r"request\.(?:args|params|GET)\.get\s*\(\s*['\"](?:admin|is_admin|role|superuser)['\"]", "CRITICAL", 639, None, "Keep privileges on the server."),
    ("AY5", "Authorization role from request body", r"request\.(?:json|form|POST|data)\s*(?:\[|\.get\s*\(\s*)['\"](?:role|is_admin|admin|permission)['\"]", "HIGH", 602, None, "Load roles from the session."),
    ("AY6", "IDOR — object lookup by client-supplied ID", r"\.objects\.get\s*\(\s*(?:id|pk)\s*=|\.find_by_id\s*\(|\.findById\s*\(", "HIGH", 639, None, "Filter by owner."),
    ("AY7", "Hardcoded admin backdoor password comparison", r"(?:password|passwd)\s*==\s*['\"](?:admin|password|123456|root|letmein|test)['\"]", "CRITICAL", 798, None, "Remove it."),
    ("AY8", "Insecure cookie without Secure/HttpOnly flags", r"set_cookie\s*\([^)]+\)|res\.cookie\s*\([^)]*(?!secure|httpOnly)[^)]*\)", "MEDIUM", 614, None, "Set the flags.", r"set_cookie\s*\([^)]+\)|res\.cookie\s*\([^)]*\)"),
], .75)


def load_yaml_rules(path: str) -> list[Rule]:
    """Rules of a YAML file on the driver; a bad rule is left out, an unreadable file gives none."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            rows = yaml.safe_load(f)["rules"]
    except Exception:  # noqa: BLE001  an absent library, file or section all mean no rules
        return []
    out = []
    for r in rows or []:
        try:
            re.compile(r["pattern"])
            out.append(Rule("js-extra", r["id"], r["name"], r["pattern"], r["severity"], r.get("cwe", ""), r.get("remediation", ""), 0.75))
        except (re.error, KeyError, TypeError):
            continue
    return out
