"""Engines that match rules against single lines.

Every rule has texts of which a matching line must hold one.  Files without
any of them are left out before they are split, and a line is tried only on
the rules whose texts it holds, so regular expressions see few lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.paths import is_test_path
from sievelight.functions.text import entropy, explode_lines
from sievelight.model import finding
from sievelight.sources.rules import AUTH, EXTENDED, JS, SECRETS, Rule

# Suffixes of scripts, code suffixes, and languages that are data.
SCRIPT_SUFFIXES = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
CODE_SUFFIXES = (".py", ".js", ".ts", ".jsx", ".tsx", ".rb", ".php", ".go", ".java", ".cs")
DATA_LANGUAGES = ("yaml", "json", "toml", "markdown")
#: Small letters from the rarest to the most common; what is none of them is rarer.
_COMMON = "zqxjkvbpygfwmucldrhsnioate"
#: Least bits a character of a literal that looks random.
HIGH_ENTROPY = 4.5
LITERAL = r"['\"]([A-Za-z0-9+/=_\-]{20,})['\"]"


def _skipped(line: Column, starts: tuple[str, ...], marks: str) -> Column:
    bare = F.regexp_replace(line, r"^\s+", "")
    skip = (bare == "") | line.rlike(marks)
    for s in starts:
        skip = skip | bare.startswith(s)
    return skip


def skip_script_line(line: Column) -> Column:
    """Blank lines, comments, and lines marked ``nosec``, with or without a tool's name before it."""
    return _skipped(line, ("//", "*", "/*", "<!--"), r"# nosec|// (?:\w+: )?nosec")


def skip_code_line(line: Column) -> Column:
    return _skipped(line, ("#", "//", "*", "<!--", "--"), r"# (?:\w+: )?nosec|# noqa")


def _commonness(text: str) -> int:
    """How common its first character is in prose; longer texts come first where it ties."""
    return _COMMON.find(text[0]) * 100 - len(text)


def holds_any(text: Column, rules: list[Rule]) -> Column:
    """Whether a text holds what one of the rules needs.

    Where case counts, each text is looked for by itself, from a rare
    character of it on.  Where it does not, one expression tries all texts at
    the places that may begin one.
    """
    needs = [r.needs for r in rules]
    if not needs or None in needs:
        return F.lit(bool(needs))
    tests = []
    for any_case in (False, True):
        texts = sorted({x for n in needs for x, any_ in n if any_ == any_case}, key=lambda x: (len(x), x))
        # a text that holds another is held only where the other is
        least = [x for k, x in enumerate(texts) if not any(y in x for y in texts[:k])]
        if any_case and least:
            first = "".join(sorted({rf"\x{ord(x[0]):02x}" for x in least}))
            tried = "|".join(rf"\Q{x}\E" for x in least)
            tests.append(text.rlike(f"(?i)(?=[{first}])(?:{tried})"))
        elif least:
            tests += [F.contains(text, F.lit(min((x[k:] for k in range(max(1, len(x) - 3))), key=_commonness))) for x in least]
    return reduce(lambda a, b: a | b, tests)


def match_rules(lines: DataFrame, rules: list[Rule], scanner: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of all rules in one pass over ``path, line_no, line``, with the columns ``keep``.

    The patterns are literals, so each is compiled once a task; a line makes
    rows only for the rules that it matches.
    """
    line = F.col("line")
    met = F.array(*[F.when(holds_any(line, [r]) & line.rlike(r.pattern), F.lit(k)) for k, r in enumerate(rules)])
    lines = lines.where(holds_any(line, rules))
    hits = lines.select("path", "line_no", "line", *keep, F.explode_outer(F.filter(met, lambda k: k.isNotNull())).alias("k")).where("k is not null")
    table = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in (("name", r.name), ("title", r.title), ("severity", r.severity), ("cwe", r.cwe), ("advice", r.advice), ("confidence", float(r.confidence)))])
        for r in rules
    ])
    hits = hits.withColumn("rule", F.element_at(table, F.col("k") + 1))
    rule = lambda f: F.col(f"rule.{f}")
    text = F.concat(rule("name"), F.lit(" at line "), F.col("line_no").cast("string"), F.lit("."))
    columns = finding(
        scanner, rule("severity"), rule("cwe"), F.col("path"), F.col("line_no"), rule("name"), rule("title"), text, rule("advice"),
        rule("confidence"), F.rtrim(F.col("line")), F.col("line_no").cast("long") * 1000 + F.col("k"),
    )
    return hits.select(*columns, *keep)


def js_findings(files: DataFrame, rules: list[Rule] = JS) -> DataFrame:
    gate = F.col("language").isin("javascript", "typescript") | F.col("suffix").isin(*SCRIPT_SUFFIXES)
    lines = explode_lines(files.where(F.coalesce(gate, F.lit(False)) & holds_any(F.col("content"), rules)))
    return match_rules(lines.where(~skip_script_line(F.col("line"))), rules, "sast_js_ts")


def auth_findings(files: DataFrame, rules: list[Rule] = AUTH) -> DataFrame:
    data = F.coalesce(F.col("language").isin(*DATA_LANGUAGES), F.lit(False)) & ~F.col("suffix").isin(*CODE_SUFFIXES)
    lines = explode_lines(files.where(~is_test_path(F.col("path")) & ~data & holds_any(F.col("content"), rules)))
    return match_rules(lines.where(~skip_code_line(F.col("line"))), rules, "auth_bypass")


def extended_findings(files: DataFrame, rules: list[Rule] = EXTENDED) -> DataFrame:
    """The rules that are off by default."""
    lines = explode_lines(files.where(holds_any(F.col("content"), rules)))
    return match_rules(lines.where(~skip_code_line(F.col("line"))), rules, "extended")


def known_secrets(files: DataFrame, rules: list[Rule] = SECRETS) -> DataFrame:
    """Findings of the known formats alone."""
    return match_rules(explode_lines(files.where(holds_any(F.col("content"), rules))), rules, "secrets")


def secret_findings(files: DataFrame, rules: list[Rule] = SECRETS, least: float = HIGH_ENTROPY) -> DataFrame:
    """Known formats, then quoted literals whose entropy is above ``least``."""
    known = known_secrets(files, rules)
    quoted = explode_lines(files.where(F.col("content").rlike(LITERAL))).where(F.col("line").rlike(LITERAL))
    random = quoted.withColumn("literal", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(LITERAL), F.lit(1)))))
    random = random.where(entropy(F.col("literal")) > least).groupBy("path", "line_no", "line").agg(F.min("literal").alias("literal"))
    title = F.lit("High-Entropy String Literal")
    columns = finding(
        "secrets", F.lit("HIGH"), F.lit("CWE-798"), F.col("path"), F.col("line_no"), title, title,
        F.concat(F.lit("A literal looks random at line "), F.col("line_no").cast("string"), F.lit(".")),
        F.lit("Move it to the environment if it is a secret."), F.lit(0.6), F.rtrim(F.col("line")),
        F.col("line_no").cast("long") * 1000 + len(rules),
    )
    return known.unionByName(random.select(*columns))
