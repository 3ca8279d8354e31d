"""The findings table and the severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from the gravest to the least.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")

FILES = "path string, name string, suffix string, size long, content string, language string"
FINDING = (
    "id string, scanner string, severity string, cwe string, file string, line_start int, line_end int, "
    "title string, description string, remediation_hint string, confidence double, code_snippet string"
)
FINDING_COLUMNS = [f.split()[0] for f in FINDING.split(", ")]
#: Besides its columns every finding carries where it was made: its place in its file.
ORDINAL = "emit_ord"

#: Engines in the order in which their findings are joined.
SCANNERS = ("secrets", "sast_python", "sast_js_ts", "api_surface", "auth_bypass", "dependency", "llm_logic")


def severity_order(severity: Column) -> Column:
    """0 for the gravest to 4; an unknown severity counts as the least."""
    order = F.lit(len(SEVERITIES) - 1)
    for k, name in reversed(list(enumerate(SEVERITIES))):
        order = F.when(severity == name, k).otherwise(order)
    return order


def scanner_order(scanner: Column) -> Column:
    order = F.lit(len(SCANNERS))
    for k, name in reversed(list(enumerate(SCANNERS))):
        order = F.when(scanner == name, k).otherwise(order)
    return order


def fingerprint(file: Column, line: Column, key: Column, scanner: Column) -> Column:
    """Twelve hex digits that tell a finding from all others."""
    return F.substring(F.sha2(F.concat_ws(":", file, line.cast("string"), key, scanner), 256), 1, 12)


def finding(
    scanner: str, severity: Column, cwe: Column, file: Column, line: Column, key: Column, title: Column, description: Column,
    remediation: Column, confidence: Column, snippet: Column, emit_ord: Column, line_end: Column | None = None,
) -> list[Column]:
    """The columns of a finding for ``select``."""
    values = {
        "id": fingerprint(file, line, key, F.lit(scanner)), "scanner": F.lit(scanner), "severity": severity, "cwe": cwe, "file": file,
        "line_start": line.cast("int"), "line_end": (line if line_end is None else line_end).cast("int"), "title": title,
        "description": description, "remediation_hint": remediation, "confidence": confidence.cast("double"), "code_snippet": snippet,
        ORDINAL: emit_ord.cast("long"),
    }
    return [c.alias(k) for k, c in values.items()]
