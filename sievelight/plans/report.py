"""Counts, checklist, JSON report, fix prompts and the exit code of a scan.

Findings stay distributed.  What becomes a document is ordered by Spark and
streamed to the driver row by row, so a report of any size is written in
bounded memory.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.paths import highlight_language, relative
from sievelight.functions.text import redact
from sievelight.model import FINDING, FINDING_COLUMNS, ORDINAL, SEVERITIES, severity_order
from sievelight.operators.merge import emitted, ordered, public

#: Characters of a fix prompt, and those kept free besides its fixed parts.
CHUNK_CHARS, SPARE_CHARS = 30_000, 500


@dataclass
class Report:
    """A scan and its findings."""

    scan_id: str
    target: str
    timestamp: datetime
    findings: DataFrame
    files_scanned: int = 0
    seconds: float = 0.0
    scanners: list[str] = field(default_factory=list)


def summary(findings: DataFrame) -> DataFrame:
    """One row: ``total`` and a count of each severity."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, 1).otherwise(0)), F.lit(0)).cast("long").alias(s.lower())
    return findings.agg(F.count("*").alias("total"), *map(of, SEVERITIES))


def by_file(findings: DataFrame) -> DataFrame:
    """``file, findings, worst``: how many findings a file has and how grave they are."""
    return findings.groupBy("file").agg(F.count("*").alias("findings"), F.min(severity_order(F.col("severity"))).cast("int").alias("worst"))


def file_findings(findings: DataFrame) -> DataFrame:
    """``file, n, findings``: the findings of each file as an array, the gravest first.

    A file's findings meet in one row; they are bounded by the file's own
    lines and rules.  Ties stay in the order in which they were made.
    """
    order = [severity_order(F.col("severity")).alias("s"), *[c.alias(f"o{k}") for k, c in enumerate(emitted())]]
    listed = F.sort_array(F.collect_list(F.struct(*order, F.struct(*FINDING_COLUMNS).alias("f"))))
    return findings.groupBy("file").agg(listed.alias("l")).select("file", F.size("l").alias("n"), F.transform("l", lambda x: x["f"]).alias("findings"))


def cube(findings: DataFrame) -> DataFrame:
    """Counts by engine, severity and weakness, with all subtotals."""
    return findings.cube("scanner", "severity", "cwe").agg(F.count("*").alias("findings"))


# Which engines and weaknesses call for which check.
CHECKS = (
    ("All tests pass after the changes", (), ()),
    ("Hardcoded secrets moved to the environment or a vault", ("secrets",), ("CWE-798",)),
    ("Exposed keys and tokens rotated", ("secrets",), ("CWE-798",)),
    ("Endpoints that are not public require a login", ("api_surface",), ("CWE-306", "CWE-770")),
    ("Login, reset, upload and webhook endpoints are rate limited", ("api_surface",), ("CWE-306", "CWE-770")),
    ("Tokens are verified with a strong algorithm", ("auth_bypass",), ("CWE-347", "CWE-639")),
    ("Authorization is decided on the server", ("auth_bypass",), ("CWE-347", "CWE-639")),
    ("Ownership is checked before data is returned", ("auth_bypass",), ("CWE-347", "CWE-639")),
    ("SQL statements bind their parameters", ("sast_python",), ("CWE-89",)),
    ("No eval or exec of dynamic input", ("sast_python",), ("CWE-78",)),
    ("Subprocesses run without a shell", ("sast_python",), ("CWE-78",)),
    ("Only trusted sources are deserialised", ("sast_python",), ("CWE-502",)),
    ("Flagged dependencies are upgraded", ("dependency",), ("CWE-1035",)),
    ("Input is sanitised before it is shown as HTML", ("sast_js_ts",), ("CWE-79",)),
)


def checklist(findings: DataFrame) -> DataFrame:
    """``ord, item`` of the checks that the findings call for."""
    seen = findings.agg(F.collect_set("scanner").alias("s"), F.collect_set(F.nullif("cwe", F.lit(""))).alias("c"))
    lists = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    rows = F.array(*[
        F.when(F.lit(not s) | F.arrays_overlap("s", lists(s)) | F.arrays_overlap("c", lists(c)), F.struct(F.lit(k).alias("ord"), F.lit(item).alias("item")))
        for k, (item, s, c) in enumerate(CHECKS)
    ])
    return seen.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.ord", "r.item")


def gate(findings: DataFrame) -> DataFrame:
    """One row ``exit_code``: 2 if anything is critical or high, else 0."""
    grave = F.max(F.when(F.col("severity").isin("CRITICAL", "HIGH"), 2).otherwise(0))
    return findings.agg(F.coalesce(grave, F.lit(0)).cast("int").alias("exit_code"))


def json_rows(findings: DataFrame) -> DataFrame:
    """Each finding as a JSON object, nulls included."""
    return findings.select("id", F.to_json(F.struct(*FINDING_COLUMNS), {"ignoreNullFields": "false"}).alias("json"))


def write_json(report: Report, path: str, indent: int = 2) -> None:
    """The whole report as one document, findings in order, written as they come."""
    counts = summary(report.findings).first().asDict()
    head = {
        "scan_id": report.scan_id, "target_path": report.target, "timestamp": report.timestamp.isoformat(), "duration_seconds": report.seconds,
        "files_scanned": report.files_scanned, "scanners_used": report.scanners, "summary": counts,
    }
    pad = " " * indent
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(head, indent=indent, ensure_ascii=False)[:-2] + f',\n{pad}"findings": [')
        first = True
        for row in public(ordered(report.findings)).toLocalIterator():
            item = row.asDict() | {"confidence": round(row.confidence, 3)}
            body = json.dumps(item, indent=indent, ensure_ascii=False).replace("\n", "\n" + pad * 2)
            f.write(("\n" if first else ",\n") + pad * 2 + body)
            first = False
        f.write("]\n}" if first else f"\n{pad}]\n}}")


#: What a finding of a cached report cannot be without.
REQUIRED = ("id", "scanner", "file", "line_start", "line_end", "title", "description", "remediation_hint")


def read_report(spark: SparkSession, path: str) -> Report | None:
    """A written report; None if there is none, or one that is damaged or lacks what a finding needs.

    The document is read once here, so whatever is wrong with it shows here.
    A missing time is now, a missing confidence is 0.5.
    """
    item = ", ".join("{}: {}".format(*c.split()) for c in FINDING.split(", "))
    schema = (
        "scan_id string, target_path string, timestamp string, duration_seconds double, files_scanned int, "
        f"scanners_used array<string>, findings array<struct<{item}>>"
    )
    try:
        rows = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
        findings = rows.select(F.posexplode("findings").alias(ORDINAL, "f")).select("f.*", F.col(ORDINAL).cast("long"))
        findings = findings.withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
        sound = F.col("severity").isin(*SEVERITIES)
        for c in REQUIRED:
            sound = sound & F.col(c).isNotNull()
        head = rows.drop("findings").first()
        if head is None or not findings.where(~F.coalesce(sound, F.lit(False))).isEmpty():
            return None
        when = datetime.fromisoformat(head.timestamp) if head.timestamp else datetime.now()
    except Exception:  # noqa: BLE001  whatever is wrong with it, there is no cached report
        return None
    return Report(head.scan_id or "cached", head.target_path or ".", when, findings, head.files_scanned or 0, head.duration_seconds or 0.0, head.scanners_used or [])


def read_json(spark: SparkSession, path: str) -> DataFrame | None:
    """Findings of a written report; None if there is none that can be read."""
    found = read_report(spark, path)
    return found.findings if found else None


def write_prompts_of(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Fix prompts of a written report; none if it cannot be read."""
    found = read_report(spark, path)
    return write_prompts(found, folder) if found else []


def cache(report: Report, path: str) -> bool:
    """Write the report for later prompts; whether that worked (a scan does not fail for want of a cache)."""
    try:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        write_json(report, path)
    except OSError:
        return False
    return True


def blocks(findings: DataFrame) -> DataFrame:
    """``file, sev_order, line_start, scanner_ord, emit_ord, block``: the Markdown of each finding, in order of files."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    percent = (F.col("confidence") * 100).cast("int").cast("string")
    snippet = F.when(F.coalesce("code_snippet", F.lit("")) != "", line("\n```\n", redact(F.col("code_snippet")), "\n```\n")).otherwise("")
    cwe = F.when(F.coalesce("cwe", F.lit("")) != "", line("**CWE:** ", F.col("cwe"), "  \n")).otherwise("")
    block = line(
        "### [", F.col("severity"), "] ", F.col("title"), "\n**File:** `", F.col("file"), "`, lines ", F.col("line_start").cast("string"), "–",
        F.col("line_end").cast("string"), "  \n", cwe, "**Scanner:** ", F.col("scanner"), "  \n**Confidence:** ", percent, "%\n\n**Issue:** ",
        F.col("description"), "\n\n**Fix instructions:** ", F.col("remediation_hint"), "\n", snippet,
    )
    return findings.select("id", "file", severity_order(F.col("severity")).alias("sev_order"), *[c.alias(f"o{k}") for k, c in enumerate(emitted())], block.alias("block"))


def _stream(findings: DataFrame) -> Iterator[str]:
    """Section head, file heads and findings, one after the other."""
    yield "## Findings\n\n"
    last = None
    rows = blocks(findings).orderBy("file", "sev_order", "o0", "o1", "o2")
    for row in rows.toLocalIterator():
        if row.file != last:
            last = row.file
            yield f"---\n\n### `{last}`\n\n"
        yield row.block


def pack(lengths: Iterator[int], overhead: int, most: int = CHUNK_CHARS) -> Iterator[int]:
    """The chunk, from 1, of each block: the next one begins where a block would not fit any more."""
    chunk, size = 1, 0
    for n in lengths:
        if size and size + n + overhead > most:
            chunk, size = chunk + 1, 0
        size += n
        yield chunk


def _head(report: Report, part: int = 1, parts: int = 1) -> str:
    of = f" (Part {part} of {parts})" if parts > 1 else ""
    return (
        f"# Security Fix Prompt{of}\n\nScan `{report.scan_id}` · {report.timestamp:%Y-%m-%d %H:%M}\n\n---\n\n"
        "Fix the issues below with small, targeted changes that keep behaviour and style.\n\n---\n\n"
    )


def _summary(report: Report) -> str:
    n = summary(report.findings).first()
    files = report.findings.agg(F.countDistinct("file")).first()[0]
    return (
        f"## Summary\n\n- **{n.critical} Critical**, {n.high} High, {n.medium} Medium, {n.low} Low, {n.info} Info findings across {files} file(s)\n"
        f"- Scanned {report.files_scanned} files in {report.seconds:.2f}s\n- Scanners run: {', '.join(report.scanners)}\n\n"
    )


def _checks(report: Report) -> str:
    items = "".join(f"- [ ] {r.item}\n" for r in checklist(report.findings).orderBy("ord").collect())  # as many as there are checks
    return f"---\n\n## Verification Checklist\n\n{items}\n"


def write_prompts(report: Report, folder: str) -> list[str]:
    """Numbered Markdown files of at most ``CHUNK_CHARS`` characters where blocks allow it; none without findings."""
    if report.findings.isEmpty():
        return []
    head, counts, checks = _head(report), _summary(report), _checks(report)
    total, lengths = 0, []
    for block in _stream(report.findings):
        total += len(block)
        lengths.append(len(block))
    whole = total + len(head) + len(counts) + len(checks) <= CHUNK_CHARS
    chunks = [1] * len(lengths) if whole else list(pack(iter(lengths), len(head) + len(counts) + len(checks) + SPARE_CHARS))
    parts, paths, out = chunks[-1], [], None
    os.makedirs(folder, exist_ok=True)
    for chunk, block in zip(chunks, _stream(report.findings)):
        if chunk > len(paths):
            if out:
                out.write(f"\n---\n\n*Continued in part {chunk} of {parts}*\n")
                out.close()
            paths.append(os.path.join(folder, f"fix_prompt_{chunk}.md"))
            out = open(paths[-1], "w", encoding="utf-8")  # noqa: SIM115
            out.write(_head(report, chunk, parts) + (counts if chunk == 1 else f"## Summary\n\n*(Continued from part {chunk - 1} of {parts})*\n\n"))
        out.write(block)
    out.write(checks)
    out.close()
    return paths


def terminal_lines(report: Report) -> Iterator[str]:
    """A table of the severities with bars, then every file with its findings, row by row.

    Each finding has its severity, title and lines, its description, the
    snippet with its language, and the hint.  Files stand in order of their
    names relative to the target.
    """
    n = summary(report.findings).first().asDict()
    top = max([n[s.lower()] for s in SEVERITIES]) or 1
    for s in SEVERITIES:
        filled = int(n[s.lower()] / top * 16)
        yield f"{s:<9}{n[s.lower()]:>8}  {'█' * filled}{'░' * (16 - filled)}"
    yield f"{'TOTAL':<9}{n['total']:>8}"
    yield f"{report.files_scanned} files scanned · {report.seconds:.2f}s · scanners: {', '.join(report.scanners)}"
    if not n["total"]:
        yield "No findings."
        return
    shown = report.findings.withColumn("shown", relative(F.col("file"), report.target))
    order = ["shown", "file", severity_order(F.col("severity")), *emitted()]
    last = None
    for row in shown.orderBy(*order).toLocalIterator():
        if row.file != last:
            last = row.file
            yield f"\n{row.shown}"
        yield f"├─ [{row.severity}] {row.title}  (line {row.line_start}–{row.line_end})"
        yield f"│    {row.description}"
        if snippet := (row.code_snippet or "").strip():
            yield f"│    ({highlight_language(row.file)})"
            yield from (f"│      {line}" for line in snippet.splitlines())
        if row.remediation_hint:
            yield f"│    fix: {row.remediation_hint}"


def terminal(report: Report) -> str:
    return "\n".join(terminal_lines(report))
