"""A whole scan: which engines run, over which files, and what comes of it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.paths import language_of, name_of, suffix_of
from sievelight.model import FINDING, ORDINAL
from sievelight.operators import api_surface, dependencies, line_rules, model_review, python_ast
from sievelight.operators.merge import merge
from sievelight.plans.report import Report
from sievelight.plans.staging import stage


@dataclass(frozen=True)
class Options:
    """What a scan does; of the four single modes the first that is set wins."""

    secrets: bool = False
    api: bool = False
    bypass: bool = False
    deps: bool = False
    extended: bool = False
    min_severity: str = "INFO"
    complete: Callable[[str], str] | None = None
    advisories: DataFrame | None = None


_extra: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_engine(name: str, engine: Callable[[DataFrame], DataFrame]) -> None:
    """Add an engine from files to findings to every full scan."""
    _extra[name] = engine


def engines(options: Options) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The engines of a mode by name; only their branches are planned."""
    deps = {"dependency": lambda f: dependencies.dependency_findings(f, options.advisories)} if options.advisories is not None else {}
    if options.secrets:
        return {"secrets": line_rules.secret_findings}
    if options.api:
        return {"api_surface": api_surface.api_findings}
    if options.bypass:
        return {"auth_bypass": line_rules.auth_findings}
    if options.deps:
        return deps
    found = {
        "secrets": line_rules.secret_findings, "sast_python": python_ast.python_findings, "sast_js_ts": line_rules.js_findings,
        "api_surface": api_surface.api_findings, "auth_bypass": line_rules.auth_findings, **deps,
    }
    if options.complete is not None:
        found["llm_logic"] = lambda f: model_review.parse_responses(model_review.responses(f, options.complete))
    if options.extended:
        found["extended"] = line_rules.extended_findings
        found["route_packs"] = api_surface.pack_findings
    return found | _extra


def as_files(table: DataFrame, path, content: str) -> DataFrame:
    """Any table with a text column as files."""
    rows = table.select(path.alias("path"), F.col(content).alias("content")).where("content is not null")
    return rows.select(
        "path", name_of(F.col("path")).alias("name"), suffix_of(F.col("path")).alias("suffix"), F.octet_length("content").cast("long").alias("size"),
        "content", language_of(F.col("path")).alias("language"),
    )


def scan(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Findings of all chosen engines, each once, as grave as asked for; none where no engine is chosen."""
    parts = [engine(files) for engine in engines(options).values()]
    if not parts:
        return files.sparkSession.createDataFrame([], f"{FINDING}, {ORDINAL} long")
    return merge(parts, options.min_severity)


def report(files: DataFrame, target: str, options: Options = Options(), now: datetime | None = None) -> Report:
    """Scan and count; without files no engine is named.

    The findings are written once, and whatever is made of the report reads
    them back; the duration is that of the scan.
    """
    began = time.time()
    n = files.count()
    findings = stage(scan(files, options), "findings")
    return Report(uuid.uuid4().hex[:8], target, now or datetime.now(), findings, n, time.time() - began, list(engines(options)) if n else [])
