"""From the findings of all engines to one ordered table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.model import FINDING_COLUMNS, ORDINAL, SEVERITIES, scanner_order, severity_order


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def emitted() -> list[Column]:
    """The order in which findings are made: engine, file, place."""
    return [scanner_order(F.col("scanner")), F.col("file"), F.col(ORDINAL)]


def distinct_first(findings: DataFrame) -> DataFrame:
    """The first finding of each id; the minimum is combined before the shuffle."""
    rest = [c for c in findings.columns if c != "id"]
    best = findings.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(emitted())])).alias("f"))
    return best.select("id", "f.*")


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings as grave as ``severity``; an unknown name keeps all."""
    order = SEVERITIES.index(severity) if severity in SEVERITIES else len(SEVERITIES) - 1
    return findings.where(severity_order(F.col("severity")) <= order)


def ordered(findings: DataFrame) -> DataFrame:
    """Gravest first, then by file and line; ties in the order in which they were made."""
    return findings.orderBy(severity_order(F.col("severity")), "file", "line_start", *emitted())


def merge(parts: list[DataFrame], min_severity: str = "INFO") -> DataFrame:
    return at_least(distinct_first(union(parts)), min_severity)


def public(findings: DataFrame) -> DataFrame:
    """Without the ordinals."""
    return findings.select(*FINDING_COLUMNS)


def new_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of ``after`` that ``before`` has not."""
    return after.join(before.select("id"), "id", "left_anti")
