"""Findings of a language model, through a client that is handed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.model import SEVERITIES, finding

#: Characters of a file that are sent; the rest is cut and marked.
MOST_CHARS = 8000
CUT = "\n... [truncated]"
#: Calls that a task has open at a time, and the seconds that it waits for one.
AT_ONCE, SECONDS = 10, 120.0
SKIPPED = ("yaml", "json", "toml", "markdown")
ITEM = (
    "array<struct<severity: string, line_start: string, line_end: string, title: string, description: string, "
    "remediation_hint: string, cwe: string, confidence: string>>"
)
ASK = (
    "Review this code for faults in its logic and its security. Answer with a JSON array alone; each item has file, line_start, line_end, "
    "severity, cwe, title, description, remediation_hint and confidence. Answer [] if there is nothing to report."
)


def prompts(files: DataFrame) -> DataFrame:
    """``path, prompt`` of the files that are sent."""
    sent = files.where(F.col("language").isNotNull() & ~F.col("language").isin(*SKIPPED))
    cut = F.length("content") > MOST_CHARS
    text = F.when(cut, F.concat(F.substring("content", 1, MOST_CHARS), F.lit(CUT))).otherwise(F.col("content"))
    return sent.select("path", F.concat(F.lit(ASK + "\n\nFile: "), F.col("path"), F.lit("\n"), text).alias("prompt"))


def _ask(complete: Callable[[str], str], at_once: int, seconds: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pool = ThreadPoolExecutor(at_once)
    try:
        for batch in batches:
            answers = []
            for call in [pool.submit(complete, p) for p in batch.column(1).to_pylist()]:
                try:
                    answers.append(call.result(seconds))
                except Exception:  # noqa: BLE001  one file without an answer is no reason to lose the others
                    answers.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string())], names=["path", "response"])
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def responses(files: DataFrame, complete: Callable[[str], str], at_once: int = AT_ONCE, seconds: float = SECONDS) -> DataFrame:
    """``path, response``; null where the client fails, or answers later than ``seconds`` after its turn."""
    return prompts(files).mapInArrow(partial(_ask, complete, at_once, seconds), "path string, response string")


def parse_responses(answers: DataFrame) -> DataFrame:
    """Findings of ``path, response``.

    Fences and prose around the array are left out; an answer that is no
    array gives nothing.  An item whose numbers cannot be read is left out by
    itself, and its neighbours stay.
    """
    bare = F.regexp_replace(F.trim("response"), r"(?m)^```(?:json)?\s*|```\s*$", "")
    array = F.regexp_extract(bare, r"(?s)(\[\s*(?:\{.*?\}\s*,?\s*)*\])", 1)
    items = F.from_json(F.when(array == "", bare).otherwise(array), ITEM)
    rows = answers.select("path", F.posexplode(items).alias("ord", "i")).select("path", "ord", "i.*")
    start = F.when(F.col("line_start").isNull(), F.lit(1)).otherwise(F.expr("try_cast(line_start as int)"))
    rows = rows.withColumn("start", start)
    rows = rows.withColumn("end", F.when(F.col("line_end").isNull(), F.col("start")).otherwise(F.expr("try_cast(line_end as int)")))
    rows = rows.withColumn("sure", F.when(F.col("confidence").isNull(), F.lit(0.7)).otherwise(F.expr("try_cast(confidence as double)")))
    rows = rows.where("start is not null and end is not null and sure is not null")
    named = F.upper(F.coalesce("severity", F.lit("MEDIUM")))
    title = F.coalesce("title", F.lit("Logic Bug Detected"))
    return rows.select(*finding(
        "llm_logic", F.when(named.isin(*SEVERITIES), named).otherwise("MEDIUM"), F.nullif("cwe", F.lit("")), F.col("path"), F.col("start"), title, title,
        F.coalesce("description", F.lit("")), F.coalesce("remediation_hint", F.lit("")), F.col("sure"), F.lit(None).cast("string"), F.col("ord"), F.col("end"),
    ))
