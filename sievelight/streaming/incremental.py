"""Scans of a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sievelight.operators import line_rules
from sievelight.plans.scan import Options, scan


def watch_lines(files: DataFrame, when: str, delay: str = "1 hour") -> DataFrame:
    """Findings of the line engines on a stream; each once within ``delay`` of the event time ``when``."""
    stamped = files.withWatermark(when, delay)
    found = line_rules.match_rules(
        line_rules.explode_lines(stamped, when), line_rules.SECRETS, "secrets", keep=(when,)
    )
    return found.dropDuplicatesWithinWatermark(["id"])


def scan_batches(files: DataFrame, out: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Every engine on each micro-batch; a batch that is run again replaces its own findings."""

    def write(batch: DataFrame, batch_id: int) -> None:
        scan(batch, options).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
