"""Token counts through a digest cache.

Counts are stored by the digest of a text and the version of its tokenizer.
A run joins its digests to the store, encodes one text of each digest that is
missing, appends those counts, and joins once more.  No digest is ever encoded
twice in a run, whatever ids and copies its rows have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.arrow import bound_batches, slices
from sievelight.llm.encoding import encoder, tokenizer_version
from sievelight.plans.sizing import BROADCAST_ROWS, is_small, join_groups
from sievelight.plans.staging import discard, new_path, stage

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def _normalised(text: str):
    """A null text counts as an empty one; nothing else may change, or counts would."""
    return F.coalesce(F.col(text), F.lit(""))


def _count(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in slices(batches, 1):
        n = [enc.count(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])


def read_cache(spark, cache_path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; none where the store is new."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(cache_path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    # two runs at a time may both append a digest; the count is the same
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    over: int = 512,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``cache_path`` is a folder in shared storage that outlives the run; by
    default each run has its own.  A null text is empty (0 bytes, 0 tokens);
    null and repeated ids keep their rows; other columns are ignored.  The
    second reading encodes one row of each missing digest: rows that repeat a
    digest are left out by a broadcast of their ids while there are few, and
    by an aggregation on the digest beyond that.  Rows that repeat both cannot
    be told apart; they alone are brought together by their digest first.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    texts = docs.select(F.col(id_col).alias("id"), _normalised(text_col).alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    cache_path = cache_path or new_path(spark, "token-counts")

    seen = stage(texts.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    # of each digest the rows of its least id; ids of equal rows are counted before
    rows = seen.groupBy("digest", "id").agg(F.count("*").alias("n"))
    own = F.struct("id", "n")
    first = rows.groupBy("digest").agg(F.min(own).alias("first"), F.count("*").alias("ids"))
    first = stage(first.select("digest", F.col("first.id").alias("first_id"), F.col("first.n").alias("twins"), "ids"), "digest-groups")
    missing = stage(first.join(read_cache(spark, cache_path, version), "digest", "left_anti"), "missing-digests")

    # rows that need no encoding: their digest is stored, or another id has it
    known = first.where("ids > 1").select("digest").unionByName(first.select("digest").join(missing, "digest", "left_anti")).distinct()
    spare = join_groups(seen.select("id", "digest"), stage(known, "spare-digests"), ["digest"], broadcast_rows=broadcast_rows)
    wanted = missing.select("digest", "first_id", F.lit(True).alias("miss"))
    spare = join_groups(stage(spare.distinct(), "repeated-rows"), wanted, ["digest"], "left", broadcast_rows=broadcast_rows)
    spare = spare.where(F.col("miss").isNull() | ~F.col("first_id").eqNullSafe(F.col("id")))
    spare = stage(spare.select(F.col("id").alias("spare_id"), F.col("digest").alias("spare_digest")), "spare-rows")
    twins = stage(missing.where("twins > 1").select(F.col("digest").alias("twin")), "twin-digests")
    if is_small(spare, broadcast_rows) and is_small(twins, broadcast_rows):
        same = F.col("id").eqNullSafe(F.col("spare_id")) & (F.col("digest") == F.col("spare_digest"))
        once = texts.join(F.broadcast(spare), same, "left_anti")
        if not twins.isEmpty():
            is_twin = F.col("digest") == F.col("twin")
            some = once.join(F.broadcast(twins), is_twin, "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
            once = once.join(F.broadcast(twins), is_twin, "left_anti").select("digest", "text").unionByName(some)
    else:
        kept = texts.join(missing.select("digest"), "digest", "left_semi")
        once = kept.groupBy("digest").agg(F.first("text").alias("text"))
    fresh = once.select("digest", "text").mapInArrow(partial(_count, tokenizer_path), "digest binary, n_tokens long")
    fresh.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache_path)
    discard(missing, spare, twins)

    # what a digest with very many copies joins goes to its rows
    counts = stage(read_cache(spark, cache_path, version).join(first.select("digest"), "digest", "left_semi"), "counts")
    joined = join_groups(seen, counts, ["digest"], broadcast_rows=broadcast_rows)
    return joined.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
