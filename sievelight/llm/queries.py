"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import chat, decontamination, fingerprints, licenses, mixing, near_duplicates, quality, sharding, token_counts, token_records
from sievelight.plans.staging import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and read back from the formatted strings."""
    said = r"\### Assistant: </turn> ok"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    read = chat.read_formatted(chat.format_reply_trees(chat.chain(rows)))
    turns = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("texts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of all documents: five-word shingles, similarity 0.8."""
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "copy_id", "n_links")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with the benchmark."""
    found = decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    shards = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def quality_weights(labels: DataFrame) -> DataFrame:
    """Weight 2 for documents labelled good, 1/2 for those labelled bad."""
    mean = F.avg("quality")
    return labels.groupBy("doc_id").agg((F.pow(F.lit(2.0), 2 * mean - 1)).alias("weight")).where("weight is not null")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source, better ones more likely."""
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary; only the queries that encode need the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the 50k byte-level vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wordings in all documents."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.template_table(spark))
    return found.drop("text_hash")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as framed ids and read back."""
    folder = new_path(spark, "token-records")
    token_records.write_records(table(spark, sf_dir, "documents"), folder, vocabulary())
    return token_records.read_records(spark, folder, digest=True)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of all documents, with hosts by source and paths by language."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).drop("text_hash")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat, op2_near_duplicates, op3_decontamination, op4_shards, op5_token_counts, op6_mix, op7_fingerprints, op8_licenses, op9_token_records, op10_quality)
}
_OP1_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, t, CASE WHEN t = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) x(t)),
o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM r),
s AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
         coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
         sum(15 + length(role) + 2 * (length(role) - length(regexp_replace(role, '[%<\n]', '', 'g'))) + length(text)
             + len(regexp_extract_all(text, '<\\*/?turn'))) AS formatted
  FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted AS BIGINT) AS formatted_chars FROM s"""

_OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[\x00-/:-@\[-^`{-\x7f]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(w)]
             ELSE list_distinct([hash(w[k : k + 4]) FOR k IN range(1, len(w) - 3)]) END AS s FROM d),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS m FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 5 * m >= 4 * (nx + ny - m)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY x),
k AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY w) END AS copy_id FROM d),
n AS (SELECT x AS doc_id, count(*) AS n FROM l GROUP BY x)
SELECT doc_id, class_id, copy_id, coalesce(n.n, 0) AS n_links FROM c JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op2_near_duplicates": _OP2_SQL, "op1_chat": _OP1_SQL, "op3_decontamination": decontamination.oracle(), "op6_mix": mixing.oracle(), "op8_licenses": licenses.oracle()}
