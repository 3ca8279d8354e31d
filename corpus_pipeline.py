"""The corpus pipeline: five stages from raw documents to token records.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents that the
stage before it kept, and returns a DataFrame.  All but the last return the
columns of ``docs``.  The driver writes every stage's result as Parquet and
reads it again as the next stage's documents; ``run`` does the same in the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelight.llm import decontamination, mixing, near_duplicates, quality, token_records
from sievelight.llm.queries import quality_weights, table, vocabulary
from sievelight.plans.staging import new_path, stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, quality.score_documents(docs, model))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 connect, the document of the least id stays."""
    return near_duplicates.keep_first_of_class(docs, near_duplicates.near_duplicates(docs))


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in their target shares; a document comes as often as the mix holds it."""
    mix, _ = mixing.plan_mix(docs, quality_weights(table(spark, sf_dir, "labels")))
    return mixing.apply_mix(docs, mix)


def write_token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in framed records, as read back from the files."""
    folder = new_path(spark, "pipeline-records")
    token_records.write_records(docs, folder, vocabulary())
    return token_records.read_records(spark, folder, digest=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_overlaps),
    ("mixing sources", mix_sources),
    ("token records", write_token_records),
]

#: SQL has no byte-level BPE and no seeded sample like the mix's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{k}")
    return docs
