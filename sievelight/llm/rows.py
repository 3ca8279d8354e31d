"""Rows of a table of documents that an operator decided on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.plans.sizing import without
from sievelight.plans.staging import stage


def fresh(docs: DataFrame, stem: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def same_row(docs: DataFrame, id_col: str, text_col: str, other_id: str, other_hash: str) -> Column:
    """Whether a row is the one with that id and that hash of its text."""
    return docs[id_col].eqNullSafe(F.col(other_id)) & (F.xxhash64(docs[text_col]) == F.col(other_hash))


def drop_rows(docs: DataFrame, out: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows of ``out`` (``id_col, text_hash``); all columns of ``docs`` stay as they are."""
    i, h = fresh(docs, "__id"), fresh(docs, "__hash")
    out = stage(out.select(F.col(id_col).alias(i), F.col("text_hash").alias(h)).distinct(), "dropped-rows")
    return without(docs, out, same_row(docs, id_col, text_col, i, h))
