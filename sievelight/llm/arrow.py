"""Bounded work on Arrow batches."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text handled at a time; a longer text is handled alone.
SLICE_BYTES = 4 << 20


#: Spark's limit for a batch that goes to Python.
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Send batches of texts of ``SLICE_BYTES`` to Python from here on, where the session allows larger ones.

    A batch is held outside the heap on the JVM's side and once more by the
    worker, for each task at work.
    """
    if int(spark.conf.get(BATCH_CONF, "67108864b").rstrip("b")) > SLICE_BYTES:
        spark.conf.set(BATCH_CONF, str(SLICE_BYTES))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table; structs in them are dicts.

    They go to the JVM as Arrow data.  From a list of tuples Spark makes an
    RDD of Python objects, for which every executor starts a second daemon
    with workers of its own that stay beside those of the operators.
    """
    kind = StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)
    columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), kind)


def give_back() -> None:
    """Return freed memory to the system: a worker stays alive between stages beside a JVM that wants the room."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose ``column`` (strings or bytes) has about ``most`` bytes.

    Sessions may cut batches by rows alone, and ten thousand long texts would
    be in memory several times over: as Arrow data, as Python strings, as
    results.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
    give_back()
