"""Tables staged in the folder that the cluster shares.

Iterative operators cut their lineage by writing a table and reading it
back.  Such a table has the durability of the shared file system, so an
executor that is lost costs a task and never the whole job, and unlike
``checkpoint()`` its plan is computed once.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent in local mode (tests) one temporary folder
    per application is made and remembered.  On a cluster its absence is an
    error: every executor would write into a folder of its own.
    """
    found = spark.conf.get(SHARED_DIR_CONF, None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"{SHARED_DIR_CONF} must name a folder that driver and executors share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="sievelight-")
        atexit.register(_remove_local, _local_dirs[app])
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path for a staged table or a folder of files."""
    path = f"{shared_dir(spark)}/sievelight/{label}-{uuid.uuid4().hex[:12]}"
    _staged[path] = spark
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame | str | None) -> None:
    """Delete staged tables that no later step reads."""
    for table in tables:
        path = table if isinstance(table, str) else getattr(table, "_staged_path", None)
        spark = _staged.pop(path, None)
        if spark is not None:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)
