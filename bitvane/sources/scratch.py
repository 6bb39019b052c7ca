"""Written tables that cut a lineage: in the folder that all executors share, and gone when they are done with.

The folder is the one that the session names in spark.checkpoint.dir. A local session without one
gets a temporary folder; on a cluster, where executors would each write to a folder of their own,
that is an error.

What materialize() writes inside a scope() goes when the scope ends, once what depends on it is
written; everything else goes when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="bitvane-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _quietly_remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may be gone before this hook runs
        return


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes with the scope, or when the driver ends."""
    path = f"{shared_folder(spark)}/bitvane/{tag}-{uuid.uuid4().hex}"
    atexit.register(_quietly_remove, spark, path)
    if _scopes:
        _scopes[-1].append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again. The files outlive the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what is written inside; what must outlast it is written outside, or by kept()."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            _quietly_remove(spark, path)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """materialize() for the scope outside the innermost one."""
    inner = _scopes.pop() if _scopes else None
    try:
        return materialize(df, tag)
    finally:
        if inner is not None:
            _scopes.append(inner)
