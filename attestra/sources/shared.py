"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Only where one machine does everything and the session names no folder, as in local tests.
OWN_FOLDER = "/tmp/attestra-checkpoints"
#: open: the paths stored within each scratch() that this thread has open.
_OWN = threading.local()


def _open() -> list[list[tuple[SparkSession, str]]]:
    if not hasattr(_OWN, "open"):
        _OWN.open = []
    return _OWN.open


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Without one a local session gets one of its own; a cluster can't."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(OWN_FOLDER)
        found = context.getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; an open scratch() removes it at its end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if opened := _open():
        opened[-1].append((spark, path))
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: what is read no longer hangs on executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Remove a stored table that nothing reads any more."""
    if path := getattr(df, "_stored_at", None):
        remove(df.sparkSession, path)


@contextmanager
def scratch() -> Iterator[None]:
    """What is stored within is removed at the end: for results that have been written or collected by then."""
    _open().append([])
    try:
        yield
    finally:
        for spark, path in _open().pop():
            remove(spark, path)
