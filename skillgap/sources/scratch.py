"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; the warehouse where that is unset.

    Only a local session may write to a ``file:`` folder that was not named as
    shared: on a cluster each executor would fill its own disk.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if root.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class _Scopes(threading.local):
    """Paths handed out inside the scopes that are open in a thread, innermost last.

    Streams call back in threads of their own: what another thread stages meanwhile is not theirs to delete.
    """

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What this thread stages inside is deleted at the end; results have to be written or collected before."""
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            remove(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append(path)
    return path


def materialize(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """The same rows read back from a written table: computed once, and lost executors do not redo it.

    A filter on the column ``by`` then reads the files of its value only.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def drop_scratch(df: DataFrame) -> None:
    """Delete the table behind a ``materialize`` result that nothing will read again."""
    remove(df.sparkSession, df._scratch)
