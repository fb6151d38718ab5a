"""Scratch tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_collectors: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a temporary one, and a cluster an error, as its machines share none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="spark-gaugeflow-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _collectors:
        paths.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[back] = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned, once all that was made of them is written itself."""
    for table in tables:
        if path := _paths.pop(table, None):
            _delete(table.sparkSession, path)


@contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """Tables that ``written`` makes inside the block are noted in ``paths``."""
    _collectors.append(paths)
    try:
        yield
    finally:
        _collectors.pop()


def release(docs: DataFrame, paths: list[str]) -> None:
    """Delete the tables of ``paths``, but for those that ``docs`` reads: for a step whose input was written, which needs nothing else of the steps before it."""
    read = " ".join(docs.inputFiles())
    for path in list(paths):
        if path.rpartition("/")[2] not in read:
            _delete(docs.sparkSession, path)
            paths.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
