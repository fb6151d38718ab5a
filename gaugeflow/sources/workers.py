"""How Python workers get this package, and how much they get at once."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shared: set[str] = set()  # applications that have it


def share_package(spark: SparkSession) -> None:
    """Before functions of this package go to Python workers: ship its modules as a zip with the application, once."""
    context = spark.sparkContext
    if context.applicationId in _shared:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "gaugeflow_package.zip")
    root = os.path.dirname(_PACKAGE)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    _shared.add(context.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """``share_package``, and 1000 rows or 32 MB at most in a batch for Python, where the session says nothing of its own: long texts then don't pile up. All operators ask for the same."""
    share_package(spark)
    for name, value, usual in (("maxRecordsPerBatch", "1000", "10000"), ("maxBytesPerBatch", "32m", None)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.sparkContext.getConf().get(key) is None and (usual is None or spark.conf.get(key, usual) == usual):
            spark.conf.set(key, value)
