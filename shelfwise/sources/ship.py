"""Sends this package to the executors, so that Python workers find it from any working folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()
#: Bytes of one batch of rows on its way to a Python worker, where the session names no bound.
_BATCH, _BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ship(spark: SparkSession) -> None:
    """Once per application: zip the package and let the driver's file server hand it out. Does nothing where the package
    already comes out of such a zip.

    Batches are bounded in bytes as well: texts of any length then take a few MB of an executor for each task. Spark's bound of 64 MB lets
    its buffers, which double as they grow and are kept for reuse, take hundreds."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, _BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped or not os.path.isdir(os.path.join(_ROOT, "shelfwise")):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-shelfwise-zip-"), "shelfwise_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "shelfwise")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
