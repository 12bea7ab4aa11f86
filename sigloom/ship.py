"""Readies a session: sends the package to the executors, for Python workers that do not have it installed, and bounds
the Arrow batches that pass between an executor and its Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, where the session sets none. Spark's own 64 MB are held several times over per running task
#: (a buffer off the heap and its next size, the message, the worker's copy), so executors of a few GB have no room for them.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Bounds Arrow batches where the session does not; adds a zip of the package to its Python files, once per application."""
    sc = spark.sparkContext
    given = spark.conf.getAll
    for key, value in BATCH.items():
        if key not in given:
            spark.conf.set(key, value)
    if sc.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="sigloom-"), "sigloom_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _sent.add(sc.applicationId)
