"""Getting the package to the Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: Bytes of an Arrow batch handed to a Python worker, so that long texts do not add up.
ARROW_BYTES = 32 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: they can where PYTHONPATH names it, else Spark distributes an archive."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' times are meant as UTC
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        into = tempfile.mkdtemp()
        spark.sparkContext.addPyFile(shutil.make_archive(f"{into}/quarryline", "zip", ROOT, "quarryline"))
        _shipped.add(app)
