"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, unless PYTHONPATH names its folder there already."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if context.applicationId in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="reposcope-")
    context.addPyFile(shutil.make_archive(f"{folder}/reposcope", "zip", root, "reposcope"))
    _shipped.add(context.applicationId)
