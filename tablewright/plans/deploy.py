"""Ships this package to the executors of a session."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once a context."""
    context = spark.sparkContext
    if getattr(context, "_tablewright_shipped", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tablewright-')}/{PACKAGE.name}", "zip", PACKAGE.parent, PACKAGE.name)
    context.addPyFile(archive)
    context._tablewright_shipped = True
