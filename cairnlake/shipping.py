"""The package on the executors, for sessions that were started without it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package along with the application, once a session."""
    context = spark.sparkContext
    if getattr(context, "_cairnlake_shipped", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='cairnlake-')}/cairnlake", "zip", ROOT.parent, ROOT.name)
    context.addPyFile(archive)
    context._cairnlake_shipped = True
