"""Sessions: the package itself is sent to executors, so Python tasks can import it wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Add this package to the session's Python files, once per application."""
    context = spark.sparkContext
    if getattr(context, "_scorewright_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="scorewright-")  # executors fetch the archive from here while the driver lives
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder, "scorewright.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, Path("scorewright", source.relative_to(root)))
    context.addPyFile(str(path))
    context._scorewright_shipped = True
