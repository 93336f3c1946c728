"""Brings the package to the executors of a session that can't import it from a path of their own."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session once, unless Python's path has it already."""
    app = spark.sparkContext.applicationId
    paths = {os.path.abspath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)}
    if app in _DONE or ROOT in paths or os.getcwd() == ROOT:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="sedimark-"), "sedimark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "sedimark")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
    spark.sparkContext.addPyFile(path)
    _DONE.add(app)
