"""Brings this package to the Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="veldra-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as bundle:
        for file in sorted(here.rglob("*.py")):
            bundle.write(file, Path(here.name) / file.relative_to(here))
    spark.sparkContext.addPyFile(name)
