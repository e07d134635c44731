"""Makes the package importable in Python workers that don't share the driver's path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import folio

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    top = os.path.dirname(folio.__file__)
    path = os.path.join(tempfile.mkdtemp(), "folio.zip")  # Spark serves it from the driver
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("folio", os.path.relpath(full, top)))
    context.addPyFile(path)
