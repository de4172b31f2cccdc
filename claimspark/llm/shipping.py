"""The package on the executors' path, for sessions whose executors don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import claimspark

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application; Spark serves the file to them itself."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(claimspark.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="claimspark-"), "claimspark.zip")
    with zipfile.ZipFile(path, "w") as package:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    package.write(full, os.path.join("claimspark", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
