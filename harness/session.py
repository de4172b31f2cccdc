"""What the driver's sessions may lack."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure_shared_folder(spark: SparkSession) -> None:
    """Give a session of one process (tests, the driver's runs) a folder for stored tables where none is set.

    A cluster has to name one itself: a folder on this machine would be invisible to the others.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="claimspark-"))
