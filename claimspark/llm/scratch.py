"""Written tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: the session's checkpoint folder.

    ``spark.checkpoint.dir`` names it. Where it is unset, a session that runs in one process (tests) gets a folder of its
    own; on a cluster a local folder would be invisible to the other machines, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="claimspark-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Where ``new_folder`` makes folders just now, if not in the shared folder itself.
_within: ContextVar[str | None] = ContextVar("_within", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder nobody has written to yet, so a rerun never overwrites a table that is being read."""
    return f"{_within.get() or f'{shared_folder(spark)}/llm'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """New folders go into one of their own, which can be removed when nothing reads its tables any more."""
    folder = new_folder(spark, name)
    outer = _within.set(folder)
    try:
        yield folder
    finally:
        _within.reset(outer)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ``new_folder`` or ``scratch_folder`` with all its tables, in whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Frees the shuffles of a query when it ends, instead of when the driver happens to collect garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: its lineage ends here, and every reader sees the same rows. Nothing needs the
    shuffles that made it any more, so they go."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` written with a key per row: row, and doc with all columns, so none of a caller's names can clash.

    Ids may be null or repeat and equal rows exist; an operator that decides about rows decides by this key.
    """
    every = F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("doc")
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), every), name)


def slots(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which its owner sizes by the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
