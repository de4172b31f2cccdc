"""Tables written once and read by many results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Hashable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows that one task may send to one partition of a table before the rest go to another task.
BLOCK_ROWS = 1 << 20


def gathered(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """``df`` with rows brought together by some columns, large groups over several tasks.

    Spark cuts a large group between the tasks that its rows come from, never within one of them. A task that makes many
    rows of a small file therefore numbers them in blocks, which are groups of their own; one with fewer rows than a
    block has a single one.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the number within the task
    numbered = df.withColumn("_block", F.floor(row / F.lit(BLOCK_ROWS)))
    return numbered.hint("rebalance", *[F.col(c) for c in (*partition_by, "_block")]).drop("_block")


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), dynamic: bool = False, gather: bool = True
) -> DataFrame:
    """Write ``df`` as Parquet and return the written table.

    Rows are brought together by the partition columns first, large partitions over several tasks: otherwise every task
    would write a small file into every folder. Without ``gather`` every task does, for rows that have just been shuffled
    into even parts. ``dynamic`` replaces only the partitions present in ``df``, for reruns of single years or files.
    """
    if partition_by and gather:
        df = gathered(df, partition_by)
    writer = df.write.mode("overwrite")
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # The written schema is known, so no footer or directory name needs to be inspected for types.
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder. An error if there is none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share, or pass a TableStore")
    return folder.rstrip("/")


class TableStore:
    """Named Parquet tables below one folder.

    A table is built and written the first time it is asked for. Later uses scan it, so its lineage ends there: a lost
    executor costs a re-read, not a recomputation from the raw files. A table belongs to the inputs it was built from:
    asked for with others, it is another table. Every build goes to a folder of its own, so no table is replaced while
    somebody reads it, by this store or by another one on the same folder.
    """

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self._tables: dict[tuple[str, tuple[Hashable, ...]], DataFrame] = {}
        self._inputs: list[object] = []

    @classmethod
    def for_session(cls, spark: SparkSession, name: str) -> TableStore:
        return cls(f"{shared_folder(spark)}/claimspark/{spark.conf.get('spark.app.id', 'session')}/{name}")

    def new_path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def table(
        self,
        name: str,
        build: Callable[[], DataFrame],
        partition_by: Sequence[str] = (),
        inputs: Sequence[object] = (),
        gather: bool = True,
    ) -> DataFrame:
        """The table called ``name`` of these ``inputs``: values that compare (years), or objects told apart by identity
        (sources, code lists). ``gather`` as for ``write_table``."""
        key = (name, tuple(x if isinstance(x, Hashable) else id(x) for x in inputs))
        if key not in self._tables:
            self._inputs += inputs  # an id stays theirs as long as the objects live
            self._tables[key] = write_table(build(), self.new_path(name), partition_by, gather=gather)
        return self._tables[key]

    def rebuilt(
        self,
        name: str,
        old: DataFrame,
        build: Callable[[], DataFrame],
        changed: Mapping[str, Collection],
        partition_by: Sequence[str],
        inputs: Sequence[object],
    ) -> DataFrame:
        """The table called ``name`` of new ``inputs``: that of ``old``, with other rows in the partitions that have one of the
        values in ``changed`` in a column.

        ``build`` gives the rows; those of unchanged partitions are left out, and only the changed ones are written, to a
        folder of their own. The new version reads the others where they are. Nothing is deleted or overwritten, so whoever
        reads the old version goes on reading it.
        """
        unknown = set(changed) - set(partition_by)
        if unknown:
            raise ValueError(f"{name} isn't partitioned by {', '.join(sorted(unknown))}")
        tests = [F.coalesce(F.col(c).isin(list(values)), F.lit(False)) for c, values in changed.items() if len(values)]
        if not tests:
            return self._take(name, old, inputs)
        hit = reduce(Column.__or__, tests)
        new = write_table(build().where(hit), self.new_path(name), partition_by)
        return self._take(name, old.where(~hit).unionByName(new), inputs)

    def _take(self, name: str, table: DataFrame, inputs: Sequence[object]) -> DataFrame:
        self._inputs += inputs
        self._tables[(name, tuple(x if isinstance(x, Hashable) else id(x) for x in inputs))] = table
        return table


def plain_number(name: str) -> str:
    """A double or decimal as text without exponent and with at least one decimal: ``11140748.0``."""
    # As many decimals as a double can have; Java prints the shortest text that reads back as the same number.
    return (
        f"CASE WHEN isnan({name}) OR abs({name}) = double('infinity') THEN cast({name} AS string) "
        f"ELSE format_number(cast({name} AS double), '0.0{'#' * 330}') END"
    )


def export_csv(df: DataFrame, path: str, order_by: Sequence[str] = (), most_rows: int = 1_000_000) -> None:
    """One sorted CSV with a header row; NULL is an empty field, numbers are plain.

    For results only: the single file is written by one task, so a table of more than ``most_rows`` rows fails the job
    instead of passing through it. ``repartition`` rather than ``coalesce`` keeps the stages that compute the result
    parallel.
    """
    one = df.repartition(1)
    ordered = one.sortWithinPartitions(*order_by) if order_by else one
    place = F.monotonically_increasing_id()  # the only task counts from 0
    too_long = F.raise_error(F.lit(f"more than {most_rows} rows are too many for a single file"))
    checked = ordered.withColumn("_too_long", F.when(place >= most_rows, too_long).cast("string")).where("_too_long IS NULL")
    shown = [
        F.expr(plain_number(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.FractionalType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    checked.select(*shown).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue='""')


def stack_facts(facts: dict[str, DataFrame]) -> DataFrame:
    """Several fact tables in one long table, tagged by name; columns a fact lacks are NULL."""
    stacked = None
    for name, df in facts.items():
        tagged = df.select(F.lit(name).alias("fact"), "*")
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    return stacked
