"""Running totals over a whole table, in any order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.scratch import slots, stored


def running_totals(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with a column for each of ``sums``: its total over all rows before this one in ``order``, 0 for the first.

    ``order`` should tell rows apart, so that equal keys spread as well. Rows are range-sorted over all tasks; a total is
    that of the rows before in the task and of the tasks before, of which the driver sees one row each.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(slots(spark), *order).withColumns({"_part": F.spark_partition_id(), **sums})
    placed = stored(dealt, name)
    of_parts = placed.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums]).orderBy("_part").collect()  # a row per task
    totals = placed.agg(*[F.sum(c).alias(f"_{c}") for c in sums]).schema
    offsets, so_far = [], [0.0 if f.dataType.typeName() == "double" else 0 for f in totals]
    for r in of_parts:
        offsets.append((r["_part"], *so_far))
        so_far = [x + (r[c] or 0) for x, c in zip(so_far, sums, strict=True)]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in totals)
    starts = F.broadcast(spark.createDataFrame(offsets, f"_of_part int, {kinds}"))
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(starts, F.col("_part") == F.col("_of_part"))
        .withColumns({c: F.col(f"_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums})
        .drop("_part", "_of_part", *[f"_{c}" for c in sums])
    )
