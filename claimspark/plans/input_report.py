"""What is wrong with the source tables: cells that can't be read, and enrollment that is listed twice."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.parsing import PROBLEMS, problem_of
from claimspark.operators.claim_lines import LINE_FILE_COLUMNS
from claimspark.sources.text_tables import INSTITUTIONAL_COST_SHARE, LINE_FILES, REVENUE_LINE_COLUMNS

# Fixed value: what enrollment rows of the same person and year are called.
REPEATED = "person and year listed before"


def typed_columns(table: str) -> dict[str, str]:
    """The columns of a source table that aren't text to the analysis, and the kind of each."""
    if table == "beneficiary":
        return {"BENE_ENROLLMT_REF_YR": "int", "AGE_AT_END_REF_YR": "int"}
    if table in INSTITUTIONAL_COST_SHARE:
        money = ["CLM_PMT_AMT", *INSTITUTIONAL_COST_SHARE[table]]
        revenue = {c: "date" if c == "REV_CNTR_DT" else "money" for c in REVENUE_LINE_COLUMNS if c != "HCPCS_CD"}
        return {"CLM_FROM_DT": "date", **dict.fromkeys(money, "money"), **(revenue if table == "outpatient" else {})}
    spec = LINE_FILE_COLUMNS[table]
    number = {} if table == "pde" else {"LINE_NUM": "int"}
    return {**number, spec.date: "date", spec.paid: "money", spec.allowed: "money"}


def unread_cells(sources: Mapping[str, DataFrame], table: str) -> DataFrame:
    """Cells of one table by column and problem: counted in one pass, with one row per task to shuffle."""
    kinds = typed_columns(table)
    found = sources[table].select(*[problem_of(c, kind).alias(c) for c, kind in kinds.items()])
    counts = [(c, problem) for c, kind in kinds.items() for problem in PROBLEMS[kind]]
    summed = found.agg(*[F.count_if(F.col(c) == problem).alias(f"n{k}") for k, (c, problem) in enumerate(counts)])
    rows = ", ".join(f"'{c}', '{problem}', n{k}" for k, (c, problem) in enumerate(counts))
    return summed.select(F.lit(table).alias("table_name"), F.expr(f"stack({len(counts)}, {rows}) AS (column_name, problem, n)")).where("n > 0")


def repeated_person_years(beneficiary: DataFrame) -> DataFrame:
    """Enrollment rows whose person and year another row has: every one of them counts that person's spend once more."""
    year = F.expr("try_cast(nullif(trim(BENE_ENROLLMT_REF_YR), '') AS int)")
    repeated = (
        beneficiary.where("BENE_ID IS NOT NULL")
        .groupBy("BENE_ID", year.alias("yr"))
        .agg((F.count(F.lit(1)) - 1).alias("n"))
        .where("yr IS NOT NULL AND n > 0")
    )
    counted = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where("n > 0")
    return counted.select(
        F.lit("beneficiary").alias("table_name"), F.lit("BENE_ID, BENE_ENROLLMT_REF_YR").alias("column_name"),
        F.lit(REPEATED).alias("problem"), "n",
    )


def input_report(sources: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, column_name, problem and the number of cells (or rows); a source without problems has no rows.

    A month by an unknown name is reported and never fails a job; all other cells reported here fail a strict analysis, and
    count as blank in one that isn't, but for amounts with more than four decimals, which are rounded.
    """
    tables = ("beneficiary", *INSTITUTIONAL_COST_SHARE, *LINE_FILES)
    parts = [unread_cells(sources, t) for t in tables]
    return reduce(DataFrame.unionByName, [*parts, repeated_person_years(sources["beneficiary"])])
