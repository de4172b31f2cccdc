"""Fact tables: year by category by demographic cell. Later results add these up instead of reading rows again."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.config import StudyWindow
from claimspark.functions import codes

CELL = ("dual", "age_band", "sex")


def mm_fact(member_months: DataFrame, window: StudyWindow) -> DataFrame:
    """Member months per year and cell: all Part A+B fee-for-service ones, and those that also have Part D."""
    return (
        member_months.where(window.contains())
        .groupBy("yr", *CELL)
        .agg(
            F.count_if("ab_ffs").alias("ab_ffs_mm"),
            F.count_if(F.col("ab_ffs") & F.col("partd")).alias("partd_mm"),
        )
    )


def spend_fact(spend: DataFrame, window: StudyWindow) -> DataFrame:
    """Dollars, rows and distinct people per year, category and cell.

    Sums and the distinct count share one plan: rows are first combined per group and person, so neither a large group
    nor a person with very many rows travels as single rows.
    """
    return (
        spend.where(window.contains())
        .withColumn("type_of_service", F.coalesce("type_of_service", F.lit("n/a")))
        .groupBy("yr", "service_category", "subcategory", "type_of_service", *CELL)
        .agg(
            F.sum("allowed").alias("allowed"),
            F.sum("paid").alias("paid"),
            F.count("*").alias("n_rows"),
            F.countDistinct("bene_id").alias("n_benes"),
        )
    )


def ip_fact(spend: DataFrame, window: StudyWindow) -> DataFrame:
    """Inpatient stays (one claim is one stay) and dollars per year and cell."""
    return (
        spend.where((F.col("service_category") == "Inpatient Hospital") & window.contains())
        .groupBy("yr", *CELL)
        .agg(F.count("*").alias("stays"), F.sum("allowed").alias("allowed"))
    )


def pc_fact(pc_step5: DataFrame, window: StudyWindow) -> DataFrame:
    """Primary care dollars and services per year, service group and cell."""
    return (
        pc_step5.where(window.contains())
        .groupBy("yr", "service_group", *CELL)
        .agg(F.sum("allowed").alias("allowed"), F.count("*").alias("services"))
    )


# The labels of a cell in the order of their numbers.
BANDS = ("<65", "65-74", "75-84", "85+")
SEXES = (*codes.SEX_LABELS.values(), codes.UNKNOWN_SEX)
#: All cells a person can be in, in the order of their bits.
CELLS = tuple((dual, band, sex) for dual in (False, True) for band in BANDS for sex in SEXES)


def cell_number() -> Column:
    """The place of a row's cell in ``CELLS``, put together from the numbers of its three labels. A label that is none
    fails the job."""

    def number(name: str, labels: Sequence[str]) -> str:
        whens = " ".join(f"WHEN '{label}' THEN {k}" for k, label in enumerate(labels))
        unknown = f"cast(raise_error(concat('no such {name}: ', coalesce({name}, 'NULL'))) AS int)"
        return f"CASE {name} {whens} ELSE {unknown} END"

    dual = "coalesce(cast(dual AS int), cast(raise_error('no such dual: NULL') AS int))"
    return F.expr(f"{len(BANDS) * len(SEXES)} * {dual} + {len(SEXES)} * {number('age_band', BANDS)} + {number('sex', SEXES)}")


def members_fact(member_months: DataFrame, window: StudyWindow) -> DataFrame:
    """Distinct people per year for every combination of the cell columns, ``all`` where a column is left open.

    People move between cells, so these counts do not add up and each combination is counted by itself. Expanding every
    person to eight grouping sets would shuffle eight times the people. Instead a person-year is reduced to a number with
    one bit per cell they were in, and people are counted per number. The grouping sets then work on those few numbers:
    each counts once, with all its people, in each combination it touches. A label that is no cell fails the job.
    """
    people = (
        member_months.where(F.col("ab_ffs") & window.contains())
        .select("yr", "bene_id", F.call_function("shiftleft", F.lit(1).cast("bigint"), cell_number()).alias("bit"))
        .groupBy("yr", "bene_id")
        .agg(F.bit_or("bit").alias("profile"))
    )
    # A person without an id makes its combinations appear but is not counted, like any distinct count.
    profiles = people.groupBy("yr", "profile").agg(F.count("bene_id").alias("n"))
    cells = ", ".join(
        f"named_struct('bit', {1 << bit}L, 'dual', {str(dual).lower()}, 'age_band', '{band}', 'sex', '{sex}')"
        for bit, (dual, band, sex) in enumerate(CELLS)
    )
    touched = profiles.select("*", F.expr(f"inline(filter(array({cells}), c -> c.bit & profile <> 0))"))
    combinations_of = [
        ["yr", "profile", "n", *kept] for size in range(len(CELL), -1, -1) for kept in combinations(CELL, size)
    ]
    opened = [F.grouping(c).alias(f"{c}_open") for c in CELL]
    once = touched.groupingSets(combinations_of, "yr", "profile", "n", *CELL).agg(*opened)
    counted = once.groupBy("yr", *CELL, *[f"{c}_open" for c in CELL]).agg(F.sum("n").alias("members"))
    return counted.select(
        "yr",
        *[F.when(F.col(f"{c}_open") == 1, "all").otherwise(F.col(c).cast("string")).alias(c) for c in CELL],
        "members",
    )
