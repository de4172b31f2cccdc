"""Enrollment to member months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions import labels
from claimspark.functions.numbers import ratio, round_half_up
from claimspark.functions.parsing import parse_int
from claimspark.sources.text_tables import MONTHLY_FAMILIES, MONTHS


def person_years(beneficiary: DataFrame, strict: bool = True) -> DataFrame:
    """Demographics of a person-year next to its monthly columns; worked out here, once instead of twelve times."""
    monthly = [f"{family}_{mm}" for family in MONTHLY_FAMILIES for mm in MONTHS]
    parsed = beneficiary.select(
        F.col("BENE_ID").alias("bene_id"),
        parse_int("BENE_ENROLLMT_REF_YR", strict).alias("yr"),
        parse_int("AGE_AT_END_REF_YR", strict).alias("age"),
        labels.sex_label("SEX_IDENT_CD").alias("sex"),
        *monthly,
    )
    return parsed.select("bene_id", "yr", labels.age_band("age").alias("age_band"), "sex", *monthly)


def unpivot_months(beneficiary: DataFrame, strict: bool = True) -> DataFrame:
    """One row per person, year and month from the four aligned groups of twelve columns.

    ``stack`` generates the rows inside the scan stage: no join with a month table and no shuffle.
    """
    cells = ", ".join(
        f"{number}, {', '.join(f'{family}_{mm}' for family in MONTHLY_FAMILIES)}"
        for number, mm in enumerate(MONTHS, start=1)
    )
    return person_years(beneficiary, strict).selectExpr(
        "bene_id",
        "yr",
        "age_band",
        "sex",
        f"stack({len(MONTHS)}, {cells}) AS (mo, buyin_cd, hmo_cd, ptd_cd, dual_cd)",
    )


def entitled_months(months: DataFrame) -> DataFrame:
    """Months with a buy-in code; months before entitlement or after death have none."""
    return months.where(F.col("buyin_cd").isNotNull())


def member_month(beneficiary: DataFrame, strict: bool = True) -> DataFrame:
    """Entitled months with eligibility flags and demographics."""
    return entitled_months(unpivot_months(beneficiary, strict)).select(
        "bene_id",
        "yr",
        "mo",
        labels.in_part_ab_ffs("buyin_cd", "hmo_cd").alias("ab_ffs"),
        labels.in_part_d("ptd_cd").alias("partd"),
        labels.is_dual("dual_cd").alias("dual"),
        "age_band",
        "sex",
    )


def member_months_by_year(member_months: DataFrame) -> DataFrame:
    """Month counts, average members and the dual share of every enrollment year."""
    counts = member_months.groupBy("yr").agg(
        F.count_if("ab_ffs").alias("ab_ffs_member_months"),
        F.count_if(F.col("ab_ffs") & F.col("partd")).alias("ab_ffs_partd_member_months"),
        F.count_if(F.col("ab_ffs") & F.col("dual")).alias("dual_months"),
    )
    months = F.col("ab_ffs_member_months")
    return counts.select(
        "yr",
        "ab_ffs_member_months",
        "ab_ffs_partd_member_months",
        round_half_up(ratio(months, F.lit(12.0)), 1).alias("avg_ab_ffs_members"),
        round_half_up(ratio(F.col("dual_months") * F.lit(100.0), months), 1).alias("pct_dual"),
    )
