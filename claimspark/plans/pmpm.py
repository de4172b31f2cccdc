"""Per member per month (PMPM) results from the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.config import StudyWindow
from claimspark.functions.numbers import annual_growth, exact_cents, growth_pct, ratio, round_half_up

PHARMACY = "Retail Pharmacy"


def year_months(mm_fact: DataFrame) -> DataFrame:
    return mm_fact.groupBy("yr").agg(F.sum("ab_ffs_mm").alias("ab_ffs_mm"), F.sum("partd_mm").alias("partd_mm"))


def pmpm_by_category(spend_fact: DataFrame, mm_fact: DataFrame) -> DataFrame:
    """Dollars, member months and PMPM per year and topline category.

    Retail pharmacy is divided by the months that also have Part D, everything else by all eligible months.
    """
    dollars = spend_fact.groupBy("yr", "service_category").agg(F.sum("allowed").alias("dollars"))
    months = F.when(F.col("service_category") == PHARMACY, F.col("partd_mm")).otherwise(F.col("ab_ffs_mm"))
    return (
        dollars.join(year_months(mm_fact), "yr")
        .withColumn("member_months", months)
        .select(
            "yr",
            "service_category",
            round_half_up("dollars", 0).alias("allowed"),
            "member_months",
            round_half_up(ratio("dollars", "member_months"), 2).alias("pmpm"),
        )
    )


def pmpm_total(by_category: DataFrame) -> DataFrame:
    """Medical, pharmacy and total PMPM per year with the growth of the total.

    Totals add the rounded category values. The window has no partition key: it runs over one row per year.
    """
    pharmacy = F.col("service_category") == PHARMACY
    years = by_category.groupBy("yr").agg(
        F.sum(F.when(~pharmacy, exact_cents("pmpm"))).alias("medical"),
        F.sum(F.when(pharmacy, exact_cents("pmpm"))).alias("rx"),
    )
    total = F.col("medical") + F.col("rx")
    previous = F.lag("total").over(Window.orderBy("yr"))
    return years.withColumn("total", total).select(
        "yr",
        round_half_up("medical", 2).alias("medical_pmpm"),
        round_half_up("rx", 2).alias("rx_pmpm"),
        round_half_up("total", 2).alias("total_pmpm"),
        round_half_up(growth_pct("total", previous), 1).alias("total_growth_pct"),
    )


def pmpm_growth(by_category: DataFrame, window: StudyWindow) -> DataFrame:
    """Growth of every category: against the year before, and per year since the base year.

    The compound rate starts from the category's first year but always counts years from ``window.base``, so a
    category that appears later gets a rate over too many years.
    """
    category = Window.partitionBy("service_category").orderBy("yr")
    previous, first = F.lag("pmpm").over(category), F.first("pmpm").over(category)
    since_base = F.lit(100.0) * annual_growth("pmpm", first, F.col("yr") - F.lit(window.base))
    return by_category.select(
        "yr",
        "service_category",
        "pmpm",
        round_half_up(growth_pct("pmpm", previous), 1).alias("yoy_growth_pct"),
        round_half_up(F.col("pmpm") - previous, 2).alias("yoy_change_pmpm"),
        F.when(F.col("yr") > window.base, round_half_up(since_base, 1)).alias(f"cagr_since_{window.base}_pct"),
    )
