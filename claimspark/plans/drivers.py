"""What drives the change: volume against price, category contributions, utilization, and slices of the facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.numbers import annual_growth, exact_cents, ratio, round_half_up
from claimspark.operators.facts import CELL


def _in_year(year: int, value: Column) -> Column:
    return F.max(F.when(F.col("yr") == year, value))


def inpatient_rates(ip_fact: DataFrame, mm_fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stays, dollars and member months per year (and ``by`` columns) with stays per member month and cost per stay."""
    keys = ["yr", *by]
    stays = ip_fact.groupBy(*keys).agg(F.sum("stays").alias("stays"), F.sum("allowed").alias("allowed"))
    months = mm_fact.groupBy(*keys).agg(F.sum("ab_ffs_mm").alias("member_months"))
    return stays.join(months, keys).select(
        *keys,
        "stays",
        "allowed",
        "member_months",
        ratio("stays", "member_months").alias("stays_per_month"),
        ratio("allowed", "stays").alias("cost_per_stay"),
    )


def volume_price_split(
    ip_fact: DataFrame, mm_fact: DataFrame, first_year: int, last_year: int, by: Sequence[str] = ()
) -> DataFrame:
    """Midpoint split of the change in inpatient PMPM between two years; both parts add up to the change.

    Volume is the change in stays per member month at the average cost per stay; price is the change in cost per stay
    at the average rate of stays.
    """
    rates = inpatient_rates(ip_fact, mm_fact, by).where(F.col("yr").isin(first_year, last_year))
    ends = rates.groupBy(*by).agg(
        *[
            _in_year(year, F.col(name)).alias(f"{end}_{name}")
            for end, year in (("first", first_year), ("last", last_year))
            for name in ("stays_per_month", "cost_per_stay")
        ]
    )
    rate0, rate1 = F.col("first_stays_per_month"), F.col("last_stays_per_month")
    cost0, cost1 = F.col("first_cost_per_stay"), F.col("last_cost_per_stay")
    return ends.select(
        *by,
        F.lit(first_year).alias("first_year"),
        F.lit(last_year).alias("last_year"),
        (rate0 * cost0).alias("first_pmpm"),
        (rate1 * cost1).alias("last_pmpm"),
        ((rate1 - rate0) * (cost0 + cost1) / 2).alias("volume_effect"),
        ((cost1 - cost0) * (rate0 + rate1) / 2).alias("price_effect"),
        (rate1 * cost1 - rate0 * cost0).alias("pmpm_change"),
    )


def utilization_rate(ip_fact: DataFrame, mm_fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Inpatient stays per 1,000 members a year and allowed dollars per stay."""
    return inpatient_rates(ip_fact, mm_fact, by).select(
        "yr",
        *by,
        "stays",
        "member_months",
        ratio(F.col("stays") * F.lit(12000.0), "member_months").alias("stays_per_1000"),
        F.col("cost_per_stay").alias("allowed_per_stay"),
    )


def growth_contribution(by_category: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Each category's share of first-year PMPM and of the change between two years.

    A category missing in one of the years counts as 0 there. The window spans one row per category.
    """
    ends = (
        by_category.where(F.col("yr").isin(first_year, last_year))
        .groupBy("service_category")
        .agg(
            F.coalesce(_in_year(first_year, exact_cents("pmpm")), exact_cents(F.lit(0))).alias("first_pmpm"),
            F.coalesce(_in_year(last_year, exact_cents("pmpm")), exact_cents(F.lit(0))).alias("last_pmpm"),
        )
        .withColumn("pmpm_change", F.col("last_pmpm") - F.col("first_pmpm"))
    )
    everything = Window.partitionBy()
    return ends.select(
        "service_category",
        *[round_half_up(c, 2).alias(c) for c in ("first_pmpm", "last_pmpm", "pmpm_change")],
        ratio(F.lit(100) * F.col("first_pmpm"), F.sum("first_pmpm").over(everything)).alias("pct_of_first"),
        ratio(F.lit(100) * F.col("pmpm_change"), F.sum("pmpm_change").over(everything)).alias("pct_of_change"),
    )


def average_annual_growth(totals: DataFrame) -> DataFrame:
    """Average growth per year of total PMPM from the first to the last year on file, one row."""
    ends = totals.agg(
        F.min("yr").alias("first_year"),
        F.max("yr").alias("last_year"),
        F.min_by("total_pmpm", "yr").alias("first_pmpm"),
        F.max_by("total_pmpm", "yr").alias("last_pmpm"),
    )
    return ends.select(
        "*",
        (
            F.lit(100.0) * annual_growth("last_pmpm", "first_pmpm", F.col("last_year") - F.col("first_year"))
        ).alias("annual_growth_pct"),
    )


def fact_slice(fact: DataFrame, filters: Mapping[str, object], by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add up a fact table under equality filters on any of its columns."""
    kept = fact
    for column, value in filters.items():
        kept = kept.where(F.col(column) == value)
    return kept.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])


def members_slice(members_fact: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Distinct members per year under the same filters: read from the one combination that matches, never added up."""
    kept = members_fact
    for column in CELL:
        kept = kept.where(F.col(column) == filters.get(column, "all"))
    return kept.select("yr", "members")
