"""Service categories and the eligible part of spend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions import labels
from claimspark.operators.facts import CELL


def with_month(claim_lines: DataFrame) -> DataFrame:
    """Add the year and month a row was incurred in; both NULL without a date."""
    return claim_lines.withColumns({"yr": F.year("svc_dt"), "mo": F.month("svc_dt")})


#: Columns with a small code for each label of a row.
CODES = ("category_cd", "subcategory_cd", "service_cd")
CATEGORY_COLUMNS = ("service_category", "subcategory", "type_of_service", "yr", "mo")


def categorized(claim_lines: DataFrame) -> DataFrame:
    """Every standardized row with year, month and small codes for its topline category, subcategory and type of service.

    Spend is built from this table, and the checks on categories read it; codes instead of labels make it cheap to
    shuffle.
    """
    return with_month(claim_lines).withColumns(
        {
            "category_cd": labels.service_category("src", "bill_type2", labels.CATEGORY_LABELS),
            "subcategory_cd": labels.subcategory("src", "bill_type2", "pos_cd", labels.SUBCATEGORY_LABELS),
            "service_cd": labels.type_of_service("src", "betos_cd", labels.SERVICE_LABELS),
        }
    )


def labelled(rows: DataFrame, *more: str) -> DataFrame:
    """``categorized`` rows with the labels their codes stand for, year, month and the columns ``more``."""
    own = [c for c in rows.columns if c not in (*CODES, *CATEGORY_COLUMNS, *more)]
    return rows.withColumns(
        {
            "service_category": labels.label_of("category_cd", labels.CATEGORY_LABELS),
            "subcategory": labels.label_of("subcategory_cd", labels.SUBCATEGORY_LABELS),
            "type_of_service": labels.label_of("service_cd", labels.SERVICE_LABELS),
        }
    ).select(*own, *CATEGORY_COLUMNS, *more)


def claim_line_cat(claim_lines: DataFrame) -> DataFrame:
    """Every standardized row with its category, subcategory, type of service, year and month."""
    return labelled(categorized(claim_lines))


def paid_by_medicare_first(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("medicare_primary") & F.col("medicare_paid"))


def eligibility_join(claims: DataFrame, member_months: DataFrame) -> DataFrame:
    """Rows incurred in a Part A+B fee-for-service month of that person, fills in one with Part D as well.

    Plan at scale: both sides shuffle once on person, year and month, a key fine enough to spread one person over
    their months. Only eligible months and the columns used travel on the month side, and rows without a person or a
    date are dropped before the shuffle by the null filter Spark derives from the inner join. A single month
    that holds a large share of all rows is split by adaptive skew handling: the month side has one row per key, so
    repeating it for every split is cheap. The Part D test stays a condition of the same join.

    Both sides are asked to be merged. Spark would otherwise judge the months by their files, in which twelve like rows
    of a person take a byte or so each, and broadcast millions of them through the driver.
    """
    claims = claims.alias("c")
    months = (
        member_months.where("ab_ffs").select("bene_id", "yr", "mo", "partd", *CELL).alias("m")
    )
    on = [F.col(f"c.{key}") == F.col(f"m.{key}") for key in ("bene_id", "yr", "mo")]
    covered = (F.col("c.src") != "pde") | F.col("m.partd")
    return claims.join(months.hint("merge"), [*on, covered]).select("c.*", *[f"m.{c}" for c in CELL])


def eligible_spend(rows: DataFrame, member_months: DataFrame) -> DataFrame:
    """Eligible rows Medicare paid as primary, of ``categorized`` rows, with category and the demographics of the month they
    fall in. Codes travel through the join; labels take their place after it."""
    return labelled(eligibility_join(paid_by_medicare_first(rows), member_months), *CELL)


def spend(claim_lines: DataFrame, member_months: DataFrame) -> DataFrame:
    return eligible_spend(categorized(claim_lines), member_months)
