"""Reconciliation report. Every check is a lazy DataFrame with the same six columns; the report is their union."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.config import StudyWindow
from claimspark.functions import codes
from claimspark.functions.numbers import number_text, ratio
from claimspark.plans.pmpm import PHARMACY, year_months
from claimspark.sources.text_tables import INSTITUTIONAL_COST_SHARE, LINE_FILES

# Names of the checks. The first and fourth are followed by the claim file.
ROWS_NAME = "Row count preserved: "
CATEGORY_NAME = "Every row gets a service category"
DOLLARS_NAME = "Categorized $ = standardized $"
SHARE_NAME = "Share of $ in an eligible month: "
MONTHS_NAME = "Monthly A+B FFS months vs annual summary fields"
REBUILD_NAME = "PMPM rebuilds from the fact tables"
WELLNESS_NAME = "Primary care Step 5 (wellness-visit filter) applied"
OFFICE_NAME = "Carrier office E&M visits (99202-99215) present"
DIALYSIS_NAME = "Outpatient $ from dialysis (90935) claims"
FACILITY_NAME = "Primary care facility claims (G0463 split billing, FQHC 77x)"

# Notes of the checks.
ROWS_NOTE = "Institutional files collapse to one row per CLM_ID; line files keep every line"
CATEGORY_NOTE = "Unmapped bill types would land in Other facility"
DOLLARS_NOTE = "Categorization must not add or drop dollars"
SHARE_NOTE = "Claims outside A+B FFS (or Part D) eligibility are excluded from PMPM"
MONTHS_NOTE = (
    "Annual fields count A and B separately (least of the two); monthly flags need both in the same month"
)
REBUILD_NOTE = "Dashboard/Tableau fact tables give the same PMPM as the SQL views"
WELLNESS_NOTE = "Synthetic carrier file has no wellness visits, so the rule would drop every physician; skipped"
OFFICE_NOTE = (
    "Office E&M visits are the core of the primary care definition; without them primary care share is understated"
)
DIALYSIS_NOTE = "Dialysis claims make up a large share of outpatient spend in the synthetic file"
FACILITY_NOTE = "Step 6 logic runs but the synthetic outpatient file only has bill type 13x and no G0463"


def _check(
    measured: DataFrame,
    number: int,
    name: str | Column,
    expected: str | Column,
    actual: Column,
    passed: Column | None,
    otherwise: str,
    note: str,
) -> DataFrame:
    """One report row per row of ``measured``; a test that is NULL counts as not passed."""
    status = F.lit(otherwise) if passed is None else F.when(passed, "PASS").otherwise(otherwise)
    return measured.select(
        F.lit(number).alias("id"),
        (F.lit(name) if isinstance(name, str) else name).alias("check_name"),
        (F.lit(expected) if isinstance(expected, str) else expected).alias("expected"),
        actual.alias("actual"),
        status.alias("status"),
        F.lit(note).alias("note"),
    )


def raw_row_counts(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct claims of institutional files and rows of line files, counted in the source tables themselves."""
    claims = reduce(
        DataFrame.unionByName,
        [sources[src].select(F.lit(src).alias("src"), F.col("CLM_ID").alias("clm_id")) for src in INSTITUTIONAL_COST_SHARE],
    )
    lines = reduce(DataFrame.unionByName, [sources[src].select(F.lit(src).alias("src")) for src in LINE_FILES])
    return (
        claims.groupBy("src")
        .agg(F.countDistinct("clm_id").alias("n"))
        .unionByName(lines.groupBy("src").agg(F.count("*").alias("n")))
    )


def claim_sums(claim_lines: DataFrame) -> DataFrame:
    """Rows and dollars of the standardized table by claim file."""
    return claim_lines.groupBy("src").agg(F.count("*").alias("kept"), F.sum("allowed").alias("allowed"))


def category_sums(categorized: DataFrame, window: StudyWindow) -> DataFrame:
    """Of the categorized table by claim file: rows without a category, dollars, and dollars of the study years."""
    unmapped = F.col("service_category").isNull() | (F.col("subcategory") == "Other facility")
    return categorized.groupBy("src").agg(
        F.count_if(unmapped).alias("unmapped"),
        F.sum("allowed").alias("allowed"),
        # A file without a row in the study years has no share to report.
        F.max(window.contains()).alias("in_study"),
        F.sum(F.when(window.contains(), F.col("allowed"))).alias("study_allowed"),
    )


def spend_sums(spend: DataFrame, outpatient: DataFrame, window: StudyWindow) -> DataFrame:
    """Of spend by claim file: office visits, dollars of the study years, and those of claims with a dialysis line.

    Spend is read once. Rows are added up per file and, for outpatient claims of the study years, per claim before the
    shuffle; so only those claims travel to the join with the list of dialysis claims, which can be large and is merged:
    by the few bytes that a claim number takes in its file Spark would broadcast it.
    """
    of_study = (F.col("src") == "outpatient") & window.contains()
    visits = (F.col("src") == "carrier") & F.col("hcpcs_cd").between(*codes.OFFICE_EM_RANGE)
    claims = (
        spend.withColumn("claim", F.when(of_study, F.col("clm_id")))
        .groupBy("src", "claim")
        .agg(
            F.count_if(visits).alias("office_visits"),
            F.sum(F.when(window.contains(), F.col("allowed"))).alias("study_allowed"),
        )
    )
    dialysis = (
        outpatient.where(F.col("HCPCS_CD") == codes.DIALYSIS_CODE)
        .select(F.col("CLM_ID").alias("claim"))
        .distinct()
        .withColumn("dialysis_claim", F.lit(True))
    )
    return (
        claims.join(dialysis.hint("merge"), "claim", "left")
        .groupBy("src")
        .agg(
            F.sum("office_visits").alias("office_visits"),
            F.sum("study_allowed").alias("study_allowed"),
            F.sum(F.when(F.col("dialysis_claim"), F.col("study_allowed"))).alias("dialysis"),
        )
    )


def check_row_counts(sources: Mapping[str, DataFrame], of_claims: DataFrame) -> DataFrame:
    both = raw_row_counts(sources).join(of_claims, "src")
    return _check(
        both,
        1,
        F.concat(F.lit(ROWS_NAME), "src"),
        F.col("n").cast("string"),
        F.col("kept").cast("string"),
        F.col("n") == F.col("kept"),
        "FAIL",
        ROWS_NOTE,
    )


def check_unmapped(of_categories: DataFrame) -> DataFrame:
    counted = of_categories.agg(F.coalesce(F.sum("unmapped"), F.lit(0)).alias("n"))
    return _check(
        counted, 2, CATEGORY_NAME, "0", F.col("n").cast("string"), F.col("n") == 0, "FAIL", CATEGORY_NOTE
    )


def check_dollars_preserved(of_claims: DataFrame, of_categories: DataFrame) -> DataFrame:
    """The dollars of two tables that were written one after the other."""
    before = of_claims.agg(F.sum("allowed").alias("before"))
    both = before.withColumn("after", of_categories.agg(F.sum("allowed")).scalar())
    return _check(
        both,
        3,
        DOLLARS_NAME,
        number_text("before", 0),
        number_text("after", 0),
        F.abs(F.col("before") - F.col("after")) < 1,
        "FAIL",
        DOLLARS_NOTE,
    )


def check_eligible_share(of_categories: DataFrame, of_spend: DataFrame) -> DataFrame:
    """A file with nothing eligible keeps its row: the share is NULL and the check is flagged."""
    total = of_categories.where("in_study").select("src", F.col("study_allowed").alias("total"))
    both = total.join(of_spend.select("src", F.col("study_allowed").alias("kept")), "src", "left")
    share = ratio("kept", "total")
    return _check(
        both,
        4,
        F.concat(F.lit(SHARE_NAME), "src"),
        ">= 90%",
        F.concat(number_text(ratio(F.lit(100) * F.col("kept"), "total"), 1), F.lit("%")),
        share >= 0.9,
        "FLAG",
        SHARE_NOTE,
    )


def check_monthly_vs_annual(beneficiary: DataFrame, mm_fact: DataFrame, window: StudyWindow) -> DataFrame:
    """The smaller of the two annual counts is picked by comparison, not by ``least``: an unknown Part A count falls
    back to Part B, an unknown Part B count leaves the person out."""
    hi, smi = F.col("BENE_HI_CVRAGE_TOT_MONS").cast("int"), F.col("BENE_SMI_CVRAGE_TOT_MONS").cast("int")
    annual = beneficiary.where(window.contains(F.col("BENE_ENROLLMT_REF_YR").cast("int"))).agg(
        F.sum(F.when(hi < smi, hi).otherwise(smi)).alias("annual")
    )
    monthly = mm_fact.agg(F.coalesce(F.sum("ab_ffs_mm"), F.lit(0))).scalar()
    both = annual.withColumn("monthly", monthly)
    return _check(
        both,
        5,
        MONTHS_NAME,
        F.col("annual").cast("string"),
        F.col("monthly").cast("string"),
        ratio(F.abs(F.col("monthly") - F.col("annual")), "annual") < 0.1,
        "FLAG",
        MONTHS_NOTE,
    )


def rebuilt_pmpm(spend_fact: DataFrame, mm_fact: DataFrame) -> DataFrame:
    """PMPM straight from the facts, unrounded."""
    months = F.max(F.when(F.col("service_category") == PHARMACY, F.col("partd_mm")).otherwise(F.col("ab_ffs_mm")))
    return (
        spend_fact.join(year_months(mm_fact), "yr")
        .groupBy("yr", "service_category")
        .agg(ratio(F.sum("allowed"), months).alias("rebuilt"))
    )


def check_pmpm_rebuild(by_category: DataFrame, spend_fact: DataFrame, mm_fact: DataFrame) -> DataFrame:
    worst = (
        by_category.join(rebuilt_pmpm(spend_fact, mm_fact), ["yr", "service_category"])
        .agg(F.max(F.abs(F.col("pmpm") - F.col("rebuilt"))).alias("d"))
    )
    return _check(worst, 6, REBUILD_NAME, "0.00", number_text("d", 2), F.col("d") < 0.01, "FAIL", REBUILD_NOTE)


def check_wellness(wellness_npi: DataFrame) -> DataFrame:
    counted = wellness_npi.agg(F.count("*").alias("n"))
    return _check(
        counted,
        7,
        WELLNESS_NAME,
        "wellness visits > 0",
        F.concat(F.col("n").cast("string"), F.lit(" NPIs with wellness visits")),
        F.col("n") > 0,
        "FLAG",
        WELLNESS_NOTE,
    )


def check_office_em(of_spend: DataFrame) -> DataFrame:
    counted = of_spend.agg(F.coalesce(F.sum("office_visits"), F.lit(0)).alias("n"))
    return _check(counted, 8, OFFICE_NAME, "> 0", F.col("n").cast("string"), F.col("n") > 0, "FLAG", OFFICE_NOTE)


def dialysis_dollars(of_spend: DataFrame) -> DataFrame:
    """Outpatient dollars of claims with a dialysis line, and of all claims."""
    return of_spend.where(F.col("src") == "outpatient").agg(
        F.sum("dialysis").alias("dialysis"), F.sum("study_allowed").alias("total")
    )


def check_dialysis_share(of_spend: DataFrame) -> DataFrame:
    share = ratio(F.lit(100) * F.col("dialysis"), "total")
    return _check(
        dialysis_dollars(of_spend),
        9,
        DIALYSIS_NAME,
        "informational",
        F.concat(number_text(share, 1), F.lit("%")),
        None,
        "FLAG",
        DIALYSIS_NOTE,
    )


def check_pc_facility(split: DataFrame, fqhc: DataFrame) -> DataFrame:
    counted = split.unionByName(fqhc).agg(F.count("*").alias("n"))
    return _check(counted, 10, FACILITY_NAME, "> 0", F.col("n").cast("string"), F.col("n") > 0, "FLAG", FACILITY_NOTE)


def validation(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
