"""Primary care spending: professional lines that qualify, and the facility lines that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.config import StudyWindow
from claimspark.functions import codes
from claimspark.functions.numbers import ratio, round_half_up
from claimspark.functions.parsing import MONEY, bill_type, parse_claim_date, parse_money
from claimspark.sources.code_lists import CodeLists


def pc_professional(spend: DataFrame, lists: CodeLists) -> DataFrame:
    """Steps 1 to 4: primary payer, service code, specialty and place of service, each a map-side join with a list.

    ``is_physician`` is carried along for Step 5, which saves a second look at the specialty list.
    """
    services = lists.service_codes.where(F.col("claim_type") == codes.PROFESSIONAL_OR_FACILITY)
    specialties = lists.specialties.select(F.col("prvdr_spclty").alias("spclty"), "is_physician")
    lines = spend.where((F.col("src") == "carrier") & F.col("medicare_primary"))
    joined = (
        lines.join(services.select("hcpcs_cd", "service_group"), "hcpcs_cd")
        .join(specialties, "spclty")
        .join(lists.places.select("pos_cd"), "pos_cd")
    )
    return joined.select(*spend.columns, "service_group", "is_physician")


def pc_wellness_npi(spend: DataFrame) -> DataFrame:
    """Clinicians with a wellness visit in any year; an unknown clinician counts as one row."""
    visits = spend.where((F.col("src") == "carrier") & F.col("hcpcs_cd").isin(codes.WELLNESS_CODES))
    return visits.select("rndrng_npi").distinct()


def pc_step5(professional: DataFrame, wellness_npi: DataFrame) -> DataFrame:
    """Step 5: keep specialties marked ``'0'`` (not physicians), and of all others, however a list marks them, the
    clinicians with a wellness visit. With no wellness visit in the data at all the rule does not apply and every line
    stays.

    Only lines of those others with a known clinician need the lookup. All the rest get one of many keys that match nothing, so
    that missing clinicians do not meet in one partition. A left join rather than an ``IN`` under ``OR`` lets adaptive
    skew handling split a clinician with very many lines; for the same reason the key is a new value on both sides,
    which gives the clinician list a shuffle of its own after the aggregation that made it distinct.

    The join is asked to be a merge, as is that of Step 6: the list is a number in a file for each clinician, by whose few
    bytes Spark would broadcast millions of them through the driver.
    """
    exempt = F.col("is_physician").eqNullSafe("0")
    testable = ~exempt & F.col("rndrng_npi").isNotNull()
    nowhere = F.concat(F.lit("#"), F.xxhash64("clm_id", "line_num", "bene_id", "svc_dt", "allowed").cast("string"))
    lines = professional.withColumn(
        "npi_key", F.when(testable, F.concat(F.lit("="), "rndrng_npi")).otherwise(nowhere)
    )
    known = wellness_npi.where(F.col("rndrng_npi").isNotNull()).select(
        F.concat(F.lit("="), "rndrng_npi").alias("npi_key"), F.lit(True).alias("has_wellness")
    )
    rule_off = wellness_npi.select(F.count("*")).scalar() == 0
    kept = lines.join(known.hint("merge"), "npi_key", "left").where(
        rule_off | exempt | F.col("has_wellness")
    )
    return kept.select(*[c for c in professional.columns if c != "is_physician"])


def pc_outpatient_line(outpatient: DataFrame, strict: bool = True) -> DataFrame:
    """Outpatient revenue lines Step 6 looks at, with the line's own date and allowed dollars."""
    wanted = (F.col("HCPCS_CD") == codes.CLINIC_VISIT_CODE) | (F.col("CLM_FAC_TYPE_CD") == codes.CLINIC_FACILITY_TYPE)
    return outpatient.where(wanted).select(
        F.col("BENE_ID").alias("bene_id"),
        F.col("HCPCS_CD").alias("hcpcs_cd"),
        bill_type().alias("bill_type2"),
        parse_claim_date("REV_CNTR_DT", strict).alias("svc_dt"),
        (
            parse_money("REV_CNTR_PMT_AMT_AMT", strict)
            + parse_money("REV_CNTR_CASH_DDCTBL_AMT", strict)
            + parse_money("REV_CNTR_COINSRNC_WGE_ADJSTD_C", strict)
        )
        .cast(MONEY)
        .alias("allowed"),
    )


def pc_facility_split(outpatient_lines: DataFrame, step5: DataFrame) -> DataFrame:
    """Step 6a: the facility half of a hospital-based office visit, same person and day.

    Visits are reduced to distinct person-days first. The year is kept among their columns although the date implies
    it: the aggregation is then partitioned differently from the join, each side of the join has a shuffle of its own,
    and adaptive skew handling can split a person-day with very many facility lines.
    """
    visits = (
        step5.where(F.col("pos_cd").isin(*codes.HOSPITAL_PLACES) & F.col("hcpcs_cd").between(*codes.OFFICE_VISIT_RANGE))
        .select("bene_id", "svc_dt", "yr")
        .distinct()
    )
    facility = outpatient_lines.where(
        (F.col("hcpcs_cd") == codes.CLINIC_VISIT_CODE) & (F.col("bill_type2") == codes.HOSPITAL_OUTPATIENT_BILL)
    )
    return facility.join(visits.hint("merge"), ["bene_id", "svc_dt"], "left_semi").select("bene_id", "svc_dt", "allowed")


def pc_fqhc(outpatient_lines: DataFrame, lists: CodeLists) -> DataFrame:
    """Step 6b: clinic claims with a listed service code; here the facility-only code counts too."""
    return (
        outpatient_lines.where(F.col("bill_type2") == codes.FQHC_BILL)
        .join(lists.service_codes.select("hcpcs_cd"), "hcpcs_cd")
        .select("bene_id", "svc_dt", "allowed")
    )


def primary_care_by_service(step5: DataFrame, window: StudyWindow) -> DataFrame:
    """Services and dollars per year and service group."""
    return (
        step5.where(window.contains())
        .groupBy("yr", "service_group")
        .agg(F.count("*").alias("services"), round_half_up(F.sum("allowed"), 2).alias("allowed"))
    )


def facility_lines(split: DataFrame, fqhc: DataFrame) -> DataFrame:
    """Both kinds of Step 6 lines by the year of the line."""
    return split.unionByName(fqhc).select(F.year("svc_dt").alias("yr"), "allowed")


def primary_care_by_year(
    step5: DataFrame, split: DataFrame, fqhc: DataFrame, spend_fact: DataFrame, mm_fact: DataFrame, window: StudyWindow
) -> DataFrame:
    """Primary care dollars per year, per member month, and as a share of medical and of all spending.

    Facility lines add dollars but no services. Years without primary care keep a row with 0.
    """
    professional = (
        step5.where(window.contains())
        .groupBy("yr")
        .agg(F.sum("allowed").alias("professional"), F.count("*").alias("services"))
    )
    facility = facility_lines(split, fqhc).groupBy("yr").agg(F.sum("allowed").alias("facility"))
    total = spend_fact.groupBy("yr").agg(
        F.sum(F.when(F.col("service_category") != "Retail Pharmacy", F.col("allowed"))).alias("medical"),
        F.sum("allowed").alias("total"),
    )
    months = mm_fact.groupBy("yr").agg(F.sum("ab_ffs_mm").alias("mm"))
    joined = total.join(months, "yr").join(professional, "yr", "left").join(facility, "yr", "left")
    dollars = F.coalesce("professional", F.lit(0)) + F.coalesce("facility", F.lit(0))
    return joined.withColumn("dollars", dollars).select(
        "yr",
        round_half_up("dollars", 0).alias("primary_care_allowed"),
        F.coalesce("services", F.lit(0).cast("bigint")).alias("primary_care_services"),
        round_half_up(ratio("dollars", "mm"), 2).alias("primary_care_pmpm"),
        round_half_up(ratio(F.lit(100) * F.col("dollars"), "medical"), 2).alias("pct_of_medical"),
        round_half_up(ratio(F.lit(100) * F.col("dollars"), "total"), 2).alias("pct_of_total"),
    )
