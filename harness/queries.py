"""One query per operator, each over the whole given tables.

Money is rounded to cents and dates become text here, at the edge, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark import CodeLists, CostDrivers
from claimspark.functions import codes, labels
from claimspark.functions.numbers import (
    annual_growth,
    growth_pct,
    number_text,
    ratio,
    round_half_up,
)
from claimspark.functions.parsing import bill_type, parse_claim_date, parse_int, parse_money
from claimspark.operators import claim_lines, facts, member_months, primary_care, service_categories
from claimspark.operators.facts import CELL
from claimspark.plans import drivers, pmpm, validation
from claimspark.sources.store import TableStore, export_csv, stack_facts, write_table
from claimspark.sources.text_tables import INSTITUTIONAL_COST_SHARE, Sources
from harness.session import ensure_shared_folder
from harness.tables import FILE_NUMBERS, disenrolled, soiled, source_tables

_open: dict[tuple[str, str], CostDrivers] = {}


def open_tables(spark: SparkSession, sf_dir: str) -> CostDrivers:
    """The analysis over one data folder; shared tables are written once per application and folder."""
    key = (spark.conf.get("spark.app.id", "session"), sf_dir.rstrip("/"))
    if key not in _open:
        ensure_shared_folder(spark)
        store = TableStore.for_session(spark, key[1].strip("/").replace("/", "_"))
        _open[key] = CostDrivers(source_tables(spark, key[1], store), CodeLists.builtin(spark), store=store)
    return _open[key]


Query = Callable[[CostDrivers], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register under the function's name; ``_query`` at the end keeps it apart from a library function."""
    QUERIES[build.__name__.removesuffix("_query")] = build
    return build


def cents(c: Column | str) -> Column:
    return round_half_up(c, 2)


def money_sum(name: str) -> Column:
    return cents(F.sum(name)).alias(name)


def plain(df: DataFrame) -> DataFrame:
    """Dates as text, amounts and doubles rounded to cents."""
    shown = []
    for f in df.schema.fields:
        c = F.col(f.name)
        kind = f.dataType.simpleString()
        amount = kind == "double" or kind.startswith("decimal")
        shown.append((c.cast("string") if kind == "date" else cents(c) if amount else c).alias(f.name))
    return df.select(*shown)


def each_file(cd: CostDrivers, part: Callable[[str, DataFrame], DataFrame], files=FILE_NUMBERS) -> DataFrame:
    return reduce(DataFrame.unionByName, [part(src, cd.sources[src]) for src in files])


# Column names of the raw date, paid and allowed cells per file.
_RAW_CELLS = {
    **{src: ("CLM_ID", "CLM_FROM_DT", "CLM_PMT_AMT", "CLM_PMT_AMT") for src in INSTITUTIONAL_COST_SHARE},
    "carrier": ("CLM_ID", "LINE_1ST_EXPNS_DT", "LINE_NCH_PMT_AMT", "LINE_ALOWD_CHRG_AMT"),
    "dme": ("CLM_ID", "LINE_1ST_EXPNS_DT", "LINE_NCH_PMT_AMT", "LINE_ALOWD_CHRG_AMT"),
    "pde": ("PDE_ID", "SRVC_DT", "CVRD_D_PLAN_PD_AMT", "TOT_RX_CST_AMT"),
}


# Sources and sinks


@query
def scan_enrollment(cd):
    """Written as CSV with columns in another order, and read by the library's reader."""
    table = cd.sources["beneficiary"]
    folder = cd.store.new_path("enrollment_csv")
    columns = [*reversed(table.columns)]
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table.select(*columns).write.options(**blanks).csv(f"{folder}/beneficiary.csv", header=True)
    return Sources.from_csv(table.sparkSession, folder)["beneficiary"]


@query
def scan_claims(cd):
    """Institutional files written as CSV, the others as Parquet, and all read by the library's readers."""
    spark = cd.sources["pde"].sparkSession
    folder = cd.store.new_path("claim_files")
    for src in FILE_NUMBERS:
        writer = cd.sources[src].write
        if src in INSTITUTIONAL_COST_SHARE:
            writer.csv(f"{folder}/{src}.csv", header=True, sep="|")
        else:
            writer.parquet(f"{folder}/{src}")
    from_csv, from_parquet = Sources.from_csv(spark, folder, sep="|"), Sources.from_parquet(spark, folder)

    def raw(src, df):
        clm, day, paid, allowed = _RAW_CELLS[src]
        return df.select(
            F.lit(src).alias("src"),
            F.col(clm).alias("clm_id"),
            F.col("BENE_ID").alias("bene_id"),
            F.col(day).alias("day_text"),
            F.col(paid).alias("paid_text"),
            F.col(allowed).alias("allowed_text"),
        )

    files = [(src, (from_csv if src in INSTITUTIONAL_COST_SHARE else from_parquet)[src]) for src in FILE_NUMBERS]
    return reduce(DataFrame.unionByName, [raw(src, df) for src, df in files])


@query
def scan_code_lists(cd):
    """How many professional lines use each listed service code; lines are counted per code before the join."""
    used = cd.claim_line().where("src = 'carrier'").groupBy("hcpcs_cd").agg(F.count("*").alias("lines"))
    return (
        cd.lists.service_codes.join(used, "hcpcs_cd", "left")
        .withColumn("lines", F.coalesce("lines", F.lit(0).cast("bigint")))
        .select("hcpcs_cd", "claim_type", "service_group", "lines")
    )


@query
def inline_values(cd):
    months = member_months.unpivot_months(cd.sources["beneficiary"])
    return months.groupBy("mo").agg(F.count("*").alias("person_years"), F.count("buyin_cd").alias("entitled"))


@query
def materialize(cd):
    table = write_table(cd.member_month(), cd.store.new_path("materialize_check"), ["yr"], dynamic=True)
    return table.groupBy("yr").agg(F.count("*").alias("n"), F.count_if("ab_ffs").alias("ab_ffs"))


@query
def derived_view(cd):
    by_category = cd.pmpm_by_category()
    by_category.createOrReplaceTempView("pmpm_by_category")
    return by_category.sparkSession.sql(
        "SELECT yr, count(*) AS categories, max(pmpm) AS highest_pmpm FROM pmpm_by_category GROUP BY yr"
    )


@query
def export_csv_query(cd):
    """The text of the file itself."""
    results = cd.pmpm_by_category()
    path = cd.store.new_path("pmpm_by_category.csv")
    export_csv(results, path, ["service_category", "yr"])
    return results.sparkSession.read.csv(path, header=True, inferSchema=False)


@query
def stacked_fact_export(cd):
    stacked = stack_facts({"spend": cd.spend_fact(), "mm": cd.mm_fact(), "pc": cd.pc_fact()})
    return plain(stacked)


# Projections and scalar functions


@query
def parse_int_query(cd):
    return cd.sources["beneficiary"].select(
        F.col("BENE_ID").alias("bene_id"),
        parse_int("BENE_ENROLLMT_REF_YR").alias("yr"),
        F.coalesce(parse_int("AGE_AT_END_REF_YR"), F.lit(-1)).alias("age"),
    )


@query
def parse_money_query(cd):
    def cells(src, df):
        clm, _, paid, allowed = _RAW_CELLS[src]
        return df.select(
            F.lit(src).alias("src"),
            F.col(clm).alias("clm_id"),
            cents(parse_money(paid)).alias("paid"),
            cents(parse_money(allowed)).alias("allowed"),
        )

    return each_file(cd, cells)


@query
def parse_claim_date_query(cd):
    def cells(src, df):
        clm, day, _, _ = _RAW_CELLS[src]
        return df.select(
            F.lit(src).alias("src"), F.col(clm).alias("clm_id"), parse_claim_date(day).cast("string").alias("svc_dt")
        )

    return each_file(cd, cells)


@query
def concat_bill_type(cd):
    lines = each_file(
        cd, lambda src, df: df.select(F.lit(src).alias("src"), bill_type().alias("bill_type2")), INSTITUTIONAL_COST_SHARE
    )
    return lines.groupBy("src", "bill_type2").agg(F.count("*").alias("n"))


@query
def eligibility_flags(cd):
    months = member_months.entitled_months(member_months.unpivot_months(cd.sources["beneficiary"]))
    return (
        months.select(
            "buyin_cd",
            "hmo_cd",
            "ptd_cd",
            "dual_cd",
            labels.in_part_ab_ffs("buyin_cd", "hmo_cd").alias("ab_ffs"),
            labels.in_part_d("ptd_cd").alias("partd"),
            labels.is_dual("dual_cd").alias("dual"),
        )
        .groupBy("buyin_cd", "hmo_cd", "ptd_cd", "dual_cd", "ab_ffs", "partd", "dual")
        .agg(F.count("*").alias("n"))
    )


@query
def age_band(cd):
    ages = cd.sources["beneficiary"].select(
        F.col("AGE_AT_END_REF_YR").alias("age_text"), parse_int("AGE_AT_END_REF_YR").alias("age")
    )
    return ages.groupBy("age_text", labels.age_band("age").alias("age_band")).agg(F.count("*").alias("n"))


@query
def decode_sex(cd):
    people = cd.sources["beneficiary"].select(F.col("SEX_IDENT_CD").alias("sex_cd"))
    return people.groupBy("sex_cd", labels.sex_label("sex_cd").alias("sex")).agg(F.count("*").alias("n"))


@query
def blank_flag(cd):
    return cd.claim_line().groupBy("src", "medicare_primary", "medicare_paid").agg(F.count("*").alias("n"))


@query
def allowed_amount(cd):
    return cd.claim_line().groupBy("src").agg(money_sum("paid"), money_sum("allowed"))


@query
def typed_null_pad(cd):
    padded = ("line_num", "bill_type2", "pos_cd", "spclty", "hcpcs_cd", "betos_cd", "rndrng_npi", "ndc")
    return cd.claim_line().groupBy("src").agg(*[F.count(c).alias(c) for c in padded])


@query
def service_category(cd):
    return cd.claim_line_cat().groupBy("src", "bill_type2", "service_category").agg(
        F.count("*").alias("n"), money_sum("allowed")
    )


@query
def subcategory(cd):
    return cd.claim_line_cat().groupBy("src", "bill_type2", "pos_cd", "subcategory").agg(F.count("*").alias("n"))


@query
def type_of_service(cd):
    return cd.claim_line_cat().groupBy("src", "betos_cd", "type_of_service").agg(F.count("*").alias("n"))


@query
def date_parts(cd):
    parts = cd.claim_line_cat().select(
        "src", F.coalesce("yr", F.lit(0)).alias("yr"), F.coalesce("mo", F.lit(0)).alias("mo")
    )
    return parts.groupBy("src", "yr", "mo").agg(F.count("*").alias("n"))


@query
def round_half_up_query(cd):
    totals = cd.claim_line().groupBy("src").agg(F.sum("allowed").alias("t"), F.count("*").alias("n"))
    return totals.select(
        "src",
        round_half_up("t", 0).alias("whole"),
        round_half_up(ratio("t", "n"), 1).alias("mean_1"),
        round_half_up(ratio("t", "n"), 2).alias("mean_2"),
    )


@query
def safe_ratio(cd):
    """Dual share per person; NULL for people without an eligible month."""
    people = cd.member_month().groupBy("bene_id").agg(
        F.count_if("ab_ffs").alias("months"), F.count_if(F.col("ab_ffs") & F.col("dual")).alias("dual_months")
    )
    share = ratio(F.col("dual_months") * F.lit(100.0), "months")
    return people.select("bene_id", "months", F.coalesce(round_half_up(share, 1), F.lit(-1.0)).alias("pct_dual"))


@query
def growth_arithmetic(cd):
    per_year = (
        cd.claim_line_cat()
        .where(cd.window.contains())
        .groupBy("src", "yr")
        .agg(F.sum("allowed").alias("allowed"))
    )
    by_src = Window.partitionBy("src").orderBy("yr")
    previous, first = F.lag("allowed").over(by_src), F.first("allowed").over(by_src)
    years = F.col("yr") - F.lit(cd.window.base)
    return per_year.select(
        "src",
        "yr",
        round_half_up(growth_pct("allowed", previous), 1).alias("growth_pct"),
        cents(F.col("allowed") - previous).alias("change"),
        F.when(years > 0, round_half_up(F.lit(100.0) * annual_growth("allowed", first, years), 1)).alias("annual_pct"),
    )


@query
def abs_diff(cd):
    rebuilt = validation.rebuilt_pmpm(cd.spend_fact(), cd.mm_fact())
    return cd.pmpm_by_category().join(rebuilt, ["yr", "service_category"]).select(
        "yr", "service_category", round_half_up(F.abs(F.col("pmpm") - F.col("rebuilt")), 4).alias("d")
    )


@query
def format_check_text(cd):
    totals = cd.claim_line().groupBy("src").agg(F.sum("allowed").alias("t"), F.count("*").alias("n"))
    return totals.select(
        F.concat(F.lit("allowed: "), "src").alias("label"),
        number_text("t", 0).alias("whole"),
        F.concat(number_text(ratio("t", "n"), 1), F.lit("%")).alias("one"),
        number_text(ratio("t", "n"), 2).alias("two"),
    )


@query
def string_range(cd):
    return cd.claim_line().where("src = 'carrier'").groupBy("hcpcs_cd").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("hcpcs_cd").between(*codes.OFFICE_VISIT_RANGE)).alias("visit"),
        F.count_if(F.col("hcpcs_cd").between(*codes.OFFICE_EM_RANGE)).alias("office_em"),
    )


@query
def null_label(cd):
    return (
        cd.spend()
        .withColumn("type_of_service", F.coalesce("type_of_service", F.lit("n/a")))
        .groupBy("yr", "type_of_service")
        .agg(F.count("*").alias("n"))
    )


@query
def star_extend(cd):
    return plain(cd.claim_line().withColumn("cost_share", F.col("allowed") - F.col("paid")))


# Filters


@query
def drop_unentitled_months(cd):
    months = member_months.entitled_months(member_months.unpivot_months(cd.sources["beneficiary"]))
    return months.groupBy("yr", "mo").agg(F.count("*").alias("n"))


@query
def study_window(cd):
    return cd.member_month().where(cd.window.contains()).groupBy("yr").agg(F.count("*").alias("n"))


@query
def payer_filter(cd):
    return service_categories.paid_by_medicare_first(cd.claim_line()).groupBy("src").agg(
        F.count("*").alias("n"), money_sum("allowed")
    )


@query
def code_filter(cd):
    lines = (
        cd.sources["outpatient"]
        .where((F.col("HCPCS_CD") == codes.CLINIC_VISIT_CODE) | (F.col("CLM_FAC_TYPE_CD") == codes.CLINIC_FACILITY_TYPE))
        .select(F.lit("outpatient").alias("src"), F.col("HCPCS_CD").alias("hcpcs_cd"), bill_type().alias("bill_type2"))
    )
    wellness = cd.spend().where((F.col("src") == "carrier") & F.col("hcpcs_cd").isin(codes.WELLNESS_CODES))
    both = lines.unionByName(wellness.select("src", "hcpcs_cd", "bill_type2"))
    return both.groupBy("src", "hcpcs_cd", "bill_type2").agg(F.count("*").alias("n"))


# Joins


@query
def unpivot_months(cd):
    months = member_months.unpivot_months(cd.sources["beneficiary"])
    return months.select("bene_id", "yr", "mo", "buyin_cd", "hmo_cd", "ptd_cd", "dual_cd")


@query
def eligibility_join(cd):
    joined = service_categories.eligibility_join(cd.claim_line_cat(), cd.member_month())
    return plain(joined.select("src", "clm_id", "bene_id", "yr", "mo", "allowed", *CELL))


@query
def code_list_join(cd):
    lines = primary_care.pc_professional(cd.spend(), cd.lists)
    return plain(lines.select("clm_id", "line_num", "hcpcs_cd", "spclty", "pos_cd", "allowed", "service_group"))


@query
def specialty_lookup(cd):
    lines = primary_care.pc_professional(cd.spend(), cd.lists)
    return lines.groupBy("spclty", "is_physician").agg(F.count("*").alias("n"), money_sum("allowed"))


@query
def facility_semi_join(cd):
    return plain(primary_care.pc_facility_split(cd.pc_outpatient_line(), cd.pc_step5()))


@query
def existence_in_or(cd):
    kept = primary_care.pc_step5(primary_care.pc_professional(cd.spend(), cd.lists), cd.pc_wellness_npi())
    return kept.groupBy("yr", "spclty").agg(F.count("*").alias("n"), money_sum("allowed"))


@query
def scalar_subquery_guard(cd):
    """Step 5 on spend without any wellness visit: the rule switches itself off."""
    spend = cd.spend().where(~F.coalesce(F.col("hcpcs_cd").isin(codes.WELLNESS_CODES), F.lit(False)))
    kept = primary_care.pc_step5(
        primary_care.pc_professional(spend, cd.lists), primary_care.pc_wellness_npi(spend)
    )
    return kept.groupBy("yr", "spclty").agg(F.count("*").alias("n"), money_sum("allowed"))


@query
def fqhc_code_join(cd):
    return plain(primary_care.pc_fqhc(cd.pc_outpatient_line(), cd.lists))


@query
def year_dimension_join(cd):
    spent = cd.spend_fact().groupBy("yr").agg(money_sum("allowed"))
    return spent.join(pmpm.year_months(cd.mm_fact()), "yr")


@query
def left_join_default(cd):
    split = cd.pc_facility_split().groupBy("bene_id").agg(F.sum("allowed").alias("facility"))
    people = cd.member_month().select("bene_id").distinct()
    return people.join(split, "bene_id", "left").select(
        "bene_id", cents(F.coalesce("facility", F.lit(0))).alias("facility")
    )


@query
def in_subquery_in_aggregate(cd):
    return plain(
        validation.dialysis_dollars(validation.spend_sums(cd.spend(), cd.sources["outpatient"], cd.window))
    )


# Aggregations


@query
def collapse_claim_header(cd):
    return plain(claim_lines.institutional_claims(cd.sources)).select(
        "src", "clm_id", "bene_id", "svc_dt", "bill_type2", "paid", "allowed", "medicare_primary", "medicare_paid"
    )


@query
def conditional_sum(cd):
    return cd.member_month().groupBy("mo").agg(
        F.count_if("ab_ffs").alias("ab_ffs"),
        F.count_if("partd").alias("partd"),
        F.count_if(F.col("ab_ffs") & F.col("dual")).alias("dual"),
    )


@query
def group_sum_count(cd):
    return cd.spend().groupBy("yr", "src", *CELL).agg(
        F.count("*").alias("n"), money_sum("allowed"), money_sum("paid")
    )


@query
def count_distinct(cd):
    return validation.raw_row_counts(cd.sources)


@query
def distinct_rows(cd):
    """Distinct person-days with a professional line."""
    lines = cd.spend().where(F.col("src") == "carrier").select("bene_id", "svc_dt").distinct()
    return plain(lines)


@query
def cube_members(cd):
    """Distinct members for every combination, built anew from member months that need not be eligible."""
    return facts.members_fact(cd.member_month().withColumn("ab_ffs", F.lit(True)), cd.window)


@query
def grouping_label(cd):
    """The same labels over distinct people of the claims side, where type of service has NULLs of its own."""
    spend = cd.spend().where(cd.window.contains())
    sets = [["yr", "type_of_service"], ["yr"]]
    counted = spend.groupingSets(sets, "yr", "type_of_service").agg(
        F.grouping("type_of_service").alias("open"), F.count("*").alias("n")
    )
    label = F.when(F.col("open") == 1, "all").otherwise(F.coalesce("type_of_service", F.lit("none")))
    return counted.select("yr", label.alias("type_of_service"), "n")


@query
def rollup_of_facts(cd):
    return cd.spend_fact().groupBy("yr", "service_category", "subcategory").agg(
        money_sum("allowed"), money_sum("paid"), F.sum("n_rows").alias("n_rows")
    )


@query
def ratio_of_aggregates(cd):
    return plain(validation.rebuilt_pmpm(cd.spend_fact(), cd.mm_fact()))


@query
def global_aggregate(cd):
    return cd.claim_line().agg(F.count("*").alias("n"), money_sum("allowed"), money_sum("paid"))


# Windows and set operations


@query
def lag_total_growth(cd):
    return cd.pmpm_total().select("yr", "total_pmpm", "total_growth_pct")


@query
def lag_category_growth(cd):
    return cd.pmpm_growth().select("yr", "service_category", "yoy_growth_pct", "yoy_change_pmpm")


@query
def first_value_cagr(cd):
    return cd.pmpm_growth().select("yr", "service_category", "cagr_since_2016_pct")


@query
def union_standardize(cd):
    return cd.claim_line().groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("bene_id").alias("people"))


@query
def union_fac_lines(cd):
    lines = primary_care.facility_lines(cd.pc_facility_split(), cd.pc_fqhc())
    known = lines.withColumn("yr", F.coalesce("yr", F.lit(0)))
    return known.groupBy("yr").agg(F.count("*").alias("n"), money_sum("allowed"))


@query
def union_checks(cd):
    return cd.validation().groupBy("id", "status").agg(F.count("*").alias("n"))


# Composite results


def _result(name: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    def build(cd: CostDrivers) -> DataFrame:
        return shape(getattr(cd, name)())

    QUERIES[name] = build


for _name in (
    "member_month",
    "member_months_by_year",
    "mm_fact",
    "pmpm_by_category",
    "pmpm_total",
    "pmpm_growth",
    "pc_wellness_npi",
    "primary_care_by_year",
    "primary_care_by_service",
    "members_fact",
    "validation",
):
    _result(_name)
for _name in (
    "claim_line",
    "claim_line_cat",
    "spend",
    "spend_fact",
    "pc_professional",
    "pc_step5",
    "pc_outpatient_line",
    "pc_facility_split",
    "pc_fqhc",
    "pc_fact",
    "ip_fact",
):
    _result(_name, plain)


@query
def volume_price_split(cd):
    """For everyone and for every demographic cell, in one table."""
    rows = [
        cd.volume_price_split().select(*[F.lit("all").alias(c) for c in CELL], "*"),
        cd.volume_price_split(CELL).withColumn("dual", F.col("dual").cast("string")),
    ]
    return plain(reduce(DataFrame.unionByName, rows))


@query
def growth_contribution(cd):
    return plain(cd.growth_contribution())


@query
def utilization_rate(cd):
    return plain(cd.utilization_rate())


@query
def fact_slice(cd):
    """PMPM of women without Medicaid by year, next to their distinct number."""
    filters = {"dual": False, "sex": "Female"}
    spent = drivers.fact_slice(cd.spend_fact(), filters, ["yr"], ["allowed"])
    months = drivers.fact_slice(cd.mm_fact(), filters, ["yr"], ["ab_ffs_mm"])
    members = drivers.members_slice(cd.members_fact(), {"dual": "false", "sex": "Female"})
    joined = spent.join(months, "yr").join(members, "yr")
    return joined.select(
        "yr", cents("allowed").alias("allowed"), "ab_ffs_mm", "members", cents(ratio("allowed", "ab_ffs_mm")).alias("pmpm")
    )


@query
def average_annual_growth(cd):
    return plain(cd.average_annual_growth())


@query
def input_report(cd):
    """Of the source tables with cells soiled on purpose."""
    return CostDrivers(soiled(cd.sources), cd.lists, store=cd.store, strict=False).input_report()


@query
def permissive_claims(cd):
    """Rows and dollars of soiled claim files by file and year; a cell that can't be read counts as blank."""
    return (
        claim_lines.claim_line(soiled(cd.sources), strict=False)
        .groupBy("src", F.coalesce(F.year("svc_dt"), F.lit(0)).alias("yr"))
        .agg(F.count(F.lit(1)).alias("n"), F.count("line_num").alias("numbered"), money_sum("paid"), money_sum("allowed"))
    )


@query
def partial_rebuild(cd):
    """Spend after one year's enrollment and one claim file changed, with only their partitions built again."""
    new = cd.rebuild(disenrolled(cd.sources), years=[2019], files=["pde"])
    return new.spend().groupBy("yr", "src").agg(F.count(F.lit(1)).alias("n"), money_sum("allowed"))


def _check_query(name: str) -> None:
    QUERIES[f"check_{name}"] = lambda cd: cd.checks()[name]()


for _name in (
    "row_counts",
    "unmapped",
    "dollars_preserved",
    "eligible_share",
    "monthly_vs_annual",
    "pmpm_rebuild",
    "wellness",
    "office_em",
    "dialysis_share",
    "pc_facility",
):
    _check_query(_name)


def bound_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(open_tables(spark, sf_dir))

    return {name: bind(build) for name, build in QUERIES.items()}
