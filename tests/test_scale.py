"""Plans and skew: what has to hold when the data is large."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from claimspark import CostDrivers
from claimspark.operators import claim_lines, facts, member_months, primary_care, service_categories
from claimspark.plans import validation
from claimspark.settings import scale_settings
from claimspark.sources.code_lists import CodeLists
from claimspark.sources.store import TableStore, write_table
from harness.queries import QUERIES, open_tables, plain
from harness.tables import source_tables
from tests.conftest import SF_TINY, person, values

NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
# Skew handling starts at sizes a test can reach.
SMALL_SKEW = NO_BROADCAST | {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """Plan after adaptive execution has run it."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().execute().count()
    return execution.executedPlan().toString()


@pytest.fixture
def tables(spark):
    return open_tables(spark, SF_TINY)


def test_headers_of_all_files_take_one_shuffle(tables):
    text = plan(claim_lines.institutional_claims(tables.sources))
    assert text.count("Exchange hashpartitioning") == 1
    # Combined before the shuffle.
    assert "partial_max" in text


def test_lines_and_member_months_take_no_shuffle(tables, text_table):
    for src in ("carrier", "dme", "pde"):
        assert "Exchange" not in plan(claim_lines.line_claims(src, tables.sources[src]))
    # From an enrollment table as it is; the one derived from customers spreads its few keys over the tasks first.
    assert "Exchange" not in plan(member_months.member_month(text_table("beneficiary", [person("a")])))


def test_enrollment_scan_is_pruned(tables):
    schema = plan(tables.member_months_by_year()).split("ReadSchema:")[1]
    assert "age_band" not in schema and "ab_ffs" in schema


def test_filters_reach_the_files(tables):
    window = plan(facts.mm_fact(tables.member_month(), tables.window))
    assert re.search(r"PartitionFilters: \[[^\]]*yr#\d+ >= 2016", window)
    carrier = plan(primary_care.pc_wellness_npi(tables.spend()))
    assert re.search(r"PartitionFilters: \[[^\]]*src#\d+ = carrier", carrier)
    assert re.search(r"PushedFilters: \[[^\]]*In\(hcpcs_cd", carrier)


def test_eligibility_join_shuffles_each_side_once(tables, with_conf):
    with_conf(NO_BROADCAST)
    text = plan(service_categories.spend(tables.claim_line(), tables.member_month()))
    assert text.count("Exchange hashpartitioning") == 2
    # The Part D rule stays a condition of the keyed join, and labels are not shuffled.
    assert re.search(r"SortMergeJoin \[bene_id#\d+, yr#\d+, mo#\d+\].*partd", text)
    assert "Retail Pharmacy" not in text.split("Exchange")[1]


def test_no_query_pairs_all_rows(spark, with_conf):
    """No cross join anywhere; with broadcasting off even the small joins are keyed."""
    with_conf(NO_BROADCAST)
    for name, build in QUERIES.items():
        text = plan(build(open_tables(spark, SF_TINY)))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_only_fixed_lists_are_broadcast_by_hint(tables, with_conf):
    with_conf(NO_BROADCAST)
    spend = tables.spend()
    text = plan(primary_care.pc_step5(primary_care.pc_professional(spend, tables.lists), tables.pc_wellness_npi()))
    # Service codes, specialties and places; the clinician list grows with the data and is shuffled.
    assert text.count("BroadcastHashJoin") == 3
    assert text.count("SortMergeJoin") == 1


def test_same_results_for_any_partitioning(spark, with_conf, tmp_path):
    """Without broadcasts, over 1 and 13 shuffle partitions."""
    names = ("claim_line", "spend_fact", "members_fact", "pc_step5", "primary_care_by_year", "pmpm_growth")
    results = []
    for partitions in ("1", "13"):
        with_conf(NO_BROADCAST | {"spark.sql.shuffle.partitions": partitions})
        store = TableStore(f"{tmp_path}/{partitions}")
        cd = CostDrivers(source_tables(spark, SF_TINY, store), CodeLists.builtin(spark), store=store)
        results.append({name: values(plain(getattr(cd, name)())) for name in names})
    assert results[0] == results[1]


# One key holds a third of all rows.

DAY = datetime.date(2016, 2, 3)


@pytest.fixture
def skewed_lines(spark):
    """30,000 carrier lines: a third belong to one person, month, claim and clinician."""
    hot = F.col("id") % 3 == 0
    columns = {name: F.lit(None).cast(kind) for name, kind in claim_lines.CLAIM_LINE_COLUMNS.items()} | {
        "src": F.lit("carrier"),
        "bene_id": F.when(hot, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 997)),
        "clm_id": F.when(hot, "hot").otherwise(F.col("id").cast("string")),
        "line_num": F.col("id").cast("int"),
        "svc_dt": F.lit(DAY),
        "pos_cd": F.lit("22"),
        "spclty": F.lit("01"),
        "hcpcs_cd": F.when(F.col("id") % 50 == 0, "G0439").otherwise("99213"),
        "rndrng_npi": F.when(hot, "n").otherwise(F.concat(F.lit("n"), F.col("id") % 499)),
        "paid": F.lit(1).cast("decimal(18,4)"),
        "allowed": F.lit(2).cast("decimal(18,4)"),
        "medicare_primary": F.lit(True),
        "medicare_paid": F.lit(True),
    }
    return spark.range(0, 30000, 1, 16).select(*[c.alias(n) for n, c in columns.items()])


@pytest.fixture
def people(spark, text_table, tmp_path):
    table = text_table("beneficiary", [person("hot")] + [person(f"p{i}") for i in range(997)])
    return write_table(member_months.member_month(table), f"{tmp_path}/member_month", ["yr"])


def test_hot_month_is_split_in_the_eligibility_join(spark, skewed_lines, people, with_conf):
    with_conf(SMALL_SKEW)
    kept = service_categories.spend(skewed_lines, people)
    assert "skew=true" in final_plan(kept)
    assert kept.count() == 30000
    assert values(kept.groupBy("bene_id").count().where("bene_id = 'hot'")) == [("hot", 10000)]


def test_hot_clinician_is_split_in_step_5(spark, skewed_lines, people, with_conf, tmp_path):
    with_conf(SMALL_SKEW)
    spend = write_table(service_categories.spend(skewed_lines, people), f"{tmp_path}/spend")
    professional = primary_care.pc_professional(spend, CodeLists.builtin(spark))
    kept = primary_care.pc_step5(professional, primary_care.pc_wellness_npi(spend))
    assert "skew=true" in final_plan(kept)
    wellness = {r[0] for r in values(primary_care.pc_wellness_npi(spend))}
    assert kept.count() == spend.where(F.col("rndrng_npi").isin(wellness)).count()


def test_unknown_clinicians_do_not_meet_in_one_partition(spark, skewed_lines, people, with_conf, tmp_path):
    with_conf(NO_BROADCAST | {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"})
    hot = F.col("clm_id") == "hot"
    lines = skewed_lines.withColumns(
        {"rndrng_npi": F.when(~hot, F.col("rndrng_npi")), "spclty": F.when(hot, "50").otherwise("01")}
    )
    spend = write_table(service_categories.spend(lines, people), f"{tmp_path}/spend")
    wellness = write_table(primary_care.pc_wellness_npi(spend), f"{tmp_path}/npi")
    kept = primary_care.pc_step5(primary_care.pc_professional(spend, CodeLists.builtin(spark)), wellness)
    assert "SortMergeJoin" in plan(kept)
    per_task = kept.where(hot).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    sizes = [n for (n,) in values(per_task, "n")]
    assert sum(sizes) == 10000 and len(sizes) == 16
    assert max(sizes) < 10000 / 16 * 1.5


def test_hot_person_day_is_split_in_step_6(spark, skewed_lines, people, with_conf, tmp_path):
    with_conf(SMALL_SKEW)
    spend = write_table(service_categories.spend(skewed_lines, people), f"{tmp_path}/spend")
    step5 = primary_care.pc_professional(spend, CodeLists.builtin(spark)).drop("is_physician")
    facility = skewed_lines.select(
        "bene_id", F.lit("G0463").alias("hcpcs_cd"), F.lit("13").alias("bill_type2"), "svc_dt", "allowed"
    )
    matched = primary_care.pc_facility_split(facility, step5)
    assert "skew=true" in final_plan(matched)
    visited = spend.where("hcpcs_cd = '99213'").select("bene_id").distinct()
    assert matched.count() == facility.join(F.broadcast(visited), "bene_id", "left_semi").count()


def test_hot_claim_sends_one_row_per_task(spark, with_conf):
    """A claim with a third of all revenue lines is combined before the shuffle."""
    hot = F.col("id") % 3 == 0
    headers = spark.range(0, 30000, 1, 4).select(
        F.lit("outpatient").alias("src"),
        F.when(hot, "hot").otherwise(F.col("id").cast("string")).alias("clm_id"),
        F.lit("a").alias("bene_id"),
        F.col("id").cast("double").alias("paid"),
    )
    collapsed = claim_lines.collapse_claim_headers(headers)
    assert collapsed.count() == 20001
    assert values(collapsed.where("clm_id = 'hot'"), "paid") == [(29997.0,)]
    assert "partial_max" in plan(collapsed)


def test_claim_counts_survive_a_hot_file(tables):
    counted = validation.raw_row_counts(tables.sources)
    # Distinct claims are found per file and claim before the files are counted.
    assert re.search(r"keys=\[src#\d+, clm_id#\d+\]", plan(counted))


def test_settings_grow_with_the_input():
    small, large, larger = (scale_settings(tb << 40, 4000) for tb in (50, 100, 1000))
    partitions = [int(x["spark.sql.shuffle.partitions"]) for x in (small, large, larger)]
    assert partitions == [25600, 51200, 512000]
    assert scale_settings(1 << 30, 8)["spark.sql.shuffle.partitions"] == "8"
    fixed = [{k: v for k, v in x.items() if "Bytes" not in k and "partitions" not in k} for x in (small, large, larger)]
    assert fixed[0] == fixed[1] == fixed[2] == {
        k: v for k, v in scale_settings(1 << 20, 4).items() if "Bytes" not in k and "partitions" not in k
    }


def scans(df, folder: str) -> int:
    return len(re.findall(rf"FileScan parquet [^\n]*{folder}", plan(df)))


LONG_PATHS = {"spark.sql.maxMetadataStringLength": "2000"}


def test_reports_read_raw_files_a_fixed_number_of_times(spark, tmp_path, with_conf):
    """Once the shared tables are there, the checks count each claim file once and the enrollment table once."""
    with_conf(LONG_PATHS)
    root = f"{tmp_path}/store"
    store = TableStore(root)
    cd = CostDrivers(source_tables(spark, SF_TINY, store), CodeLists.builtin(spark), store=store)
    report = cd.validation()
    assert scans(report, f"{root}/order_line") == 8 + 1  # check 1 by file; check 10 the clinic lines
    assert scans(report, f"{root}/beneficiary") == 1
    for name in ("claim_line-", "spend-"):
        assert scans(report, f"{root}/{name}") == 0
    by_year = cd.primary_care_by_year()
    assert scans(by_year, f"{root}/order_line") == 1
    assert scans(by_year, f"{root}/claim_line") == scans(by_year, f"{root}/spend-") == 0


def test_checks_read_claims_twice_and_spend_once(tables, with_conf):
    with_conf(LONG_PATHS)
    text = [plan(x) for x in (validation.claim_sums(tables.claim_line()), validation.category_sums(tables.claim_line_cat(), tables.window))]
    assert [t.count("FileScan") for t in text] == [1, 1]
    spend = plan(validation.spend_sums(tables.spend(), tables.sources["outpatient"], tables.window))
    assert len(re.findall(r"FileScan parquet [^\n]*/spend-", spend)) == 1


def test_facts_read_the_study_years_only(tables):
    for fact in (facts.spend_fact(tables.spend(), tables.window), facts.ip_fact(tables.spend(), tables.window), facts.pc_fact(tables.pc_step5(), tables.window)):
        assert re.search(r"PartitionFilters: \[[^\]]*yr#\d+ >= 2016", plan(fact))


def test_members_are_reduced_to_a_number(tables):
    text = plan(facts.members_fact(tables.member_month(), tables.window))
    assert "ObjectHashAggregate" not in text and "SortAggregate" not in text
    assert len(re.findall(r"Exchange hashpartitioning\(yr#\d+, bene_id#\d+", text)) == 1


def test_member_months_are_never_broadcast(spark, tables, with_conf, tmp_path):
    """Files of a few kilobytes hold many months, so that their size says little about their rows."""
    with_conf({"spark.sql.autoBroadcastJoinThreshold": "10MB"})
    months = write_table(tables.member_month(), f"{tmp_path}/member_month", ["yr"])
    for joined in (service_categories.eligible_spend(tables.categorized(), months), service_categories.eligibility_join(tables.claim_line_cat(), months)):
        text = final_plan(joined)
        assert "SortMergeJoin" in text and "BroadcastExchange" not in text


def test_clinicians_and_visit_days_are_never_broadcast(tables, with_conf):
    """Both grow with the data, and files of them say little about their number; the fixed code lists may be broadcast."""
    with_conf({"spark.sql.autoBroadcastJoinThreshold": "10MB"})
    professional = primary_care.pc_professional(tables.spend(), tables.lists)
    step5 = primary_care.pc_step5(professional, tables.pc_wellness_npi())
    split = primary_care.pc_facility_split(tables.pc_outpatient_line(), tables.pc_step5())
    for joined, kind in ((step5, "LeftOuter"), (split, "LeftSemi")):
        text = final_plan(joined)
        assert re.search(rf"SortMergeJoin [^\n]*{kind}", text) and not re.search(rf"Broadcast\w*Join [^\n]*{kind}", text)


def test_dialysis_claims_are_never_broadcast(tables, with_conf):
    with_conf({"spark.sql.autoBroadcastJoinThreshold": "10MB"})
    text = final_plan(validation.spend_sums(tables.spend(), tables.sources["outpatient"], tables.window))
    assert "SortMergeJoin" in text and "BroadcastExchange" not in text
