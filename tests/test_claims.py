import datetime

import pytest
from pyspark.sql import functions as F

from claimspark.operators import claim_lines, member_months, service_categories
from claimspark.sources.text_tables import REQUIRED_COLUMNS, as_text_table
from tests.conftest import months, person, values

HEADER = {
    "CLM_ID": "1",
    "BENE_ID": "a",
    "CLM_FROM_DT": "03-Feb-2016",
    "CLM_FAC_TYPE_CD": "1",
    "CLM_SRVC_CLSFCTN_TYPE_CD": "1",
    "CLM_PMT_AMT": "100.00",
}
LINE = {
    "CLM_ID": "7",
    "BENE_ID": "a",
    "LINE_NUM": "1",
    "LINE_1ST_EXPNS_DT": "03-Feb-2016",
    "LINE_NCH_PMT_AMT": "8",
    "LINE_ALOWD_CHRG_AMT": "10",
    "LINE_PRCSG_IND_CD": "A",
}
FILL = {"PDE_ID": "9", "BENE_ID": "a", "SRVC_DT": "03-Feb-2016", "CVRD_D_PLAN_PD_AMT": "3", "TOT_RX_CST_AMT": "5"}


def test_lines_of_a_claim_become_one_row(sources):
    share = {"NCH_BENE_IP_DDCTBL_AMT": "20", "NCH_BENE_PTA_COINSRNC_LBLTY_AM": " ", "NCH_BENE_BLOOD_DDCTBL_LBLTY_AM": None}
    table = claim_lines.claim_line(sources(inpatient=[HEADER | share] * 3))
    assert values(table, "src", "clm_id", "line_num", "svc_dt", "bill_type2", "paid", "allowed") == [
        ("inpatient", "1", None, datetime.date(2016, 2, 3), "11", 100.0, 120.0)
    ]


def test_header_fields_take_their_own_maximum(sources):
    rows = [
        HEADER | {"CLM_FROM_DT": "03-Feb-2016", "CLM_PMT_AMT": "100", "NCH_BENE_IP_DDCTBL_AMT": "5"},
        HEADER | {"CLM_FROM_DT": "02-Mar-2016", "CLM_PMT_AMT": "40", "NCH_BENE_IP_DDCTBL_AMT": "50"},
    ]
    (row,) = values(claim_lines.claim_line(sources(inpatient=rows)), "svc_dt", "paid", "allowed")
    # The date is the larger text, not the later day; paid and cost share come from different lines.
    assert row == (datetime.date(2016, 2, 3), 100.0, 150.0)


def test_same_claim_number_in_two_files_stays_apart(sources):
    table = claim_lines.claim_line(sources(inpatient=[HEADER], snf=[HEADER], hha=[HEADER | {"CLM_PMT_AMT": ""}]))
    assert values(table, "src", "allowed") == [("hha", 0.0), ("inpatient", 100.0), ("snf", 100.0)]


def test_missing_claim_number_is_one_claim_per_file(sources):
    table = claim_lines.claim_line(sources(hospice=[HEADER | {"CLM_ID": None}] * 2))
    assert values(table, "src", "clm_id") == [("hospice", None)]


def test_payer_flags(sources):
    headers = [
        HEADER | {"CLM_ID": "1", "NCH_PRMRY_PYR_CD": " ", "CLM_MDCR_NON_PMT_RSN_CD": ""},
        HEADER | {"CLM_ID": "2", "NCH_PRMRY_PYR_CD": "A"},
        HEADER | {"CLM_ID": "3", "CLM_MDCR_NON_PMT_RSN_CD": "N"},
    ]
    lines = [
        LINE | {"CLM_ID": "4", "LINE_PRCSG_IND_CD": None},
        LINE | {"CLM_ID": "5", "LINE_PRCSG_IND_CD": ""},
        LINE | {"CLM_ID": "6", "LINE_PRCSG_IND_CD": "D", "LINE_BENE_PRMRY_PYR_CD": "B"},
    ]
    table = claim_lines.claim_line(sources(outpatient=headers, carrier=lines, pde=[FILL]))
    assert values(table, "clm_id", "medicare_primary", "medicare_paid") == [
        ("1", True, True),
        ("2", False, True),
        ("3", True, False),
        ("4", True, True),
        ("5", True, False),
        ("6", False, False),
        ("9", True, True),
    ]


def test_column_contract(sources):
    supplier = LINE | {"LINE_NDC_CD": "00071", "PRVDR_SPCLTY": "01", "HCPCS_CD": "E0100", "BETOS_CD": "D1A"}
    table = claim_lines.claim_line(
        sources(hha=[HEADER], carrier=[LINE | {"PRF_PHYSN_NPI": "0123"}], dme=[supplier], pde=[FILL])
    )
    assert dict(table.dtypes) == claim_lines.CLAIM_LINE_COLUMNS
    assert values(table, "src", "line_num", "spclty", "rndrng_npi", "ndc") == [
        ("carrier", 1, None, "0123", None),
        ("dme", 1, "01", None, "00071"),
        ("hha", None, None, None, None),
        ("pde", None, None, None, None),
    ]


def test_missing_and_typed_columns_are_refused(spark, text_table):
    with pytest.raises(ValueError, match="PDE_ID"):
        as_text_table(text_table("pde", []).drop("PDE_ID"), "pde")
    with pytest.raises(ValueError, match="LINE_NUM"):
        as_text_table(text_table("dme", []).withColumn("LINE_NUM", F.lit(1)), "dme")


def test_column_names_ignore_case(text_table):
    lower = text_table("pde", [FILL]).toDF(*[c.lower() for c in REQUIRED_COLUMNS["pde"]])
    assert as_text_table(lower, "pde").columns == list(REQUIRED_COLUMNS["pde"])


def test_row_without_a_date_stays_categorized(sources):
    rows = [LINE | {"LINE_1ST_EXPNS_DT": "03-Foo-2016"}]
    table = service_categories.claim_line_cat(claim_lines.claim_line(sources(carrier=rows)))
    assert values(table, "service_category", "yr", "mo") == [("Professional", None, None)]


@pytest.fixture
def eligible(sources):
    """Claim numbers kept by the eligibility rules for given people and claim rows."""

    def run(people, **rows):
        tables = sources(beneficiary=people, **rows)
        kept = service_categories.spend(
            claim_lines.claim_line(tables), member_months.member_month(tables["beneficiary"])
        )
        return [clm for (clm,) in values(kept, "clm_id")]

    return run


def test_spend_needs_an_eligible_month(eligible):
    managed = {"HMO_IND_03": "1"}
    rows = [
        LINE | {"CLM_ID": "feb"},
        LINE | {"CLM_ID": "mar", "LINE_1ST_EXPNS_DT": "03-Mar-2016"},
        LINE | {"CLM_ID": "2017", "LINE_1ST_EXPNS_DT": "03-Feb-2017"},
        LINE | {"CLM_ID": "nodate", "LINE_1ST_EXPNS_DT": None},
        LINE | {"CLM_ID": "nobody", "BENE_ID": "z"},
        LINE | {"CLM_ID": "null", "BENE_ID": None},
        LINE | {"CLM_ID": "denied", "LINE_PRCSG_IND_CD": "D"},
        LINE | {"CLM_ID": "secondary", "LINE_BENE_PRMRY_PYR_CD": "A"},
    ]
    assert eligible([person("a", **managed)], carrier=rows) == ["feb"]


def test_fills_need_part_d_as_well(eligible):
    without = months("N", "PTD_CNTRCT_ID")
    assert eligible([person("a", **without)], carrier=[LINE], pde=[FILL]) == ["7"]
    assert eligible([person("a")], carrier=[LINE], pde=[FILL]) == ["7", "9"]


def test_a_person_listed_twice_fans_out(eligible):
    # Enrollment is expected to hold a person-year once; a second row counts spend twice.
    assert eligible([person("a"), person("a")], carrier=[LINE]) == ["7", "7"]


def test_spend_has_category_and_cell(sources):
    tables = sources(beneficiary=[person("a", **months("02", "DUAL_STUS_CD"))], pde=[FILL])
    kept = service_categories.spend(claim_lines.claim_line(tables), member_months.member_month(tables["beneficiary"]))
    assert kept.columns == [
        *claim_lines.CLAIM_LINE_COLUMNS,
        "service_category",
        "subcategory",
        "type_of_service",
        "yr",
        "mo",
        "dual",
        "age_band",
        "sex",
    ]
    assert values(kept, "service_category", "yr", "mo", "dual", "age_band", "sex") == [
        ("Retail Pharmacy", 2016, 2, True, "65-74", "Female")
    ]


def test_dollars_lost_before_spend_fail_the_check(spark, sources, tmp_path, monkeypatch):
    """The rows spend is built from are those checks 2 and 3 read."""
    from claimspark import CodeLists, CostDrivers
    from claimspark.operators import service_categories
    from claimspark.sources.store import TableStore

    rows = [{"BENE_ID": "a", "PDE_ID": str(k), "SRVC_DT": "01-Jan-2016", "TOT_RX_CST_AMT": "24"} for k in range(4)]
    tables = sources(beneficiary=[person("a")], pde=rows)
    whole = CostDrivers(tables, CodeLists.builtin(spark), store=TableStore(f"{tmp_path}/whole"))
    assert whole.spend().count() == 4 and values(whole.checks()["dollars_preserved"](), "status") == [("PASS",)]
    real = service_categories.with_month
    monkeypatch.setattr(service_categories, "with_month", lambda df: real(df).where("clm_id <> '2'"))
    short = CostDrivers(tables, CodeLists.builtin(spark), store=TableStore(f"{tmp_path}/short"))
    assert short.spend().count() == 3 and values(short.checks()["dollars_preserved"](), "status") == [("FAIL",)]
