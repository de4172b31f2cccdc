import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimspark.config import StudyWindow
from claimspark.operators import primary_care
from claimspark.sources.code_lists import CodeLists
from tests.conftest import values

WINDOW = StudyWindow()
SPEND = (
    "src string, bene_id string, clm_id string, line_num int, svc_dt date, pos_cd string, spclty string, "
    "hcpcs_cd string, rndrng_npi string, allowed decimal(18,4), medicare_primary boolean, yr int"
)
DAY = datetime.date(2017, 5, 4)


@pytest.fixture(scope="module")
def lists(spark):
    return CodeLists.builtin(spark)


@pytest.fixture
def spend(spark):
    def make(*rows):
        base = dict(
            src="carrier", bene_id="a", line_num=1, svc_dt=DAY, pos_cd="11", spclty="01", hcpcs_cd="99213",
            rndrng_npi="n1", allowed=10.0, medicare_primary=True, yr=2017,
        )
        names = [part.split()[0] for part in SPEND.split(", ")]
        data = [tuple((base | {"clm_id": str(i)} | row)[n] for n in names) for i, row in enumerate(rows)]
        data = [tuple(Decimal(str(x)) if isinstance(x, float) else x for x in row) for row in data]
        return spark.createDataFrame(data, SPEND)

    return make


def steps(rows, lists):
    wellness = primary_care.pc_wellness_npi(rows)
    professional = primary_care.pc_professional(rows, lists)
    return professional, primary_care.pc_step5(professional, wellness)


def test_steps_1_to_4(spend, lists):
    rows = spend(
        {},
        {"src": "dme"},
        {"medicare_primary": False},
        {"hcpcs_cd": "71046"},
        {"hcpcs_cd": "G0463"},  # listed, but for facility claims only
        {"spclty": "06"},
        {"spclty": None},
        {"pos_cd": "21"},
        {"hcpcs_cd": "99490", "spclty": "97", "pos_cd": "02"},
    )
    professional = primary_care.pc_professional(rows, lists)
    assert values(professional, "clm_id", "service_group", "is_physician") == [
        ("0", "Office visit", "1"),
        ("8", "Care management", "0"),
    ]


def test_step_5_drops_physicians_without_wellness_visits(spend, lists):
    rows = spend(
        {"rndrng_npi": "n1", "hcpcs_cd": "G0439"},
        {"rndrng_npi": "n1"},
        {"rndrng_npi": "n2"},
        {"rndrng_npi": None},
        {"rndrng_npi": None, "spclty": "50"},
        {"rndrng_npi": "n2", "spclty": "97"},
    )
    _, kept = steps(rows, lists)
    assert values(kept, "clm_id") == [("0",), ("1",), ("4",), ("5",)]
    assert "is_physician" not in kept.columns


def test_step_5_looks_up_everyone_not_marked_0(spark, spend, lists):
    """A user's list may mark physicians with anything, or not at all; only ``'0'`` is exempt."""
    marks = [("01", "a", "1"), ("08", "b", "Y"), ("11", "c", None), ("50", "d", "0")]
    own = CodeLists(
        lists.service_codes,
        lists.places,
        spark.createDataFrame(marks, "prvdr_spclty string, description string, is_physician string"),
    )
    rows = spend(
        {"hcpcs_cd": "G0439", "rndrng_npi": "n1"},
        *[{"spclty": spclty, "rndrng_npi": npi} for spclty, _, _ in marks for npi in ("n1", "n2")],
    )
    _, kept = steps(rows, own)
    assert values(kept, "spclty", "rndrng_npi") == [
        ("01", "n1"), ("01", "n1"), ("08", "n1"), ("11", "n1"), ("50", "n1"), ("50", "n2"),
    ]


def test_step_5_counts_wellness_visits_of_any_year(spend, lists):
    rows = spend({"hcpcs_cd": "G0439", "yr": 2015}, {}, {"rndrng_npi": "n2"})
    _, kept = steps(rows, lists)
    assert values(kept, "clm_id") == [("0",), ("1",)]


def test_step_5_is_off_without_any_wellness_visit(spend, lists):
    rows = spend({}, {"rndrng_npi": None}, {"spclty": "50"})
    professional, kept = steps(rows, lists)
    assert values(kept, "clm_id") == values(professional, "clm_id") == [("0",), ("1",), ("2",)]


def test_an_unknown_clinician_switches_step_5_on(spend, lists):
    # One wellness visit without a clinician: the list has one row, so the rule applies, and nobody passes it.
    rows = spend({"rndrng_npi": None, "hcpcs_cd": "G0439"}, {}, {"spclty": "50"})
    _, kept = steps(rows, lists)
    assert values(primary_care.pc_wellness_npi(rows)) == [(None,)]
    assert values(kept, "clm_id") == [("2",)]


LINE = {
    "BENE_ID": "a",
    "CLM_ID": "1",
    "CLM_FAC_TYPE_CD": "1",
    "CLM_SRVC_CLSFCTN_TYPE_CD": "3",
    "HCPCS_CD": "G0463",
    "REV_CNTR_DT": "04-May-2017",
    "REV_CNTR_PMT_AMT_AMT": "50",
    "REV_CNTR_CASH_DDCTBL_AMT": " ",
    "REV_CNTR_COINSRNC_WGE_ADJSTD_C": "12.5",
}


@pytest.fixture
def facility(text_table):
    def make(*rows):
        return primary_care.pc_outpatient_line(text_table("outpatient", [LINE | row for row in rows]))

    return make


def test_outpatient_lines(facility):
    lines = facility({}, {"HCPCS_CD": "99213"}, {"HCPCS_CD": None, "CLM_FAC_TYPE_CD": "7"}, {"CLM_FAC_TYPE_CD": None})
    assert values(lines, "hcpcs_cd", "bill_type2", "svc_dt", "allowed") == [
        ("G0463", "13", DAY, 62.5),
        ("G0463", None, DAY, 62.5),
        (None, "73", DAY, 62.5),
    ]


def test_facility_half_of_an_office_visit(spend, lists, facility):
    _, visits = steps(spend({"pos_cd": "22"}, {"pos_cd": "22"}, {"bene_id": "b", "pos_cd": "11"}), lists)
    lines = facility({}, {}, {"REV_CNTR_DT": "05-May-2017"}, {"BENE_ID": "b"}, {"CLM_SRVC_CLSFCTN_TYPE_CD": "4"})
    # Two visits that day, yet each facility line counts once.
    assert values(primary_care.pc_facility_split(lines, visits)) == [("a", DAY, 62.5), ("a", DAY, 62.5)]


def test_office_visit_range_is_by_text(spend, lists, facility):
    for code, found in (("99201", 1), ("99215", 1), ("99490", 0), ("99497", 0)):
        _, visits = steps(spend({"pos_cd": "19", "hcpcs_cd": code}), lists)
        assert primary_care.pc_facility_split(facility({}), visits).count() == found


def test_clinic_claims(facility, lists):
    seven = {"CLM_FAC_TYPE_CD": "7", "CLM_SRVC_CLSFCTN_TYPE_CD": "7"}
    lines = facility(seven, seven | {"HCPCS_CD": "G0466"}, seven | {"HCPCS_CD": "90935"}, {"HCPCS_CD": "G0463"})
    # The facility-only code counts here although Steps 1 to 4 leave it out.
    assert primary_care.pc_fqhc(lines, lists).count() == 2


def test_by_year_adds_facility_dollars_but_not_services(spark, spend, lists):
    _, step5 = steps(spend({}, {"yr": 2018}, {"yr": 2015}), lists)
    day = "bene_id string, svc_dt date, allowed double"
    split = spark.createDataFrame([("a", DAY, 5.0), ("a", datetime.date(2014, 1, 1), 7.0)], day)
    fqhc = spark.createDataFrame([("a", datetime.date(2019, 1, 1), 2.5), ("a", None, 9.0)], day)
    spent = spark.createDataFrame(
        [(yr, c, 100.0) for yr in (2017, 2018, 2019, 2020) for c in ("Other", "Retail Pharmacy")],
        "yr int, service_category string, allowed double",
    )
    months = spark.createDataFrame([(yr, 10) for yr in (2017, 2018, 2019, 2020)], "yr int, ab_ffs_mm bigint")
    result = primary_care.primary_care_by_year(step5, split, fqhc, spent, months, WINDOW)
    assert values(result) == [
        (2017, 15.0, 1, 1.5, 15.0, 7.5),
        (2018, 10.0, 1, 1.0, 10.0, 5.0),
        (2019, 3.0, 0, 0.25, 2.5, 1.25),
        (2020, 0.0, 0, 0.0, 0.0, 0.0),
    ]


def test_by_service(spend, lists):
    _, step5 = steps(spend({}, {"allowed": 2.255}, {"yr": 2014}, {"hcpcs_cd": "99497"}), lists)
    assert values(primary_care.primary_care_by_service(step5, WINDOW)) == [
        (2017, "Advance care planning", 1, 10.0),
        (2017, "Office visit", 2, 12.26),
    ]


def test_lists_of_the_user(spark, tmp_path):
    for name, text in {
        "pc_service_codes": "hcpcs_cd,claim_type,service_group\n00001,professional_or_facility,Mine\n",
        "pc_place_of_service": "pos_cd,description\n01,Somewhere\n",
        "pc_medicare_specialty": "prvdr_spclty,description,is_physician\n01,Doctor,1\n",
    }.items():
        (tmp_path / f"{name}.csv").write_text(text)
    lists = CodeLists.from_csv(spark, str(tmp_path))
    # Leading zeros survive: nothing is typed.
    assert values(lists.service_codes) == [("00001", "professional_or_facility", "Mine")]
    assert values(lists.places) == [("01", "Somewhere")]
    assert values(lists.specialties) == [("01", "Doctor", "1")]
    assert lists.service_codes.where(F.col("hcpcs_cd") == "1").count() == 0
