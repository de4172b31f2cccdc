from claimspark.config import StudyWindow
from claimspark.operators import facts, member_months
from tests.conftest import months, person, values

WINDOW = StudyWindow()


def test_unpivot_keeps_families_aligned(text_table):
    cells = {}
    for family, mark in (("MDCR_ENTLMT_BUYIN_IND", "b"), ("HMO_IND", "h"), ("PTD_CNTRCT_ID", "p"), ("DUAL_STUS_CD", "d")):
        cells |= {f"{family}_{m:02d}": f"{mark}{m}" for m in range(1, 13)}
    long = member_months.unpivot_months(text_table("beneficiary", [person("x", 2018, **cells)]))
    assert values(long, "mo", "buyin_cd", "hmo_cd", "ptd_cd", "dual_cd") == sorted(
        [(m, f"b{m}", f"h{m}", f"p{m}", f"d{m}") for m in range(1, 13)], key=repr
    )


def test_only_a_null_buyin_drops_the_month(text_table):
    cells = months("3", "MDCR_ENTLMT_BUYIN_IND") | {
        "MDCR_ENTLMT_BUYIN_IND_02": None,
        "MDCR_ENTLMT_BUYIN_IND_03": "",
        "MDCR_ENTLMT_BUYIN_IND_04": "0",
    }
    table = member_months.member_month(text_table("beneficiary", [person("x", **cells)]))
    flags = dict(values(table, "mo", "ab_ffs"))
    assert 2 not in flags and len(flags) == 11
    assert [m for m, on in flags.items() if not on] == [3, 4]


def test_flags_are_never_null(text_table):
    row = person("x", **months(None, "HMO_IND"), **months(None, "PTD_CNTRCT_ID"), **months(None, "DUAL_STUS_CD"))
    row |= {"AGE_AT_END_REF_YR": " ", "SEX_IDENT_CD": None}
    table = member_months.member_month(text_table("beneficiary", [row]))
    assert set(values(table, "ab_ffs", "partd", "dual", "age_band", "sex")) == {(True, False, False, "85+", "Unknown")}


def test_years_and_rates(text_table):
    people = [
        person("a"),
        person("b", **months("02", "DUAL_STUS_CD"), **months("N", "PTD_CNTRCT_ID")),
        person("c", 2015, **months("1", "HMO_IND")),
    ]
    by_year = member_months.member_months_by_year(member_months.member_month(text_table("beneficiary", people)))
    # 2015 lies outside the study window but stays; without an eligible month the dual share is unknown.
    assert values(by_year) == [(2015, 0, 0, 0.0, None), (2016, 24, 12, 2.0, 50.0)]


def test_mm_fact_keeps_cells_without_eligible_months(text_table):
    people = [person("a", **months("1", "HMO_IND")), person("b", 2023)]
    fact = facts.mm_fact(member_months.member_month(text_table("beneficiary", people)), WINDOW)
    assert values(fact) == [(2016, False, "65-74", "Female", 0, 0)]


def test_members_are_distinct_in_every_combination(text_table):
    half = {f"DUAL_STUS_CD_{m:02d}": "02" for m in range(7, 13)}
    people = [person("a", **half), person("b"), person("b", 2017)]
    fact = facts.members_fact(member_months.member_month(text_table("beneficiary", people)), WINDOW)
    got = {(yr, dual): n for yr, dual, age, sex, n in values(fact) if (age, sex) == ("all", "all")}
    # Person a counts once in each dual cell but once overall.
    assert got == {
        (2016, "true"): 1,
        (2016, "false"): 2,
        (2016, "all"): 2,
        (2017, "false"): 1,
        (2017, "all"): 1,
    }
    rows_2016 = [r for r in values(fact) if r[0] == 2016]
    # Two dual values, one age band, one sex: 3 * 2 * 2 combinations.
    assert len(rows_2016) == 12


def test_member_counts_match_a_direct_distinct_count(spark):
    """Every combination against brute force, with people in many cells and one month without a person."""
    rows = [
        (f"p{i % 37}" if i else None, 2016 + i % 3, i % 5 != 0, i % 2 == 0, ("<65", "65-74", "85+")[i % 7 % 3], ("Male", "Female")[i % 11 % 2])
        for i in range(900)
    ]
    table = spark.createDataFrame(rows, "bene_id string, yr int, ab_ffs boolean, dual boolean, age_band string, sex string")
    expected = {}
    for bene, yr, ab, dual, age, sex in rows:
        for d in (str(dual).lower(), "all"):
            for a in (age, "all"):
                for x in (sex, "all"):
                    if ab:
                        expected.setdefault((yr, d, a, x), set()).update([bene] if bene else [])
    got = {r[:4]: r[4] for r in values(facts.members_fact(table, WINDOW))}
    assert got == {key: len(people) for key, people in expected.items()}
