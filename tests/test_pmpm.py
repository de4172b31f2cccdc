"""PMPM, growth and driver results against published figures of one known population."""

import pytest

from claimspark.config import StudyWindow
from claimspark.plans import drivers, pmpm
from tests.conftest import values

WINDOW = StudyWindow()
YEARS = range(2016, 2023)

# Year, category, allowed dollars, PMPM, growth %, change, compound growth %.
PUBLISHED = [
    (2016, "Inpatient Hospital", 11140748.0, 156.56, None, None, None),
    (2017, "Inpatient Hospital", 11467817.0, 153.22, -2.1, -3.34, -2.1),
    (2018, "Inpatient Hospital", 15232397.0, 192.36, 25.5, 39.14, 10.8),
    (2019, "Inpatient Hospital", 15337032.0, 182.17, -5.3, -10.19, 5.2),
    (2020, "Inpatient Hospital", 23665453.0, 267.01, 46.6, 84.84, 14.3),
    (2021, "Inpatient Hospital", 25906726.0, 277.78, 4.0, 10.77, 12.2),
    (2022, "Inpatient Hospital", 33499834.0, 341.49, 22.9, 63.71, 13.9),
    (2016, "Long-Term Care", 4269415.0, 60.0, None, None, None),
    (2017, "Long-Term Care", 3894432.0, 52.03, -13.3, -7.97, -13.3),
    (2018, "Long-Term Care", 5471711.0, 69.1, 32.8, 17.07, 7.3),
    (2019, "Long-Term Care", 5621033.0, 66.76, -3.4, -2.34, 3.6),
    (2020, "Long-Term Care", 5538014.0, 62.48, -6.4, -4.28, 1.0),
    (2021, "Long-Term Care", 6210522.0, 66.59, 6.6, 4.11, 2.1),
    (2022, "Long-Term Care", 6063383.0, 61.81, -7.2, -4.78, 0.5),
    (2016, "Other", 26362.0, 0.37, None, None, None),
    (2017, "Other", 26485.0, 0.35, -5.4, -0.02, -5.4),
    (2018, "Other", 28141.0, 0.36, 2.9, 0.01, -1.4),
    (2019, "Other", 29452.0, 0.35, -2.8, -0.01, -1.8),
    (2020, "Other", 32273.0, 0.36, 2.9, 0.01, -0.7),
    (2021, "Other", 32593.0, 0.35, -2.8, -0.01, -1.1),
    (2022, "Other", 35104.0, 0.36, 2.9, 0.01, -0.5),
    (2016, "Outpatient Hospital", 72294916.0, 1015.95, None, None, None),
    (2017, "Outpatient Hospital", 86914686.0, 1161.28, 14.3, 145.33, 14.3),
    (2018, "Outpatient Hospital", 87498990.0, 1104.95, -4.9, -56.33, 4.3),
    (2019, "Outpatient Hospital", 79150520.0, 940.12, -14.9, -164.83, -2.6),
    (2020, "Outpatient Hospital", 87034639.0, 981.98, 4.5, 41.86, -0.8),
    (2021, "Outpatient Hospital", 97289879.0, 1043.17, 6.2, 61.19, 0.5),
    (2022, "Outpatient Hospital", 109983605.0, 1121.14, 7.5, 77.97, 1.7),
    (2016, "Professional", 17414847.0, 244.73, None, None, None),
    (2017, "Professional", 18409015.0, 245.97, 0.5, 1.24, 0.5),
    (2018, "Professional", 19769018.0, 249.65, 1.5, 3.68, 1.0),
    (2019, "Professional", 21465905.0, 254.96, 2.1, 5.31, 1.4),
    (2020, "Professional", 23159557.0, 261.3, 2.5, 6.34, 1.7),
    (2021, "Professional", 24110440.0, 258.52, -1.1, -2.78, 1.1),
    (2022, "Professional", 25249357.0, 257.38, -0.4, -1.14, 0.8),
    (2016, "Retail Pharmacy", 8816921.0, 179.23, None, None, None),
    (2017, "Retail Pharmacy", 9417896.0, 180.8, 0.9, 1.57, 0.9),
    (2018, "Retail Pharmacy", 10458583.0, 190.57, 5.4, 9.77, 3.1),
    (2019, "Retail Pharmacy", 11174197.0, 192.43, 1.0, 1.86, 2.4),
    (2020, "Retail Pharmacy", 11901246.0, 195.52, 1.6, 3.09, 2.2),
    (2021, "Retail Pharmacy", 12221648.0, 191.84, -1.9, -3.68, 1.4),
    (2022, "Retail Pharmacy", 13741120.0, 205.21, 7.0, 13.37, 2.3),
]

# Year, eligible member months, and those with Part D.
MONTHS = [
    (2016, 71_160, 49_194),
    (2017, 74_844, 52_090),
    (2018, 79_188, 54_881),
    (2019, 84_192, 58_068),
    (2020, 88_632, 60_871),
    (2021, 93_264, 63_708),
    (2022, 98_100, 66_962),
]

# Medical, pharmacy and total PMPM and growth of the total, 2016 to 2022.
TOTALS = [
    (2016, 1477.61, 179.23, 1656.84, None),
    (2017, 1612.85, 180.8, 1793.65, 8.3),
    (2018, 1616.42, 190.57, 1806.99, 0.7),
    (2019, 1444.36, 192.43, 1636.79, -9.4),
    (2020, 1573.13, 195.52, 1768.65, 8.1),
    (2021, 1646.41, 191.84, 1838.25, 3.9),
    (2022, 1782.18, 205.21, 1987.39, 8.1),
]

# Inpatient stays and dollars of the first and last year.
STAYS = [(2016, 1945, 11140747.50), (2022, 3248, 33499834.10)]


@pytest.fixture
def mm_fact(spark):
    # Two cells a year, so that the facts really are added up.
    cells = [
        (yr, dual, ab - 100 if dual else 100, d - 7 if dual else 7) for yr, ab, d in MONTHS for dual in (True, False)
    ]
    return spark.createDataFrame(cells, "yr int, dual boolean, ab_ffs_mm bigint, partd_mm bigint")


@pytest.fixture
def by_category(spark, mm_fact):
    rows = [(yr, category, sub, allowed / 2) for yr, category, allowed, *_ in PUBLISHED for sub in ("a", "b")]
    spend = spark.createDataFrame(rows, "yr int, service_category string, subcategory string, allowed double")
    return pmpm.pmpm_by_category(spend, mm_fact)


def test_pmpm_by_category(by_category):
    months = {yr: (ab, rx) for yr, ab, rx in MONTHS}
    expected = [
        (yr, category, allowed, months[yr][category == "Retail Pharmacy"], value)
        for yr, category, allowed, value, *_ in PUBLISHED
    ]
    assert values(by_category) == sorted(expected, key=repr)


def test_pmpm_total(by_category):
    assert values(pmpm.pmpm_total(by_category)) == TOTALS


def test_pmpm_growth(by_category):
    expected = [(yr, category, value, *growth) for yr, category, _, value, *growth in PUBLISHED]
    assert values(pmpm.pmpm_growth(by_category, WINDOW)) == sorted(expected, key=repr)


def test_compound_growth_counts_from_the_base_year(spark):
    late = spark.createDataFrame(
        [(2018, "Other", 100.0), (2019, "Other", 121.0)], "yr int, service_category string, pmpm double"
    )
    # First seen in 2018, yet the exponent counts from 2016: 1.21 ** (1/3) rather than 1.21.
    rates = dict(values(pmpm.pmpm_growth(late, WINDOW), "yr", "cagr_since_2016_pct"))
    assert rates == {2018: 0.0, 2019: 6.6}


def test_missing_side_leaves_the_total_unknown(spark):
    only = spark.createDataFrame([(2016, "Other", 10.0)], "yr int, service_category string, pmpm double")
    assert values(pmpm.pmpm_total(only)) == [(2016, 10.0, None, None, None)]


def test_year_without_months_disappears_and_zero_months_give_null(spark):
    spend = spark.createDataFrame(
        [(2016, "Other", 10.0), (2017, "Other", 10.0)], "yr int, service_category string, allowed double"
    )
    months = spark.createDataFrame([(2017, 0, 0)], "yr int, ab_ffs_mm bigint, partd_mm bigint")
    assert values(pmpm.pmpm_by_category(spend, months)) == [(2017, "Other", 10.0, 0, None)]


@pytest.fixture
def ip_fact(spark):
    rows = [(yr, dual, n if dual else stays - n, a if dual else round(dollars - a, 2))
            for (yr, stays, dollars), n, a in zip(STAYS, (700, 900), (3e6, 4e6), strict=True) for dual in (True, False)]
    return spark.createDataFrame(rows, "yr int, dual boolean, stays bigint, allowed double")


def test_volume_price_split(ip_fact, mm_fact):
    row = drivers.volume_price_split(ip_fact, mm_fact, 2016, 2022).first()
    assert round(row["volume_effect"]) == 46
    assert round(row["price_effect"]) == 139
    assert round(row["pmpm_change"], 2) == 184.93
    assert row["volume_effect"] + row["price_effect"] == pytest.approx(row["pmpm_change"])


def test_split_by_cell_adds_up_too(ip_fact, mm_fact):
    for row in drivers.volume_price_split(ip_fact, mm_fact, 2016, 2022, ["dual"]).collect():
        assert row["volume_effect"] + row["price_effect"] == pytest.approx(row["pmpm_change"])


def test_utilization(ip_fact, mm_fact):
    rates = {r["yr"]: (round(r["stays_per_1000"]), round(r["allowed_per_stay"])) for r in
             drivers.utilization_rate(ip_fact, mm_fact).collect()}
    assert rates == {2016: (328, 5728), 2022: (397, 10314)}


def test_growth_contribution(by_category):
    rows = {r["service_category"]: r for r in drivers.growth_contribution(by_category, 2016, 2022).collect()}
    inpatient = rows["Inpatient Hospital"]
    assert (round(inpatient["pct_of_first"]), round(inpatient["pct_of_change"])) == (9, 56)
    assert round(rows["Outpatient Hospital"]["pmpm_change"]) == 105
    assert sum(r["pct_of_change"] for r in rows.values()) == pytest.approx(100)


def test_average_annual_growth(by_category):
    row = drivers.average_annual_growth(pmpm.pmpm_total(by_category)).first()
    assert round(row["annual_growth_pct"], 2) == 3.08


def test_slices(spark, mm_fact):
    kept = drivers.fact_slice(mm_fact, {"dual": False}, ["yr"], ["ab_ffs_mm"])
    assert values(kept) == [(yr, 100) for yr in YEARS]
    members = spark.createDataFrame(
        [(2016, "all", "all", "all", 5), (2016, "true", "all", "all", 3), (2016, "true", "<65", "all", 2)],
        "yr int, dual string, age_band string, sex string, members bigint",
    )
    assert values(drivers.members_slice(members, {"dual": "true"})) == [(2016, 3)]
    assert values(drivers.members_slice(members, {})) == [(2016, 5)]
