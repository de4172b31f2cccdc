import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from claimspark.functions import codes, labels, numbers, parsing
from tests.conftest import check, evaluate

A, B, C = "a", "b", "c"


def test_money_blank_counts_as_zero(spark):
    check(spark, parsing.parse_money(A), {"12.50": 12.5, " 7 ": 7.0, "": 0.0, "   ": 0.0, None: 0.0})


def test_int_blank_is_null(spark):
    check(spark, parsing.parse_int(A), {"071": 71, " 8 ": 8, "": None, " ": None, None: None})


def test_dirty_number_fails(spark):
    with pytest.raises(PySparkException):
        evaluate(spark, parsing.parse_money(A), ["12,50"])


def test_dates(spark):
    good = {f"05-{name}-2019": datetime.date(2019, m, 5) for m, name in enumerate(codes.MONTH_NAMES, start=1)}
    # Read by position: separators and anything after the year do not matter.
    good |= {"05/Mar/2019": datetime.date(2019, 3, 5), "05-Mar-2019 00:00": datetime.date(2019, 3, 5)}
    unknown_month = {"05-MAR-2019": None, "05-Foo-2019": None, "5-Mar-2019": None, "": None, None: None}
    check(spark, parsing.parse_claim_date(A), good | unknown_month)


def test_impossible_day_fails(spark):
    with pytest.raises(PySparkException):
        evaluate(spark, parsing.parse_claim_date(A), ["31-Feb-2019"])


def test_bill_type_needs_both_parts(spark):
    check(spark, parsing.bill_type(A, B), {("1", "3"): "13", ("1", None): None, (None, "3"): None})


def test_blank(spark):
    check(spark, parsing.is_blank(A), {None: True, "": True, "  ": True, "A": False})


def test_part_ab_ffs(spark):
    check(
        spark,
        labels.in_part_ab_ffs(A, B),
        {
            ("3", "0"): True,
            ("C", None): True,
            ("3", ""): False,
            ("3", "1"): False,
            ("1", "0"): False,
            ("", "0"): False,
        },
    )


def test_part_d(spark):
    check(
        spark,
        labels.in_part_d(A),
        {"S1234": True, "": True, "0": False, "N": False, "X": False, None: False},
    )


def test_dual(spark):
    yes = dict.fromkeys(("01", "02", "03", "04", "05", "06", "08"), True)
    check(spark, labels.is_dual(A), yes | dict.fromkeys(("07", "09", "00", "1", "", None), False))


def test_age_band(spark):
    check(
        spark,
        labels.age_band("cast(a AS int)"),
        {"64": "<65", "65": "65-74", "74": "65-74", "75": "75-84", "84": "75-84", "85": "85+", None: "85+"},
    )


def test_sex(spark):
    check(spark, labels.sex_label(A), {"1": "Male", "2": "Female", "0": "Unknown", None: "Unknown"})


def test_list_sizes():
    bills = " ".join(codes.BILL_TYPE_CATEGORY.values()).split()
    assert len(bills) == len(set(bills)) == 48
    settings = " ".join(codes.BILL_TYPE_SUBCATEGORY.values()).split()
    # Nine outpatient bill types have a category but no setting of their own.
    assert set(bills) - set(settings) == {"53", "54", "63", "64", "72", "74", "75", "79", "89"}
    assert set(settings) <= set(bills)
    services = " ".join(codes.SERVICE_CODES.values()).split() + list(codes.FACILITY_ONLY_SERVICE_CODES.values())
    assert len(services) == len(set(services)) == 133
    assert len(codes.SERVICE_CODES) + len(codes.FACILITY_ONLY_SERVICE_CODES) == 14
    assert len(codes.PLACES_OF_SERVICE) == 13
    assert len(codes.SPECIALTIES) == 6
    assert len(codes.WELLNESS_CODES) == 18
    wellness_group = set(codes.SERVICE_CODES["Preventive / wellness visit"].split())
    assert wellness_group - set(codes.WELLNESS_CODES) == {"S9117"}


CATEGORIES = {
    ("pde", None, None): ("Retail Pharmacy", "Prescription drugs (Part D)"),
    ("dme", None, "11"): ("Other", "Durable medical equipment"),
    ("carrier", None, "21"): ("Professional", "Inpatient/outpatient hospital setting"),
    ("carrier", None, "02"): ("Professional", "Office (incl. telehealth)"),
    ("carrier", None, "20"): ("Professional", "Urgent care"),
    ("carrier", None, "17"): ("Professional", "Retail clinic"),
    ("carrier", None, "72"): ("Professional", "FQHC/RHC"),
    ("carrier", None, "65"): ("Professional", "Services at home"),
    ("carrier", None, "34"): ("Professional", "Nursing facility / hospice setting"),
    ("carrier", None, "99"): ("Professional", "Other professional"),
    ("carrier", None, None): ("Professional", "Other professional"),
    ("inpatient", "41", None): ("Inpatient Hospital", "Acute care hospital"),
    ("outpatient", "13", None): ("Outpatient Hospital", "Hospital outpatient"),
    ("outpatient", "83", None): ("Outpatient Hospital", "Freestanding facility"),
    ("outpatient", "77", None): ("Outpatient Hospital", "FQHC/RHC"),
    ("outpatient", "53", None): ("Outpatient Hospital", "Other facility"),
    ("hha", "33", None): ("Professional", "Home health"),
    ("hospice", "82", None): ("Long-Term Care", "Hospice"),
    ("snf", "21", None): ("Long-Term Care", "Skilled nursing facility"),
    ("snf", "18", None): ("Long-Term Care", "Swing beds"),
    ("snf", "86", None): ("Long-Term Care", "Residential facility"),
    ("snf", "67", None): ("Long-Term Care", "Intermediate care facility"),
    ("snf", "99", None): ("Other", "Other facility"),
    ("snf", None, None): ("Other", "Other facility"),
}


def test_categories(spark):
    check(
        spark,
        labels.service_category(A, B),
        {cells: category for cells, (category, _) in CATEGORIES.items()},
    )
    check(
        spark,
        labels.subcategory(A, B, C),
        {cells: setting for cells, (_, setting) in CATEGORIES.items()},
    )


def test_type_of_service(spark):
    check(
        spark,
        labels.type_of_service(A, B),
        {
            ("carrier", "M1A"): "E&M",
            ("carrier", "P1A"): "Procedures",
            ("carrier", "I1A"): "Imaging",
            ("carrier", "T1A"): "Tests",
            ("carrier", "D1A"): "DME",
            ("carrier", "O1A"): "Other",
            ("carrier", "Y1"): "Exceptions/unclassified",
            ("carrier", ""): "Exceptions/unclassified",
            ("carrier", None): "Unclassified",
            ("dme", "D1A"): None,
            ("inpatient", None): None,
        },
    )


def test_number_text(spark):
    value = F.col(A).cast("double")
    check(spark, numbers.number_text(value, 0), {"1205848778.2": "1205848778.0"})
    check(spark, numbers.number_text(value, 1), {"93.66": "93.7", "100": "100.0", None: None})
    check(spark, numbers.number_text(value, 2), {"0.004": "0.0", "0.01": "0.01", "0.10": "0.1", "12": "12.0"})


def test_ratio_of_zero_is_null(spark):
    check(spark, numbers.ratio(F.col(A).cast("int"), F.col(B).cast("int")), {("5", "0"): None, ("5", "2"): 2.5})


def test_growth(spark):
    value, base = F.col(A).cast("double"), F.col(B).cast("double")
    pair = [("121", "100")]
    assert evaluate(spark, numbers.growth_pct(value, base), pair) == [pytest.approx(21)]
    assert evaluate(spark, numbers.annual_growth(value, base, F.lit(2)), pair) == [pytest.approx(0.1)]


def test_rounding_is_done_once(spark):
    """0.4449 is 0.44 in cents; rounded to four digits and then to two it would be too, but 0.44499 would not."""
    check(spark, numbers.round_half_up(F.col(A).cast("decimal(18,5)"), 2), {"0.44499": 0.44, "0.445": 0.45, "-0.445": -0.45})


def test_money_is_exact_or_fails(spark):
    check(spark, parsing.parse_money(A), {"0.1": Decimal("0.1"), " 12.3456 ": Decimal("12.3456"), " ": 0, None: 0, "1e3": 1000})
    with pytest.raises(Exception, match="more than four decimals"):
        evaluate(spark, parsing.parse_money(A), [("0.12345",)])


def test_sums_do_not_depend_on_the_order(spark):
    """Doubles added over 1 and 13 partitions differ, the amounts do not."""
    cents = spark.range(0, 400_000, 1, 1).select(
        F.concat((F.col("id") * 7919 % 9_999_991).cast("string"), F.lit("."), F.lpad((F.col("id") % 100).cast("string"), 2, "0")).alias("a"),
        "id",
    )
    as_double, as_money = F.sum(F.col("a").cast("double")), F.sum(parsing.parse_money("a"))
    seen = {
        tuple(cents.repartition(n, F.hash("id")).groupBy().agg(as_double, as_money).first()) for n in (1, 13, 64)
    }
    assert len({s[0] for s in seen}) > 1 and len({s[1] for s in seen}) == 1


# Strict and permissive cells

AMOUNTS = {
    "12.50": None, " 7 ": None, "": None, " ": None, None: None, "1e3": None, "0.12340": None, "-3.1": None,
    "12,50": "not an amount", "n/a": "not an amount", "0.12345": "more than four decimals", "1e-5": "more than four decimals",
    "123456789012345": "too large", "99999999999999.9999": None,
}


def test_problems_of_cells(spark):
    check(spark, parsing.problem_of(A, "money"), AMOUNTS)
    check(spark, parsing.problem_of(A, "int"), {"7": None, " 7 ": None, "": None, None: None, "x": "not a whole number", "99999999999": "not a whole number"})
    check(spark, parsing.problem_of(A, "date"), {"01-Mar-2018": None, None: None, "31-Feb-2018": "no such day", "01-Foo-2018": "unknown month", "": "unknown month"})


def test_permissive_cells_count_as_blank(spark):
    want = {a: Decimal(0) if p in ("not an amount", "too large") else Decimal(str(float(a))) if p is None and (a or "").strip() else 0 for a, p in AMOUNTS.items()}
    want |= {"0.12345": Decimal("0.1235"), "1e-5": Decimal(0), "99999999999999.9999": Decimal("99999999999999.9999")}
    check(spark, parsing.parse_money(A, strict=False), want)
    check(spark, parsing.parse_int(A, strict=False), {"x": None, "7": 7, "": None})
    got = evaluate(spark, parsing.parse_claim_date(A, strict=False).cast("string"), ["31-Feb-2018", "01-Mar-2018", "01-Foo-2018", None])
    assert got == [None, "2018-03-01", None, None]


def test_what_is_reported_is_what_fails(spark):
    for amount, problem in AMOUNTS.items():
        if problem:
            with pytest.raises(Exception):
                evaluate(spark, parsing.parse_money(A), [amount])


def test_an_amount_is_parsed_once(spark):
    """Only a cell with more digits after its point, or an exponent, meets a second cast."""
    plan = spark.createDataFrame([("1",)], "a string").select(parsing.parse_money(A))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("as double") == 2 and "instr" in plan
