"""DuckDB SQL for every query, over the given tables.

Written apart from the Spark code: claim headers come straight from ``orders`` instead of being collapsed from lines,
amounts and flags come from the arithmetic of FIXTURES.md instead of from text, and member months are generated
rather than unpivoted. Each query is put together from the named parts it mentions.
"""

from __future__ import annotations

import re

# Service codes of primary care by group; the last group's code counts on facility claims only.
SERVICE_CODES = (
    (
        "Advance care planning",
        "professional_or_facility",
        (
            "99497", "99498",
        ),
    ),
    (
        "Care management",
        "professional_or_facility",
        (
            "99424", "99425", "99426", "99427", "99437", "99491", "99439", "99483", "99487", "99489", "99490", "99495",
            "99496", "G0505", "G0506",
        ),
    ),
    (
        "FQHC / clinic visit",
        "professional_or_facility",
        (
            "G0466", "G0467", "T1015",
        ),
    ),
    (
        "Health risk assessment",
        "professional_or_facility",
        (
            "96160", "96161",
        ),
    ),
    (
        "Home visit",
        "professional_or_facility",
        (
            "99339", "99340", "99341", "99342", "99343", "99344", "99345", "99347", "99348", "99349", "99350",
        ),
    ),
    (
        "Immunization administration",
        "professional_or_facility",
        (
            "90460", "90461", "90471", "90472", "90473", "90474", "G0008", "G0009", "G0010",
        ),
    ),
    (
        "Interprofessional consult",
        "professional_or_facility",
        (
            "99446", "99447", "99448", "99449", "99451", "99452",
        ),
    ),
    (
        "Office visit",
        "professional_or_facility",
        (
            "99201", "99202", "99203", "99204", "99205", "99211", "99212", "99213", "99214", "99215",
        ),
    ),
    (
        "Preventive / wellness visit",
        "professional_or_facility",
        (
            "99381", "99382", "99383", "99384", "99385", "99386", "99387", "99391", "99392", "99393", "99394", "99395",
            "99396", "99397", "G0402", "G0438", "G0439", "G0468", "S9117",
        ),
    ),
    (
        "Prolonged service",
        "professional_or_facility",
        (
            "99358", "99359", "99360", "99417", "G0513", "G0514", "G2212",
        ),
    ),
    (
        "Screening / counseling",
        "professional_or_facility",
        (
            "99078", "99173", "99401", "99402", "99403", "99404", "99406", "99407", "99408", "99409", "99411", "99412",
            "99420", "99429", "G0102", "G0396", "G0397", "G0436", "G0437", "G0442", "G0443", "G0444",
        ),
    ),
    (
        "Team conference / care plan oversight",
        "professional_or_facility",
        (
            "99366", "99367", "99368", "99374", "99375", "99376", "99377", "99378", "99379", "99380", "G0179", "G0180",
            "G0181", "G0182",
        ),
    ),
    (
        "Telephone / digital E&M",
        "professional_or_facility",
        (
            "98966", "98967", "98968", "98970", "98971", "98972", "99421", "99422", "99423", "99441", "99442", "99443",
        ),
    ),
    ("Hospital outpatient clinic visit (facility)", "facility_only", ("G0463",)),
)

# Name and note of each check.
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
ROWS_NOTE = "Institutional files collapse to one row per CLM_ID; line files keep every line"
CATEGORY_NOTE = "Unmapped bill types would land in Other facility"
DOLLARS_NOTE = "Categorization must not add or drop dollars"
SHARE_NOTE = "Claims outside A+B FFS (or Part D) eligibility are excluded from PMPM"
MONTHS_NOTE = "Annual fields count A and B separately (least of the two); monthly flags need both in the same month"
REBUILD_NOTE = "Dashboard/Tableau fact tables give the same PMPM as the SQL views"
WELLNESS_NOTE = "Synthetic carrier file has no wellness visits, so the rule would drop every physician; skipped"
OFFICE_NOTE = (
    "Office E&M visits are the core of the primary care definition; without them primary care share is understated"
)
DIALYSIS_NOTE = "Dialysis claims make up a large share of outpatient spend in the synthetic file"
FACILITY_NOTE = "Step 6 logic runs but the synthetic outpatient file only has bill type 13x and no G0463"

PARTS: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def _words(sql: str) -> set[str]:
    return set(re.findall(r"[a-z_0-9]+", re.sub(r"'[^']*'", "", sql)))


def oracle(name: str, sql: str) -> None:
    """Put the parts ``sql`` needs, directly or not, in front of it; a part only uses parts defined before it."""
    wanted, words = [], _words(sql)
    for candidate in reversed(PARTS):
        if candidate in words:
            wanted.insert(0, candidate)
            words |= _words(PARTS[candidate])
    head = ",\n".join(f"{p} AS (\n{PARTS[p]}\n)" for p in wanted)
    ORACLE[name] = f"WITH {head}\n{sql.strip()}" if wanted else sql.strip()


def pick(index: str, values: list[str | None]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {index} {whens} END"


def cents(x: str) -> str:
    return f"CAST(round({x}, 2) AS DOUBLE)"


def total(column: str) -> str:
    return f"{cents(f'sum({column})')} AS {column}"


def rounded(x: str, digits: int) -> str:
    # Adding 0 turns a negative zero into a plain one.
    return f"round({x}, {digits}) + 0.0"


def number_text(x: str, digits: int) -> str:
    return f"CAST(CAST(round({x}, {digits}) AS DOUBLE) AS VARCHAR)"


# Enrollment

part(
    "person_year",
    """
SELECT c_custkey AS c, y AS yr,
       CASE WHEN c_custkey % 10 = 0 THEN '0' WHEN c_custkey % 10 <= 4 THEN '1' ELSE '2' END AS sex_cd,
       CASE WHEN c_custkey % 53 = 0 OR c_custkey % 59 = 0 THEN NULL ELSE 50 + c_custkey % 45 + y - 2016 END AS age
FROM customer, range(2015, 2024) AS t(y)
""",
)
part(
    "person_month",
    f"""
SELECT c, yr, CAST(m AS INTEGER) AS mo, sex_cd, age,
       {pick("(c * 13 + yr * 7 + m * 3) % 20", [None, "1", "0", "C", "C"] + ["3"] * 15)} AS buyin_cd,
       {pick("(c + yr + m) % 17", ["1", None] + ["0"] * 15)} AS hmo_cd,
       {pick("(c * 5 + yr + m) % 9", ["0", "N", "X", None] + ["S1234"] * 5)} AS ptd_cd,
       {pick("(c * 3 + m) % 11", [None, "00", "07", "01", "08", "02"] + ["00"] * 5)} AS dual_cd
FROM person_year, range(1, 13) AS t(m)
""",
)
part(
    "enrolled",
    """
SELECT CAST(c AS VARCHAR) AS bene_id, CAST(yr AS INTEGER) AS yr, mo, buyin_cd, hmo_cd, ptd_cd, dual_cd,
       (buyin_cd = '3' OR buyin_cd = 'C') AND hmo_cd IS DISTINCT FROM '1' AS ab_ffs,
       coalesce(ptd_cd = 'S1234', FALSE) AS partd,
       coalesce(dual_cd = '01' OR dual_cd = '02' OR dual_cd = '08', FALSE) AS dual,
       CASE WHEN age IS NULL OR age > 84 THEN '85+' WHEN age > 74 THEN '75-84' WHEN age > 64 THEN '65-74'
            ELSE '<65' END AS age_band,
       CASE sex_cd WHEN '0' THEN 'Unknown' WHEN '1' THEN 'Male' ELSE 'Female' END AS sex
FROM person_month WHERE buyin_cd IS NOT NULL
""",
)

# Claims

part(
    "claim_head",
    """
SELECT o_orderkey AS key, o_custkey, o_orderkey % 8 AS k, o_orderkey // 8 AS q,
       o_orderdate + to_years(CASE WHEN o_orderkey % 47 = 0 THEN 20 WHEN o_orderkey % 53 = 0 THEN 22 ELSE 21 END) AS day,
       CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE CAST(day AS DATE) END AS svc_dt,
       CASE WHEN o_orderkey % 211 = 0 THEN strftime(day, '%d-Foo-%Y') ELSE strftime(day, '%d-%b-%Y') END AS day_text,
       o_orderkey % 29 <> 0 AS medicare_primary, o_orderkey % 31 <> 0 AS not_denied,
       CAST(o_totalprice AS DECIMAL(12, 2)) AS price,
       CAST(CASE WHEN o_orderkey % 37 = 0 OR o_orderkey % 41 = 0 THEN 0.0 ELSE o_orderkey % 1400 + 0.5 END
            + (o_orderkey * 7 % 300 + 0.25)
            + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 20 END AS DECIMAL(12, 2)) AS share
FROM orders
""",
)
part(
    "claim_row",
    """
SELECT h.*, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line,
       CAST(l_quantity AS DECIMAL(12, 2)) AS qty, CAST(l_extendedprice AS DECIMAL(12, 2)) AS ext
FROM claim_head h, lineitem WHERE h.key = l_orderkey
""",
)
part(
    "facility",
    """
SELECT h.*, ['inpatient', 'outpatient', 'snf', 'hha', 'hospice'][k + 1] AS src,
       CASE WHEN q % 101 = 0 THEN NULL WHEN q % 97 = 0 THEN '53'
            WHEN k = 0 THEN if(q % 5 = 0, '41', '11') WHEN k = 1 THEN if(q % 6 = 0, '77', '13')
            WHEN k = 2 THEN if(q % 4 = 0, '18', '21') WHEN k = 3 THEN if(q % 2 = 0, '32', '33')
            ELSE if(q % 2 = 0, '81', '82') END AS bill_type2
FROM claim_head h
WHERE k < 5 AND key IN (SELECT l_orderkey FROM lineitem)
""",
)
part(
    "supplier_row",
    f"""
SELECT r.*, f.src,
       {pick("supp % 9", ["11", "22", "19", "02", "50", "20", "17", "31", "12"])} AS pos_cd,
       {pick("supp % 8", ["01", "08", "11", "37", "50", "97", "06"])} AS spclty,
       {pick("part % 10", ["99213", "99202", "99215", "G0439", "99490", "99497", "G0442", "90471", "71046"])} AS hcpcs_cd,
       {pick("part % 8", ["M1A", "P1A", "I1A", "T1A", "D1A", "O1A", "Y1"])} AS betos_cd,
       CAST(if(part % 37 = 0, 0, qty) AS DECIMAL(12, 2)) AS paid_amount,
       CAST(if(part % 37 = 0, 0, ext) AS DECIMAL(12, 2)) AS allowed_amount
FROM claim_row r JOIN (VALUES (1, 'carrier'), (5, 'carrier'), (6, 'dme'), (7, 'pde')) f(k, src) ON f.k = r.k
""",
)
part(
    "standard",
    """
SELECT src, CAST(o_custkey AS VARCHAR) AS bene_id, CAST(key AS VARCHAR) AS clm_id, CAST(NULL AS INTEGER) AS line_num,
       svc_dt, bill_type2, NULL AS pos_cd, NULL AS spclty, NULL AS hcpcs_cd, NULL AS betos_cd, NULL AS rndrng_npi,
       NULL AS ndc, price AS paid,
       CAST(price + if(k < 3, share, 0) AS DECIMAL(12, 2)) AS allowed, medicare_primary,
       not_denied AS medicare_paid
FROM facility
UNION ALL
SELECT src, CAST(o_custkey AS VARCHAR), if(src = 'pde', key || '-' || line, CAST(key AS VARCHAR)),
       if(src = 'pde', NULL, line), svc_dt, NULL, if(src = 'pde', NULL, pos_cd), if(src = 'pde', NULL, spclty),
       if(src = 'pde', NULL, hcpcs_cd), if(src = 'pde', NULL, betos_cd),
       if(src = 'carrier' AND part % 41 <> 0, CAST(supp * 20 + (part // 100) % 20 AS VARCHAR), NULL),
       if(src = 'carrier', NULL, CAST(part AS VARCHAR)), paid_amount, allowed_amount,
       src = 'pde' OR medicare_primary, src = 'pde' OR line <> 7
FROM supplier_row
""",
)

# Categories. Category and setting by bill type, place of service and BETOS letter.

part(
    "bill_map",
    """
SELECT unnest(string_split(bills, ' ')) AS bill, category, setting FROM (VALUES
  ('11 41', 'Inpatient Hospital', 'Acute care hospital'),
  ('13 14 43 44 85 12', 'Outpatient Hospital', 'Hospital outpatient'),
  ('83 78 84 87', 'Outpatient Hospital', 'Freestanding facility'),
  ('71 77', 'Outpatient Hospital', 'FQHC/RHC'),
  ('53 54 63 64 72 74 75 79 89', 'Outpatient Hospital', 'Other facility'),
  ('32 33 34', 'Professional', 'Home health'),
  ('21 23 25 26 27 51 52', 'Long-Term Care', 'Skilled nursing facility'),
  ('18 28 48 58', 'Long-Term Care', 'Swing beds'),
  ('81 82', 'Long-Term Care', 'Hospice'),
  ('86', 'Long-Term Care', 'Residential facility'),
  ('16 17 45 47 55 57 65 67', 'Long-Term Care', 'Intermediate care facility')) AS t(bills, category, setting)
""",
)
part(
    "place_map",
    """
SELECT unnest(string_split(places, ' ')) AS place, setting FROM (VALUES
  ('19 21 22 23', 'Inpatient/outpatient hospital setting'), ('02 10 11', 'Office (incl. telehealth)'),
  ('20', 'Urgent care'), ('17', 'Retail clinic'), ('50 72', 'FQHC/RHC'), ('12 14 65', 'Services at home'),
  ('13 31 32 33 34', 'Nursing facility / hospice setting')) AS t(places, setting)
""",
)
part(
    "letter_map",
    """
FROM (VALUES ('M', 'E&M'), ('P', 'Procedures'), ('I', 'Imaging'), ('T', 'Tests'), ('D', 'DME'), ('O', 'Other'))
  AS t(letter, service)
""",
)
part(
    "categorized",
    """
SELECT s.*,
       CASE s.src WHEN 'pde' THEN 'Retail Pharmacy' WHEN 'dme' THEN 'Other' WHEN 'carrier' THEN 'Professional'
            ELSE coalesce(b.category, 'Other') END AS service_category,
       CASE s.src WHEN 'pde' THEN 'Prescription drugs (Part D)' WHEN 'dme' THEN 'Durable medical equipment'
            WHEN 'carrier' THEN coalesce(p.setting, 'Other professional')
            ELSE coalesce(b.setting, 'Other facility') END AS subcategory,
       CASE WHEN s.src = 'carrier' THEN coalesce(t.service, if(betos_cd IS NULL, 'Unclassified',
            'Exceptions/unclassified')) END AS type_of_service,
       CAST(year(svc_dt) AS INTEGER) AS yr, CAST(month(svc_dt) AS INTEGER) AS mo
FROM standard s
LEFT JOIN bill_map b ON b.bill = s.bill_type2
LEFT JOIN place_map p ON p.place = s.pos_cd
LEFT JOIN letter_map t ON t.letter = left(s.betos_cd, 1)
""",
)
part(
    "covered",
    """
SELECT c.*, e.dual, e.age_band, e.sex
FROM categorized c JOIN enrolled e USING (bene_id, yr, mo)
WHERE e.ab_ffs AND (e.partd OR c.src <> 'pde')
""",
)
part("eligible", "SELECT * FROM covered WHERE medicare_primary AND medicare_paid")

# Facts

part(
    "months_cell",
    """
SELECT yr, dual, age_band, sex, count(*) FILTER (ab_ffs) AS ab_ffs_mm, count(*) FILTER (ab_ffs AND partd) AS partd_mm
FROM enrolled WHERE yr >= 2016 AND yr <= 2022 GROUP BY ALL
""",
)
part(
    "spend_cell",
    """
SELECT yr, service_category, subcategory, ifnull(type_of_service, 'n/a') AS type_of_service, dual, age_band, sex,
       sum(allowed) AS allowed, sum(paid) AS paid, count(*) AS n_rows, count(DISTINCT bene_id) AS n_benes
FROM eligible WHERE yr >= 2016 AND yr <= 2022 GROUP BY ALL
""",
)
part(
    "year_months",
    "SELECT yr, CAST(sum(ab_ffs_mm) AS BIGINT) AS ab, CAST(sum(partd_mm) AS BIGINT) AS rx FROM months_cell GROUP BY yr",
)
part(
    "category_year",
    """
SELECT yr, service_category, sum(allowed) AS dollars, if(service_category = 'Retail Pharmacy', rx, ab) AS months
FROM spend_cell JOIN year_months USING (yr) GROUP BY yr, service_category, rx, ab
""",
)
part(
    "category_pmpm",
    """
SELECT yr, service_category, CAST(round(dollars, 0) AS DOUBLE) AS allowed, months AS member_months,
       round(CAST(dollars AS DOUBLE) / months, 2) AS pmpm
FROM category_year
""",
)
part(
    "total_pmpm_year",
    """
SELECT yr, sum(CAST(pmpm AS DECIMAL(18, 2))) FILTER (service_category <> 'Retail Pharmacy') AS medical,
       sum(CAST(pmpm AS DECIMAL(18, 2))) FILTER (service_category = 'Retail Pharmacy') AS rx
FROM category_pmpm GROUP BY yr
""",
)
part(
    "total_growth",
    f"""
SELECT yr, CAST(medical AS DOUBLE) AS medical_pmpm, CAST(rx AS DOUBLE) AS rx_pmpm,
       CAST(medical + rx AS DOUBLE) AS total_pmpm,
       {rounded("(CAST(medical + rx AS DOUBLE) / CAST(lag(medical + rx) OVER w AS DOUBLE) - 1) * 100", 1)}
         AS total_growth_pct
FROM total_pmpm_year WINDOW w AS (ORDER BY yr)
""",
)
part(
    "category_growth",
    f"""
SELECT yr, service_category, pmpm,
       {rounded("(pmpm / lag(pmpm) OVER w - 1) * 100", 1)} AS yoy_growth_pct,
       {rounded("pmpm - lag(pmpm) OVER w", 2)} AS yoy_change_pmpm,
       CASE WHEN yr <> 2016 THEN {rounded("((pmpm / first(pmpm) OVER w) ^ (1 / (yr - 2016)) - 1) * 100", 1)}
       END AS cagr_since_2016_pct
FROM category_pmpm WINDOW w AS (PARTITION BY service_category ORDER BY yr)
""",
)
part(
    "stay_cell",
    """
SELECT yr, dual, age_band, sex, count(*) AS stays, sum(allowed) AS allowed
FROM eligible WHERE service_category = 'Inpatient Hospital' AND yr >= 2016 AND yr <= 2022 GROUP BY ALL
""",
)
part(
    "member_count",
    """
SELECT yr, if(grouping(dual) = 1, 'all', CAST(dual AS VARCHAR)) AS dual,
       if(grouping(age_band) = 1, 'all', age_band) AS age_band, if(grouping(sex) = 1, 'all', sex) AS sex,
       count(DISTINCT bene_id) AS members
FROM enrolled WHERE ab_ffs AND yr >= 2016 AND yr <= 2022
GROUP BY GROUPING SETS ((yr, dual, age_band, sex), (yr, dual, age_band), (yr, dual, sex), (yr, age_band, sex),
                        (yr, dual), (yr, age_band), (yr, sex), (yr))
""",
)

# Primary care

_service_rows = ", ".join(
    f"('{code}', '{claim_type}', '{group}')" for group, claim_type, members in SERVICE_CODES for code in members
)
part(
    "service_list",
    f"""
FROM (VALUES {_service_rows}) AS t(hcpcs_cd, claim_type, service_group)
""",
)
part(
    "wellness_line",
    """
SELECT * FROM eligible WHERE src = 'carrier' AND hcpcs_cd IN (
  SELECT hcpcs_cd FROM service_list WHERE service_group = 'Preventive / wellness visit' AND hcpcs_cd <> 'S9117')
""",
)
part("wellness_npi", "SELECT rndrng_npi FROM wellness_line GROUP BY rndrng_npi")
part(
    "professional",
    """
SELECT e.*, s.service_group, if(spclty IN ('50', '97'), '0', '1') AS is_physician
FROM eligible e, service_list s
WHERE e.src = 'carrier' AND s.hcpcs_cd = e.hcpcs_cd AND s.claim_type <> 'facility_only'
  AND spclty IN ('01', '08', '11', '37', '50', '97')
  AND pos_cd IN ('02', '03', '10', '11', '12', '13', '14', '19', '22', '32', '33', '34', '50')
""",
)
part(
    "qualified",
    """
SELECT p.* EXCLUDE (is_physician) FROM professional p
WHERE is_physician = '0' OR NOT EXISTS (FROM wellness_npi)
   OR EXISTS (FROM wellness_npi w WHERE w.rndrng_npi = p.rndrng_npi)
""",
)
part(
    "clinic_line",
    f"""
SELECT CAST(r.o_custkey AS VARCHAR) AS bene_id,
       {pick("part % 5", ["G0463", "90935", "G0466", "99213"])} AS hcpcs_cd, f.bill_type2, r.svc_dt,
       CAST(ext + if(part % 37 = 0, 0, qty) + if(line = 4, 0, line) AS DECIMAL(12, 2)) AS allowed
FROM claim_row r JOIN facility f ON f.key = r.key AND f.src = 'outpatient'
WHERE part % 5 = 0 OR f.bill_type2 LIKE '7%'
""",
)
part(
    "split_line",
    """
SELECT bene_id, svc_dt, allowed FROM clinic_line
WHERE hcpcs_cd = 'G0463' AND bill_type2 = '13' AND (bene_id, svc_dt) IN (
  SELECT (bene_id, svc_dt) FROM qualified WHERE pos_cd IN ('19', '22') AND hcpcs_cd >= '99201' AND hcpcs_cd <= '99215')
""",
)
part(
    "fqhc_line",
    """
SELECT bene_id, svc_dt, allowed FROM clinic_line
WHERE bill_type2 = '77' AND hcpcs_cd IN (SELECT hcpcs_cd FROM service_list)
""",
)
part("facility_line", "SELECT year(svc_dt) AS yr, allowed FROM (FROM split_line UNION ALL FROM fqhc_line)")
part(
    "care_year",
    """
SELECT yr, ifnull(pc, 0) + ifnull(fc, 0) AS dollars, ifnull(n, 0) AS n, medical, spent, ab
FROM (SELECT yr, sum(allowed) FILTER (service_category <> 'Retail Pharmacy') AS medical, sum(allowed) AS spent
      FROM spend_cell GROUP BY yr)
JOIN year_months USING (yr)
LEFT JOIN (SELECT yr, sum(allowed) AS pc, count(*) AS n FROM qualified GROUP BY yr) USING (yr)
LEFT JOIN (SELECT yr, sum(allowed) AS fc FROM facility_line GROUP BY yr) USING (yr)
""",
)
part(
    "rebuilt",
    """
SELECT yr, service_category, CAST(sum(allowed) AS DOUBLE) / any_value(if(service_category = 'Retail Pharmacy', rx, ab)) AS rebuilt
FROM spend_cell JOIN year_months USING (yr) GROUP BY yr, service_category
""",
)
part(
    "dialysis_sum",
    """
SELECT sum(allowed) FILTER (clm_id IN (SELECT CAST(key AS VARCHAR) FROM claim_row WHERE k = 1 AND part % 5 = 1))
         AS dialysis,
       sum(allowed) AS total
FROM eligible WHERE src = 'outpatient' AND yr >= 2016 AND yr <= 2022
""",
)

# Checks

part("raw_count", """
SELECT src, count(*) AS n FROM facility GROUP BY src UNION ALL SELECT src, count(*) FROM supplier_row GROUP BY src
""")


def check(name: str, sql: str) -> None:
    part(f"report_{name}", sql)
    oracle(f"check_{name}", f"SELECT * FROM report_{name}")


check("row_counts", f"""
SELECT 1 AS id, concat('{ROWS_NAME}', src) AS check_name, CAST(r.n AS VARCHAR) AS expected,
       CAST(s.n AS VARCHAR) AS actual, if(r.n = s.n, 'PASS', 'FAIL') AS status,
       '{ROWS_NOTE}' AS note
FROM raw_count r JOIN (SELECT src, count(*) AS n FROM standard GROUP BY src) s USING (src)
""")
check("unmapped", f"""
SELECT 2 AS id, '{CATEGORY_NAME}' AS check_name, '0' AS expected, CAST(count(*) AS VARCHAR) AS actual,
       if(count(*) = 0, 'PASS', 'FAIL') AS status, '{CATEGORY_NOTE}' AS note
FROM categorized WHERE subcategory = 'Other facility'
""")
check("dollars_preserved", f"""
SELECT 3 AS id, '{DOLLARS_NAME}' AS check_name, {number_text("b.t", 0)} AS expected,
       {number_text("a.t", 0)} AS actual, if(abs(b.t - a.t) < 1, 'PASS', 'FAIL') AS status,
       '{DOLLARS_NOTE}' AS note
FROM (SELECT sum(allowed) AS t FROM standard) b, (SELECT sum(allowed) AS t FROM categorized) a
""")
check("eligible_share", f"""
SELECT 4 AS id, concat('{SHARE_NAME}', src) AS check_name, '>= 90%' AS expected,
       {number_text("CAST(100 * kept AS DOUBLE) / CAST(spent AS DOUBLE)", 1)} || '%' AS actual,
       if(coalesce(CAST(kept AS DOUBLE) / CAST(spent AS DOUBLE) >= 0.9, FALSE), 'PASS', 'FLAG') AS status,
       '{SHARE_NOTE}' AS note
FROM (SELECT src, sum(allowed) AS spent FROM categorized WHERE yr >= 2016 AND yr <= 2022 GROUP BY src)
LEFT JOIN (SELECT src, sum(allowed) AS kept FROM eligible WHERE yr >= 2016 AND yr <= 2022 GROUP BY src) USING (src)
""")
check("monthly_vs_annual", f"""
SELECT 5 AS id, '{MONTHS_NAME}' AS check_name, CAST(a.t AS VARCHAR) AS expected,
       CAST(m.t AS VARCHAR) AS actual, if(abs(m.t - a.t) < 0.1 * a.t, 'PASS', 'FLAG') AS status,
       '{MONTHS_NOTE}' AS note
FROM (SELECT sum(6 + c % 7) AS t FROM person_year WHERE yr >= 2016 AND yr <= 2022) a,
     (SELECT count(*) AS t FROM enrolled WHERE ab_ffs AND yr >= 2016 AND yr <= 2022) m
""")
check("pmpm_rebuild", f"""
SELECT 6 AS id, '{REBUILD_NAME}' AS check_name, '0.00' AS expected,
       {number_text("max(abs(pmpm - rebuilt))", 2)} AS actual,
       if(max(abs(pmpm - rebuilt)) < 0.01, 'PASS', 'FAIL') AS status,
       '{REBUILD_NOTE}' AS note
FROM category_pmpm JOIN rebuilt USING (yr, service_category)
""")
check("wellness", f"""
SELECT 7 AS id, '{WELLNESS_NAME}' AS check_name, 'wellness visits > 0' AS expected,
       concat(count(*), ' NPIs with wellness visits') AS actual, if(count(*) > 0, 'PASS', 'FLAG') AS status,
       '{WELLNESS_NOTE}' AS note
FROM wellness_npi
""")
check("office_em", f"""
SELECT 8 AS id, '{OFFICE_NAME}' AS check_name, '> 0' AS expected,
       CAST(count(*) AS VARCHAR) AS actual, if(count(*) > 0, 'PASS', 'FLAG') AS status,
       '{OFFICE_NOTE}'
         AS note
FROM eligible WHERE src = 'carrier' AND hcpcs_cd >= '99202' AND hcpcs_cd <= '99215'
""")
check("dialysis_share", f"""
SELECT 9 AS id, '{DIALYSIS_NAME}' AS check_name, 'informational' AS expected,
       {number_text("CAST(100 * dialysis AS DOUBLE) / CAST(total AS DOUBLE)", 1)} || '%' AS actual, 'FLAG' AS status,
       '{DIALYSIS_NOTE}' AS note
FROM dialysis_sum
""")
check("pc_facility", f"""
SELECT 10 AS id, '{FACILITY_NAME}' AS check_name, '> 0' AS expected,
       CAST(count(*) AS VARCHAR) AS actual, if(count(*) > 0, 'PASS', 'FLAG') AS status,
       '{FACILITY_NOTE}' AS note
FROM facility_line
""")
part("all_reports", " UNION ALL ".join(f"FROM {p}" for p in PARTS if p.startswith("report_")))
oracle("validation", "SELECT * FROM all_reports")
oracle("union_checks", "SELECT id, status, count(*) AS n FROM all_reports GROUP BY id, status")

# Sources and sinks

_months = [f"{m:02d}" for m in range(1, 13)]
_families = {
    "MDCR_ENTLMT_BUYIN_IND": "buyin_cd",
    "HMO_IND": "hmo_cd",
    "PTD_CNTRCT_ID": "ptd_cd",
    "DUAL_STUS_CD": "dual_cd",
}
oracle(
    "scan_enrollment",
    f"""
SELECT CAST(c AS VARCHAR) AS "BENE_ID", CAST(yr AS VARCHAR) AS "BENE_ENROLLMT_REF_YR",
       any_value(sex_cd) AS "SEX_IDENT_CD",
       CASE WHEN c % 53 = 0 THEN NULL WHEN c % 59 = 0 THEN ' ' ELSE CAST(any_value(age) AS VARCHAR) END
         AS "AGE_AT_END_REF_YR",
       if(c % 61 = 0, NULL, '12') AS "BENE_HI_CVRAGE_TOT_MONS", CAST(6 + c % 7 AS VARCHAR) AS "BENE_SMI_CVRAGE_TOT_MONS",
       {", ".join(f'max({col}) FILTER (mo = {int(mm)}) AS "{fam}_{mm}"' for fam, col in _families.items() for mm in _months)}
FROM person_month GROUP BY c, yr
""",
)
oracle(
    "scan_claims",
    """
SELECT f.src, CAST(r.key AS VARCHAR) AS clm_id, CAST(r.o_custkey AS VARCHAR) AS bene_id, r.day_text,
       CAST(r.price AS VARCHAR) AS paid_text, CAST(r.price AS VARCHAR) AS allowed_text
FROM claim_row r JOIN facility f USING (key)
UNION ALL
SELECT src, if(src = 'pde', key || '-' || line, CAST(key AS VARCHAR)), CAST(o_custkey AS VARCHAR), day_text,
       if(part % 37 = 0, ' ', CAST(qty AS VARCHAR)), if(part % 37 = 0, ' ', CAST(ext AS VARCHAR))
FROM supplier_row
""",
)
oracle(
    "scan_code_lists",
    """
SELECT s.*, (SELECT count(*) FROM supplier_row r WHERE r.src = 'carrier' AND r.hcpcs_cd = s.hcpcs_cd) AS lines
FROM service_list s
""",
)
oracle("inline_values", "SELECT mo, count(*) AS person_years, count(buyin_cd) AS entitled FROM person_month GROUP BY mo")
oracle("materialize", "SELECT yr, count(*) AS n, count(*) FILTER (ab_ffs) AS ab_ffs FROM enrolled GROUP BY yr")
oracle("derived_view", "SELECT yr, count(*) AS categories, max(pmpm) AS highest_pmpm FROM category_pmpm GROUP BY yr")
oracle(
    "export_csv",
    """
SELECT CAST(yr AS VARCHAR) AS yr, service_category, CAST(CAST(allowed AS BIGINT) AS VARCHAR) || '.0' AS allowed,
       CAST(member_months AS VARCHAR) AS member_months, CAST(pmpm AS VARCHAR) AS pmpm
FROM category_pmpm
""",
)
oracle(
    "stacked_fact_export",
    f"""
SELECT 'spend' AS fact, yr, service_category, subcategory, type_of_service, dual, age_band, sex,
       {cents("allowed")} AS allowed, {cents("paid")} AS paid, n_rows, n_benes, NULL::BIGINT AS ab_ffs_mm,
       NULL::BIGINT AS partd_mm, NULL::VARCHAR AS service_group, NULL::BIGINT AS services
FROM spend_cell
UNION ALL BY NAME
SELECT 'mm' AS fact, * FROM months_cell
UNION ALL BY NAME
SELECT 'pc' AS fact, yr, service_group, dual, age_band, sex, {total("allowed")}, count(*) AS services
FROM qualified WHERE yr >= 2016 AND yr <= 2022 GROUP BY yr, service_group, dual, age_band, sex
""",
)

# Projections and scalar functions

oracle(
    "parse_int",
    "SELECT CAST(c AS VARCHAR) AS bene_id, CAST(yr AS INTEGER) AS yr, CAST(ifnull(age, -1) AS INTEGER) AS age FROM person_year",
)
oracle(
    "parse_money",
    """
SELECT f.src, CAST(r.key AS VARCHAR) AS clm_id, CAST(r.price AS DOUBLE) AS paid, CAST(r.price AS DOUBLE) AS allowed
FROM claim_row r JOIN facility f USING (key)
UNION ALL
SELECT src, if(src = 'pde', key || '-' || line, CAST(key AS VARCHAR)), CAST(paid_amount AS DOUBLE),
       CAST(allowed_amount AS DOUBLE)
FROM supplier_row
""",
)
oracle(
    "parse_claim_date",
    """
SELECT f.src, CAST(r.key AS VARCHAR) AS clm_id, CAST(r.svc_dt AS VARCHAR) AS svc_dt FROM claim_row r JOIN facility f USING (key)
UNION ALL
SELECT src, if(src = 'pde', key || '-' || line, CAST(key AS VARCHAR)), CAST(svc_dt AS VARCHAR) FROM supplier_row
""",
)
oracle(
    "concat_bill_type",
    "SELECT f.src, bill_type2, count(*) AS n FROM claim_row r JOIN facility f USING (key) GROUP BY ALL",
)
oracle(
    "eligibility_flags",
    "SELECT buyin_cd, hmo_cd, ptd_cd, dual_cd, ab_ffs, partd, dual, count(*) AS n FROM enrolled GROUP BY ALL",
)
oracle(
    "age_band",
    """
SELECT CASE WHEN c % 53 = 0 THEN NULL WHEN c % 59 = 0 THEN ' ' ELSE CAST(age AS VARCHAR) END AS age_text,
       CASE WHEN age BETWEEN 0 AND 64 THEN '<65' WHEN age BETWEEN 65 AND 74 THEN '65-74'
            WHEN age BETWEEN 75 AND 84 THEN '75-84' ELSE '85+' END AS age_band,
       count(*) AS n
FROM person_year GROUP BY ALL
""",
)
oracle(
    "decode_sex",
    "SELECT sex_cd, ['Unknown', 'Male', 'Female'][sex_cd::INT + 1] AS sex, count(*) AS n FROM person_year GROUP BY ALL",
)
oracle("blank_flag", "SELECT src, medicare_primary, medicare_paid, count(*) AS n FROM standard GROUP BY ALL")
oracle("allowed_amount", f"SELECT src, {total('paid')}, {total('allowed')} FROM standard GROUP BY src")
_padded = ("line_num", "bill_type2", "pos_cd", "spclty", "hcpcs_cd", "betos_cd", "rndrng_npi", "ndc")
oracle(
    "typed_null_pad", f"SELECT src, {', '.join(f'count({c}) AS {c}' for c in _padded)} FROM standard GROUP BY src"
)
oracle(
    "service_category",
    f"SELECT src, bill_type2, service_category, count(*) AS n, {total('allowed')} FROM categorized GROUP BY ALL",
)
oracle(
    "subcategory", "SELECT src, bill_type2, pos_cd, subcategory, count(*) AS n FROM categorized GROUP BY ALL"
)
oracle("type_of_service", "SELECT src, betos_cd, type_of_service, count(*) AS n FROM categorized GROUP BY ALL")
oracle(
    "date_parts", "SELECT src, ifnull(yr, 0) AS yr, ifnull(mo, 0) AS mo, count(*) AS n FROM categorized GROUP BY ALL"
)
oracle(
    "round_half_up",
    """
SELECT src, CAST(round(sum(allowed), 0) AS DOUBLE) AS whole, round(CAST(sum(allowed) AS DOUBLE) / count(*), 1) AS mean_1,
       round(CAST(sum(allowed) AS DOUBLE) / count(*), 2) AS mean_2
FROM standard GROUP BY src
""",
)
oracle(
    "safe_ratio",
    """
SELECT bene_id, count(*) FILTER (ab_ffs) AS months,
       ifnull(round(count(*) FILTER (ab_ffs AND dual) * 100.0 / nullif(count(*) FILTER (ab_ffs), 0), 1), -1) AS pct_dual
FROM enrolled GROUP BY bene_id
""",
)
oracle(
    "growth_arithmetic",
    f"""
SELECT src, yr, {rounded("(CAST(t AS DOUBLE) / CAST(lag(t) OVER w AS DOUBLE) - 1) * 100", 1)} AS growth_pct,
       {cents("t - lag(t) OVER w")} AS change,
       CASE WHEN yr > 2016
            THEN {rounded("((CAST(t AS DOUBLE) / CAST(first(t) OVER w AS DOUBLE)) ^ (1 / (yr - 2016)) - 1) * 100", 1)}
       END AS annual_pct
FROM (SELECT src, yr, sum(allowed) AS t FROM categorized WHERE yr >= 2016 AND yr <= 2022 GROUP BY ALL)
WINDOW w AS (PARTITION BY src ORDER BY yr)
""",
)
oracle(
    "abs_diff",
    """
SELECT yr, service_category, round(abs(pmpm - rebuilt), 4) AS d
FROM category_pmpm JOIN rebuilt USING (yr, service_category)
""",
)
oracle(
    "format_check_text",
    f"""
SELECT 'allowed: ' || src AS label, {number_text("t", 0)} AS whole, {number_text("t / n", 1)} || '%' AS one,
       {number_text("t / n", 2)} AS two
FROM (SELECT src, CAST(sum(allowed) AS DOUBLE) AS t, count(*) AS n FROM standard GROUP BY src)
""",
)
oracle(
    "string_range",
    """
SELECT hcpcs_cd, count(*) AS n, count(*) FILTER (hcpcs_cd >= '99201' AND hcpcs_cd <= '99215') AS visit,
       count(*) FILTER (hcpcs_cd >= '99202' AND hcpcs_cd <= '99215') AS office_em
FROM standard WHERE src = 'carrier' GROUP BY hcpcs_cd
""",
)
oracle(
    "null_label",
    "SELECT yr, ifnull(type_of_service, 'n/a') AS type_of_service, count(*) AS n FROM eligible GROUP BY ALL",
)
_standard_shown = (
    "src, bene_id, clm_id, line_num, CAST(svc_dt AS VARCHAR) AS svc_dt, bill_type2, pos_cd, spclty, hcpcs_cd, betos_cd, "
    f"rndrng_npi, ndc, {cents('paid')} AS paid, {cents('allowed')} AS allowed, medicare_primary, medicare_paid"
)
oracle("star_extend", f"SELECT {_standard_shown}, {cents('allowed - paid')} AS cost_share FROM standard")

# Filters

oracle("drop_unentitled_months", "SELECT yr, mo, count(*) AS n FROM enrolled GROUP BY yr, mo")
oracle("study_window", "SELECT yr, count(*) AS n FROM enrolled WHERE yr > 2015 AND yr < 2023 GROUP BY yr")
oracle(
    "payer_filter",
    f"SELECT src, count(*) AS n, {total('allowed')} FROM standard WHERE medicare_primary AND medicare_paid GROUP BY src",
)
oracle(
    "code_filter",
    """
SELECT src, hcpcs_cd, bill_type2, count(*) AS n
FROM (SELECT 'outpatient' AS src, hcpcs_cd, bill_type2 FROM clinic_line
      UNION ALL SELECT src, hcpcs_cd, bill_type2 FROM wellness_line)
GROUP BY ALL
""",
)

# Joins

oracle(
    "unpivot_months",
    "SELECT CAST(c AS VARCHAR) AS bene_id, CAST(yr AS INTEGER) AS yr, mo, buyin_cd, hmo_cd, ptd_cd, dual_cd FROM person_month",
)
oracle(
    "eligibility_join",
    f"SELECT src, clm_id, bene_id, yr, mo, {cents('allowed')} AS allowed, dual, age_band, sex FROM covered",
)
oracle(
    "code_list_join",
    f"""
SELECT clm_id, line_num, hcpcs_cd, spclty, pos_cd, {cents("allowed")} AS allowed, service_group FROM professional
""",
)
oracle(
    "specialty_lookup",
    f"SELECT spclty, is_physician, count(*) AS n, {total('allowed')} FROM professional GROUP BY ALL",
)
_line_shown = f"bene_id, CAST(svc_dt AS VARCHAR) AS svc_dt, {cents('allowed')} AS allowed"
oracle("facility_semi_join", f"SELECT {_line_shown} FROM split_line")
oracle("existence_in_or", f"SELECT yr, spclty, count(*) AS n, {total('allowed')} FROM qualified GROUP BY ALL")
oracle(
    "scalar_subquery_guard",
    f"""
SELECT yr, spclty, count(*) AS n, {total("allowed")}
FROM professional WHERE hcpcs_cd <> 'G0439' GROUP BY ALL
""",
)
oracle("fqhc_code_join", f"SELECT {_line_shown} FROM fqhc_line")
oracle(
    "year_dimension_join",
    f"""
SELECT yr, {total("allowed")}, any_value(ab) AS ab_ffs_mm, any_value(rx) AS partd_mm
FROM spend_cell JOIN year_months USING (yr) GROUP BY yr
""",
)
oracle(
    "left_join_default",
    f"""
SELECT bene_id, {cents("ifnull(t, 0)")} AS facility
FROM (SELECT DISTINCT bene_id FROM enrolled)
LEFT JOIN (SELECT bene_id, sum(allowed) AS t FROM split_line GROUP BY bene_id) USING (bene_id)
""",
)
oracle("in_subquery_in_aggregate", f"SELECT {cents('dialysis')} AS dialysis, {cents('total')} AS total FROM dialysis_sum")

# Aggregations

oracle(
    "collapse_claim_header",
    f"""
SELECT src, clm_id, bene_id, CAST(svc_dt AS VARCHAR) AS svc_dt, bill_type2, {cents("paid")} AS paid,
       {cents("allowed")} AS allowed, medicare_primary, medicare_paid
FROM standard WHERE src NOT IN ('carrier', 'dme', 'pde')
""",
)
oracle(
    "conditional_sum",
    """
SELECT mo, count(*) FILTER (ab_ffs) AS ab_ffs, count(*) FILTER (partd) AS partd, count(*) FILTER (ab_ffs AND dual) AS dual
FROM enrolled GROUP BY mo
""",
)
oracle(
    "group_sum_count",
    f"""
SELECT yr, src, dual, age_band, sex, count(*) AS n, {total("allowed")}, {total("paid")} FROM eligible GROUP BY ALL
""",
)
oracle("count_distinct", "SELECT src, n FROM raw_count")
oracle(
    "distinct_rows",
    "SELECT bene_id, CAST(svc_dt AS VARCHAR) AS svc_dt FROM eligible WHERE src = 'carrier' GROUP BY ALL",
)
oracle(
    "cube_members",
    """
SELECT yr, if(grouping(dual) = 1, 'all', CAST(dual AS VARCHAR)) AS dual,
       if(grouping(age_band) = 1, 'all', age_band) AS age_band, if(grouping(sex) = 1, 'all', sex) AS sex,
       count(DISTINCT bene_id) AS members
FROM enrolled WHERE yr >= 2016 AND yr <= 2022 GROUP BY yr, CUBE (dual, age_band, sex)
""",
)
oracle(
    "grouping_label",
    """
SELECT yr, ifnull(type_of_service, 'none') AS type_of_service, count(*) AS n
FROM eligible WHERE yr >= 2016 AND yr <= 2022 GROUP BY ALL
UNION ALL
SELECT yr, 'all', count(*) FROM eligible WHERE yr >= 2016 AND yr <= 2022 GROUP BY yr
""",
)
oracle(
    "rollup_of_facts",
    f"""
SELECT yr, service_category, subcategory, {total("allowed")}, {total("paid")}, CAST(sum(n_rows) AS BIGINT) AS n_rows
FROM spend_cell GROUP BY ALL
""",
)
oracle("ratio_of_aggregates", f"SELECT yr, service_category, {cents('rebuilt')} AS rebuilt FROM rebuilt")
oracle("global_aggregate", f"SELECT count(*) AS n, {total('allowed')}, {total('paid')} FROM standard")

# Windows and set operations

oracle("lag_total_growth", "SELECT yr, total_pmpm, total_growth_pct FROM total_growth")
oracle("lag_category_growth", "SELECT yr, service_category, yoy_growth_pct, yoy_change_pmpm FROM category_growth")
oracle("first_value_cagr", "SELECT yr, service_category, cagr_since_2016_pct FROM category_growth")
oracle(
    "union_standardize", "SELECT src, count(*) AS n, count(DISTINCT bene_id) AS people FROM standard GROUP BY src"
)
oracle(
    "union_fac_lines",
    f"SELECT CAST(ifnull(yr, 0) AS INTEGER) AS yr, count(*) AS n, {total('allowed')} FROM facility_line GROUP BY ALL",
)

# Composite results

oracle("member_month", "SELECT bene_id, yr, mo, ab_ffs, partd, dual, age_band, sex FROM enrolled")
oracle(
    "member_months_by_year",
    """
SELECT yr, count(*) FILTER (ab_ffs) AS ab_ffs_member_months,
       count(*) FILTER (ab_ffs AND partd) AS ab_ffs_partd_member_months,
       CAST(round(count(*) FILTER (ab_ffs) / 12, 1) AS DOUBLE) AS avg_ab_ffs_members,
       CAST(round(100 * count(*) FILTER (ab_ffs AND dual) / count(*) FILTER (ab_ffs), 1) AS DOUBLE) AS pct_dual
FROM enrolled GROUP BY yr
""",
)
oracle("claim_line", f"SELECT {_standard_shown} FROM standard")
_categorized_shown = f"{_standard_shown}, service_category, subcategory, type_of_service, yr, mo"
oracle("claim_line_cat", f"SELECT {_categorized_shown} FROM categorized")
_eligible_shown = f"{_categorized_shown}, dual, age_band, sex"
oracle("spend", f"SELECT {_eligible_shown} FROM eligible")
oracle("mm_fact", "SELECT * FROM months_cell")
oracle(
    "spend_fact",
    f"""
SELECT yr, service_category, subcategory, type_of_service, dual, age_band, sex, {cents("allowed")} AS allowed,
       {cents("paid")} AS paid, n_rows, n_benes
FROM spend_cell
""",
)
oracle("pmpm_by_category", "SELECT * FROM category_pmpm")
oracle("pmpm_total", "SELECT * FROM total_growth")
oracle("pmpm_growth", "SELECT * FROM category_growth")
oracle("pc_professional", f"SELECT {_eligible_shown}, service_group FROM professional")
oracle("pc_wellness_npi", "SELECT DISTINCT rndrng_npi FROM wellness_line")
oracle("pc_step5", f"SELECT {_eligible_shown}, service_group FROM qualified")
oracle("pc_outpatient_line", f"SELECT hcpcs_cd, bill_type2, {_line_shown} FROM clinic_line")
oracle("pc_facility_split", f"SELECT {_line_shown} FROM split_line")
oracle("pc_fqhc", f"SELECT {_line_shown} FROM fqhc_line")
oracle(
    "primary_care_by_year",
    """
SELECT yr, CAST(round(dollars, 0) AS DOUBLE) AS primary_care_allowed, n AS primary_care_services,
       round(CAST(dollars AS DOUBLE) / ab, 2) AS primary_care_pmpm,
       round(CAST(100 * dollars AS DOUBLE) / CAST(medical AS DOUBLE), 2) AS pct_of_medical,
       round(CAST(100 * dollars AS DOUBLE) / CAST(spent AS DOUBLE), 2) AS pct_of_total
FROM care_year
""",
)
oracle(
    "primary_care_by_service",
    f"""
SELECT yr, service_group, count(*) AS services, {total("allowed")}
FROM qualified WHERE yr >= 2016 AND yr <= 2022 GROUP BY yr, service_group
""",
)
oracle(
    "pc_fact",
    f"""
SELECT yr, service_group, dual, age_band, sex, {total("allowed")}, count(*) AS services
FROM qualified WHERE yr >= 2016 AND yr <= 2022 GROUP BY yr, service_group, dual, age_band, sex
""",
)
oracle("ip_fact", f"SELECT yr, dual, age_band, sex, stays, {cents('allowed')} AS allowed FROM stay_cell")
oracle("members_fact", "SELECT yr, dual, age_band, sex, members FROM member_count")

part(
    "stay_rate",
    """
SELECT yr, dual, age_band, sex, CAST(stays AS DOUBLE) / mm AS rate, CAST(allowed AS DOUBLE) / CAST(stays AS DOUBLE) AS cost
FROM (SELECT yr, 'all' AS dual, 'all' AS age_band, 'all' AS sex, sum(stays) AS stays, sum(allowed) AS allowed
      FROM stay_cell GROUP BY yr
      UNION ALL SELECT yr, CAST(dual AS VARCHAR), age_band, sex, stays, allowed FROM stay_cell)
JOIN (SELECT yr, 'all' AS dual, 'all' AS age_band, 'all' AS sex, ab AS mm FROM year_months
      UNION ALL SELECT yr, CAST(dual AS VARCHAR), age_band, sex, ab_ffs_mm FROM months_cell)
USING (yr, dual, age_band, sex)
""",
)
oracle(
    "volume_price_split",
    f"""
SELECT dual, age_band, sex, 2016 AS first_year, 2022 AS last_year, {cents("a.rate * a.cost")} AS first_pmpm,
       {cents("b.rate * b.cost")} AS last_pmpm, {cents("(b.rate - a.rate) * (a.cost + b.cost) / 2")} AS volume_effect,
       {cents("(b.cost - a.cost) * (a.rate + b.rate) / 2")} AS price_effect,
       {cents("b.rate * b.cost - a.rate * a.cost")} AS pmpm_change
FROM (SELECT * EXCLUDE (yr) FROM stay_rate WHERE yr = 2016) a
FULL JOIN (SELECT * EXCLUDE (yr) FROM stay_rate WHERE yr = 2022) b USING (dual, age_band, sex)
""",
)
oracle(
    "growth_contribution",
    f"""
SELECT service_category, CAST(a AS DOUBLE) AS first_pmpm, CAST(b AS DOUBLE) AS last_pmpm,
       CAST(b - a AS DOUBLE) AS pmpm_change,
       {cents("CAST(100 * a AS DOUBLE) / CAST(sum(a) OVER () AS DOUBLE)")} AS pct_of_first,
       {cents("CAST(100 * (b - a) AS DOUBLE) / CAST(sum(b - a) OVER () AS DOUBLE)")} AS pct_of_change
FROM (SELECT service_category, CAST(ifnull(max(pmpm) FILTER (yr = 2016), 0.0) AS DECIMAL(18, 2)) AS a,
             CAST(ifnull(max(pmpm) FILTER (yr = 2022), 0.0) AS DECIMAL(18, 2)) AS b
      FROM category_pmpm WHERE yr IN (2016, 2022) GROUP BY service_category)
""",
)
oracle(
    "utilization_rate",
    f"""
SELECT yr, CAST(sum(stays) AS BIGINT) AS stays, any_value(ab) AS member_months,
       {cents("CAST(sum(stays) AS DOUBLE) * 12000.0 / any_value(ab)")} AS stays_per_1000,
       {cents("CAST(sum(allowed) AS DOUBLE) / CAST(sum(stays) AS DOUBLE)")} AS allowed_per_stay
FROM stay_cell JOIN year_months USING (yr) GROUP BY yr
""",
)
oracle(
    "fact_slice",
    f"""
SELECT yr, {cents("s.t")} AS allowed, m.t AS ab_ffs_mm, members, {cents("CAST(s.t AS DOUBLE) / m.t")} AS pmpm
FROM (SELECT yr, sum(allowed) AS t FROM spend_cell WHERE NOT dual AND sex = 'Female' GROUP BY yr) s
JOIN (SELECT yr, CAST(sum(ab_ffs_mm) AS BIGINT) AS t FROM months_cell WHERE NOT dual AND sex = 'Female' GROUP BY yr) m
  USING (yr)
JOIN (SELECT yr, count(DISTINCT bene_id) AS members FROM enrolled WHERE ab_ffs AND NOT dual AND sex = 'Female'
      GROUP BY yr) USING (yr)
""",
)
oracle(
    "average_annual_growth",
    f"""
SELECT min(yr) AS first_year, max(yr) AS last_year, arg_min(total_pmpm, yr) AS first_pmpm,
       arg_max(total_pmpm, yr) AS last_pmpm,
       {cents("((arg_max(total_pmpm, yr) / arg_min(total_pmpm, yr)) ^ (1 / (max(yr) - min(yr))) - 1) * 100")}
         AS annual_growth_pct
FROM total_growth
""",
)

# Input quality and rebuilds

oracle(
    "input_report",
    """
SELECT table_name, column_name, problem, count(*) AS n
FROM (
  SELECT src AS table_name, unnest(if(src = 'outpatient', ['CLM_FROM_DT', 'REV_CNTR_DT'], ['CLM_FROM_DT'])) AS column_name,
         'unknown month' AS problem
  FROM facility f JOIN lineitem ON l_orderkey = f.key WHERE key % 211 = 0
  UNION ALL
  SELECT src, if(src = 'pde', 'SRVC_DT', 'LINE_1ST_EXPNS_DT'), 'unknown month'
  FROM supplier_row WHERE key % 211 = 0 AND (src <> 'pde' OR key % 79 <> 0)
  UNION ALL
  SELECT src, 'SRVC_DT', 'no such day' FROM supplier_row WHERE src = 'pde' AND key % 79 = 0
  UNION ALL
  SELECT src, 'LINE_ALOWD_CHRG_AMT', 'not an amount' FROM supplier_row WHERE src = 'carrier' AND key % 97 = 0
  UNION ALL
  SELECT src, 'LINE_NUM', 'not a whole number' FROM supplier_row WHERE src = 'carrier' AND key % 89 = 0
  UNION ALL
  SELECT src, 'LINE_NCH_PMT_AMT', 'more than four decimals' FROM supplier_row WHERE src = 'dme' AND key % 83 = 0
  UNION ALL
  SELECT src, 'CLM_PMT_AMT', 'too large' FROM facility f JOIN lineitem ON l_orderkey = f.key WHERE src = 'snf' AND key % 73 = 0
  UNION ALL
  SELECT 'beneficiary', 'AGE_AT_END_REF_YR', 'not a whole number'
  FROM person_year, range(if(c % 67 = 0 AND yr = 2018, 2, 1)) WHERE c % 71 = 0
  UNION ALL
  SELECT 'beneficiary', 'BENE_ID, BENE_ENROLLMT_REF_YR', 'person and year listed before'
  FROM person_year WHERE c % 67 = 0 AND yr = 2018
) GROUP BY ALL
""",
)
oracle(
    "permissive_claims",
    f"""
SELECT src, CAST(ifnull(year(day_seen), 0) AS INTEGER) AS yr, count(*) AS n, count(number) AS numbered,
       {cents("sum(paid)")} AS paid, {cents("sum(allowed)")} AS allowed
FROM (
  SELECT src, svc_dt AS day_seen, NULL AS number, if(src = 'snf' AND key % 73 = 0, 0, price) AS paid,
         if(src = 'snf' AND key % 73 = 0, 0, price) + if(k < 3, share, 0) AS allowed
  FROM facility
  UNION ALL
  SELECT src, if(src = 'pde' AND key % 79 = 0, NULL, svc_dt),
         if(src = 'pde' OR (src = 'carrier' AND key % 89 = 0), NULL, line),
         if(src = 'dme' AND key % 83 = 0, 0.1235, paid_amount), if(src = 'carrier' AND key % 97 = 0, 0, allowed_amount)
  FROM supplier_row
) GROUP BY ALL
""",
)
oracle(
    "partial_rebuild",
    f"""
SELECT yr, src, count(*) AS n, {total("allowed")} FROM eligible
WHERE NOT (yr = 2019 AND CAST(bene_id AS BIGINT) % 7 = 0)
  AND NOT (src = 'pde' AND CAST(string_split(clm_id, '-')[1] AS BIGINT) % 5 = 0)
GROUP BY yr, src
""",
)
