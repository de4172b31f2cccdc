"""The nine source tables, derived from the given order tables by the rules of FIXTURES.md.

An order is a claim and its lines are the claim's lines; a customer is a person. Everything is a projection of
``customer`` or of one join of ``orders`` with ``lineitem`` that is staged once, partitioned by claim file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.sources.store import TableStore
from claimspark.sources.text_tables import MONTHS, Sources

FIRST_YEAR, LAST_YEAR = 2015, 2023
# Order dates move by 21 years, from 1995-2001 to 2016-2022; some orders by a year less or more, so that there are
# claims on both sides of the study years.
YEARS_LATER = "CASE WHEN o_orderkey % 47 = 0 THEN 20 WHEN o_orderkey % 53 = 0 THEN 22 ELSE 21 END"
# Remainder of the order key that selects a claim file; carrier shares the orders of outpatient so that facility and
# professional lines of one person and day exist.
FILE_NUMBERS = {
    "inpatient": [0],
    "outpatient": [1],
    "snf": [2],
    "hha": [3],
    "hospice": [4],
    "carrier": [5, 1],
    "dme": [6],
    "pde": [7],
}


def _pick(index: str, values: list[str | None]) -> str:
    """Text at position ``index`` of a list; NULL entries stay NULL."""
    entries = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"element_at(array({entries}), cast({index} AS int) + 1)"


def _money(amount: str) -> str:
    return f"cast(cast({amount} AS decimal(12,2)) AS string)"


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{value} AS {name}" for name, value in columns.items()])


def order_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        F.expr(f"add_months(to_date(o_orderdate), 12 * {YEARS_LATER})").alias("day"),
        (F.col("o_orderkey") % 8).cast("int").alias("k"),
    )
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    # Both grow with the data, so neither is broadcast at any size.
    return orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


#: People whose enrollment one task works out: rows of fifty text columns, from a file with a few bytes for each of them.
PEOPLE_PER_TASK = 50_000


def beneficiary(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("c"))
    tasks = -(-keys.count() // PEOPLE_PER_TASK)
    if tasks > 1:
        keys = keys.repartitionByRange(tasks, "c")
    people = keys.withColumn("yr", F.explode(F.sequence(F.lit(FIRST_YEAR), F.lit(LAST_YEAR))))
    columns = {
        "BENE_ID": "cast(c AS string)",
        "BENE_ENROLLMT_REF_YR": "cast(yr AS string)",
        "SEX_IDENT_CD": "CASE WHEN c % 10 = 0 THEN '0' WHEN c % 10 <= 4 THEN '1' ELSE '2' END",
        "AGE_AT_END_REF_YR": (
            "CASE WHEN c % 53 = 0 THEN NULL WHEN c % 59 = 0 THEN ' ' ELSE cast(50 + c % 45 + yr - 2016 AS string) END"
        ),
        "BENE_HI_CVRAGE_TOT_MONS": "CASE WHEN c % 61 <> 0 THEN '12' END",
        "BENE_SMI_CVRAGE_TOT_MONS": "cast(6 + c % 7 AS string)",
    }
    for m, mm in enumerate(MONTHS, start=1):
        columns |= {
            f"MDCR_ENTLMT_BUYIN_IND_{mm}": _pick(f"(c * 13 + yr * 7 + {m} * 3) % 20", [None, "1", "0", "C", "C"] + ["3"] * 15),
            f"HMO_IND_{mm}": _pick(f"(c + yr + {m}) % 17", ["1", None] + ["0"] * 15),
            f"PTD_CNTRCT_ID_{mm}": _pick(f"(c * 5 + yr + {m}) % 9", ["0", "N", "X", None] + ["S1234"] * 5),
            f"DUAL_STUS_CD_{mm}": _pick(f"(c * 3 + {m}) % 11", [None, "00", "07", "01", "08", "02"] + ["00"] * 5),
        }
    return _project(people, columns)


DATE_TEXT = (
    "concat(date_format(day, 'dd'), CASE WHEN o_orderkey % 211 = 0 THEN '-Foo-' ELSE date_format(day, '-MMM-') END, "
    "date_format(day, 'yyyy'))"
)
PAYER_CODE = "CASE WHEN o_orderkey % 29 = 0 THEN 'A' WHEN o_orderkey % 2 = 1 THEN ' ' END"
USUAL_BILL_TYPE = {
    "inpatient": "if(q % 5 = 0, '41', '11')",
    "outpatient": "if(q % 6 = 0, '77', '13')",
    "snf": "if(q % 4 = 0, '18', '21')",
    "hha": "if(q % 2 = 0, '32', '33')",
    "hospice": "if(q % 2 = 0, '81', '82')",
}


def _institutional(src: str, lines: DataFrame) -> DataFrame:
    deductible = (
        "CASE WHEN o_orderkey % 37 = 0 THEN ' ' WHEN o_orderkey % 41 <> 0 "
        "THEN concat(cast(o_orderkey % 1400 AS string), '.50') END"
    )
    coinsurance = "concat(cast(o_orderkey * 7 % 300 AS string), '.25')"
    blood = "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(cast(o_orderkey % 20 AS string), '.00') END"
    columns = {
        "CLM_ID": "cast(o_orderkey AS string)",
        "BENE_ID": "cast(o_custkey AS string)",
        "CLM_FROM_DT": DATE_TEXT,
        "CLM_FAC_TYPE_CD": "substring(bill, 1, 1)",
        "CLM_SRVC_CLSFCTN_TYPE_CD": "substring(bill, 2, 1)",
        "NCH_PRMRY_PYR_CD": PAYER_CODE,
        "CLM_MDCR_NON_PMT_RSN_CD": "CASE WHEN o_orderkey % 31 = 0 THEN 'N' WHEN o_orderkey % 2 = 0 THEN ' ' END",
        "CLM_PMT_AMT": _money("o_totalprice"),
    }
    if src in ("inpatient", "snf"):
        columns |= {
            "NCH_BENE_IP_DDCTBL_AMT": deductible,
            "NCH_BENE_PTA_COINSRNC_LBLTY_AM": coinsurance,
            "NCH_BENE_BLOOD_DDCTBL_LBLTY_AM": blood,
        }
    if src == "outpatient":
        columns |= {
            "NCH_BENE_PTB_DDCTBL_AMT": deductible,
            "NCH_BENE_PTB_COINSRNC_AMT": coinsurance,
            "NCH_BENE_BLOOD_DDCTBL_LBLTY_AM": blood,
            "HCPCS_CD": _pick("l_partkey % 5", ["G0463", "90935", "G0466", "99213", None]),
            "REV_CNTR_DT": DATE_TEXT,
            "REV_CNTR_PMT_AMT_AMT": _money("l_extendedprice"),
            "REV_CNTR_CASH_DDCTBL_AMT": f"if(l_partkey % 37 = 0, ' ', {_money('l_quantity')})",
            "REV_CNTR_COINSRNC_WGE_ADJSTD_C": "CASE WHEN l_linenumber <> 4 THEN cast(l_linenumber AS string) END",
        }
    # Both characters of the bill type; one with no setting of its own and a missing one for some claims.
    bill = f"CASE WHEN q % 101 = 0 THEN NULL WHEN q % 97 = 0 THEN '53' ELSE {USUAL_BILL_TYPE[src]} END"
    numbered = lines.selectExpr("*", "o_orderkey div 8 AS q")
    return _project(numbered.selectExpr("*", f"{bill} AS bill"), columns)


def _supplier_lines(src: str, lines: DataFrame) -> DataFrame:
    columns = {
        "BENE_ID": "cast(o_custkey AS string)",
        "CLM_ID": "cast(o_orderkey AS string)",
        "LINE_NUM": "cast(l_linenumber AS string)",
        "LINE_1ST_EXPNS_DT": DATE_TEXT,
        "LINE_PLACE_OF_SRVC_CD": _pick("l_suppkey % 9", ["11", "22", "19", "02", "50", "20", "17", "31", "12"]),
        "PRVDR_SPCLTY": _pick("l_suppkey % 8", ["01", "08", "11", "37", "50", "97", "06", None]),
        "HCPCS_CD": _pick(
            "l_partkey % 10", ["99213", "99202", "99215", "G0439", "99490", "99497", "G0442", "90471", "71046", None]
        ),
        "BETOS_CD": _pick("l_partkey % 8", ["M1A", "P1A", "I1A", "T1A", "D1A", "O1A", "Y1", None]),
        "LINE_NCH_PMT_AMT": f"if(l_partkey % 37 = 0, ' ', {_money('l_quantity')})",
        "LINE_ALOWD_CHRG_AMT": f"if(l_partkey % 37 = 0, ' ', {_money('l_extendedprice')})",
        "LINE_BENE_PRMRY_PYR_CD": PAYER_CODE,
        "LINE_PRCSG_IND_CD": "CASE WHEN l_linenumber = 7 THEN 'D' WHEN l_linenumber <> 6 THEN 'A' END",
    }
    if src == "carrier":
        columns["PRF_PHYSN_NPI"] = (
            "CASE WHEN l_partkey % 41 <> 0 THEN cast(l_suppkey * 20 + (l_partkey div 100) % 20 AS string) END"
        )
    else:
        columns["LINE_NDC_CD"] = "cast(l_partkey AS string)"
    return _project(lines, columns)


def _fills(lines: DataFrame) -> DataFrame:
    return _project(
        lines,
        {
            "BENE_ID": "cast(o_custkey AS string)",
            "PDE_ID": "concat(o_orderkey, '-', l_linenumber)",
            "SRVC_DT": DATE_TEXT,
            "PROD_SRVC_ID": "cast(l_partkey AS string)",
            "CVRD_D_PLAN_PD_AMT": f"if(l_partkey % 37 = 0, ' ', {_money('l_quantity')})",
            "TOT_RX_CST_AMT": f"if(l_partkey % 37 = 0, ' ', {_money('l_extendedprice')})",
        },
    )


def claim_file(src: str, order_lines: DataFrame) -> DataFrame:
    lines = order_lines.where(F.col("k").isin(FILE_NUMBERS[src]))
    if src == "pde":
        return _fills(lines)
    return _supplier_lines(src, lines) if src in ("carrier", "dme") else _institutional(src, lines)


def source_tables(spark: SparkSession, sf_dir: str, store: TableStore) -> Sources:
    """The claim files as lazy projections of the staged order join; the wide enrollment table is staged by year."""

    def joined() -> DataFrame:
        return store.table("order_line", lambda: order_line(spark, sf_dir), ["k"], [sf_dir], gather=False)

    def enrolled() -> DataFrame:
        return store.table("beneficiary", lambda: beneficiary(spark, sf_dir), ["BENE_ENROLLMT_REF_YR"], [sf_dir])

    claims = {src: lambda src=src: claim_file(src, joined()) for src in FILE_NUMBERS}
    return Sources({"beneficiary": enrolled, **claims})


def soiled(sources: Sources) -> Sources:
    """The same tables with cells that can't be read, chosen by claim and person, and with some enrollment listed twice."""

    def cell(table: str, column: str, test: str, text: str) -> dict[str, DataFrame]:
        return {table: sources[table].withColumn(column, F.expr(f"CASE WHEN {test} THEN '{text}' ELSE {column} END"))}

    carrier = cell("carrier", "LINE_ALOWD_CHRG_AMT", "cast(CLM_ID AS bigint) % 97 = 0", "n/a")["carrier"]
    carrier = carrier.withColumn("LINE_NUM", F.expr("CASE WHEN cast(CLM_ID AS bigint) % 89 = 0 THEN '1x' ELSE LINE_NUM END"))
    people = cell("beneficiary", "AGE_AT_END_REF_YR", "cast(BENE_ID AS bigint) % 71 = 0", "old")["beneficiary"]
    twice = people.where("cast(BENE_ID AS bigint) % 67 = 0 AND BENE_ENROLLMT_REF_YR = '2018'")
    return Sources(
        {
            **{name: sources[name] for name in sources},
            "carrier": carrier,
            "beneficiary": people.unionByName(twice),
            **cell("dme", "LINE_NCH_PMT_AMT", "cast(CLM_ID AS bigint) % 83 = 0", "0.123456"),
            **cell("pde", "SRVC_DT", "cast(substring_index(PDE_ID, '-', 1) AS bigint) % 79 = 0", "31-Feb-2018"),
            **cell("snf", "CLM_PMT_AMT", "cast(CLM_ID AS bigint) % 73 = 0", "123456789012345678"),
        }
    )


def disenrolled(sources: Sources) -> Sources:
    """The same tables a year later: some people's enrollment of 2019 is gone, and so are some fills."""
    people = sources["beneficiary"].where("NOT (BENE_ENROLLMT_REF_YR = '2019' AND cast(BENE_ID AS bigint) % 7 = 0)")
    fills = sources["pde"].where("cast(substring_index(PDE_ID, '-', 1) AS bigint) % 5 <> 0")
    return Sources({**{name: sources[name] for name in sources}, "beneficiary": people, "pde": fills})
