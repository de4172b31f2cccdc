"""The enrollment table and the eight claim tables, every column text."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTHS = tuple(f"{m:02d}" for m in range(1, 13))
MONTHLY_FAMILIES = ("MDCR_ENTLMT_BUYIN_IND", "HMO_IND", "PTD_CNTRCT_ID", "DUAL_STUS_CD")

_HEADER = (
    "CLM_ID",
    "BENE_ID",
    "CLM_FROM_DT",
    "CLM_FAC_TYPE_CD",
    "CLM_SRVC_CLSFCTN_TYPE_CD",
    "NCH_PRMRY_PYR_CD",
    "CLM_MDCR_NON_PMT_RSN_CD",
    "CLM_PMT_AMT",
)
_PART_A_COST_SHARE = ("NCH_BENE_IP_DDCTBL_AMT", "NCH_BENE_PTA_COINSRNC_LBLTY_AM", "NCH_BENE_BLOOD_DDCTBL_LBLTY_AM")
_PART_B_COST_SHARE = ("NCH_BENE_PTB_DDCTBL_AMT", "NCH_BENE_PTB_COINSRNC_AMT", "NCH_BENE_BLOOD_DDCTBL_LBLTY_AM")

# Cost-share columns of each institutional file; home health and hospice claims carry none.
INSTITUTIONAL_COST_SHARE: dict[str, tuple[str, ...]] = {
    "inpatient": _PART_A_COST_SHARE,
    "outpatient": _PART_B_COST_SHARE,
    "snf": _PART_A_COST_SHARE,
    "hha": (),
    "hospice": (),
}
REVENUE_LINE_COLUMNS = (
    "HCPCS_CD",
    "REV_CNTR_DT",
    "REV_CNTR_PMT_AMT_AMT",
    "REV_CNTR_CASH_DDCTBL_AMT",
    "REV_CNTR_COINSRNC_WGE_ADJSTD_C",
)
_SUPPLIER_LINE = (
    "BENE_ID",
    "CLM_ID",
    "LINE_NUM",
    "LINE_1ST_EXPNS_DT",
    "LINE_PLACE_OF_SRVC_CD",
    "PRVDR_SPCLTY",
    "HCPCS_CD",
    "BETOS_CD",
    "LINE_NCH_PMT_AMT",
    "LINE_ALOWD_CHRG_AMT",
    "LINE_BENE_PRMRY_PYR_CD",
    "LINE_PRCSG_IND_CD",
)
LINE_FILES = ("carrier", "dme", "pde")
CLAIM_FILES = (*INSTITUTIONAL_COST_SHARE, *LINE_FILES)

REQUIRED_COLUMNS: dict[str, tuple[str, ...]] = {
    "beneficiary": (
        "BENE_ID",
        "BENE_ENROLLMT_REF_YR",
        "SEX_IDENT_CD",
        "AGE_AT_END_REF_YR",
        "BENE_HI_CVRAGE_TOT_MONS",
        "BENE_SMI_CVRAGE_TOT_MONS",
        *(f"{family}_{mm}" for family in MONTHLY_FAMILIES for mm in MONTHS),
    ),
    **{
        src: (*_HEADER, *cost_share, *(REVENUE_LINE_COLUMNS if src == "outpatient" else ()))
        for src, cost_share in INSTITUTIONAL_COST_SHARE.items()
    },
    "carrier": (*_SUPPLIER_LINE, "PRF_PHYSN_NPI"),
    "dme": (*_SUPPLIER_LINE, "LINE_NDC_CD"),
    "pde": ("BENE_ID", "PDE_ID", "SRVC_DT", "PROD_SRVC_ID", "CVRD_D_PLAN_PD_AMT", "TOT_RX_CST_AMT"),
}


def as_text_table(df: DataFrame, name: str) -> DataFrame:
    """Keep the columns the analysis reads, as text; an error names the missing ones."""
    by_upper = {c.upper(): c for c in df.columns}
    missing = [c for c in REQUIRED_COLUMNS[name] if c not in by_upper]
    if missing:
        raise ValueError(f"table {name!r} lacks columns: {', '.join(missing)}")
    types = {f.name: f.dataType for f in df.schema.fields}
    not_text = [c for c in REQUIRED_COLUMNS[name] if not isinstance(types[by_upper[c]], T.StringType)]
    if not_text:
        # A typed column has already lost leading zeros and blanks, so casting it back would hide wrong codes.
        raise ValueError(f"table {name!r} must be all text, but these are typed: {', '.join(not_text)}")
    return df.select(*[F.col(by_upper[c]).alias(c) for c in REQUIRED_COLUMNS[name]])


def read_text_csv(spark: SparkSession, path: str, name: str, sep: str = ",") -> DataFrame:
    """Delimited text with a header row. Columns are matched by name, types are never inferred, and an empty cell
    (quoted or not) is NULL while a blank one stays a blank.

    Spark reads all files of a folder by the columns of one of them. A file whose header differs fails the job, it is
    never read with its columns in the wrong places.
    """
    return as_text_table(spark.read.csv(path, header=True, sep=sep, inferSchema=False, enforceSchema=False), name)


def read_text_parquet(spark: SparkSession, path: str, name: str) -> DataFrame:
    return as_text_table(spark.read.parquet(path), name)


class Sources(Mapping[str, DataFrame]):
    """The nine source tables by name. A table is a DataFrame or a function that makes one; it is made and checked when
    it is first used, so a result opens only the files it reads."""

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        unknown = set(tables) - set(REQUIRED_COLUMNS)
        if unknown:
            raise ValueError(f"unknown source tables: {', '.join(sorted(unknown))}")
        self._tables = dict(tables)
        self._checked: dict[str, DataFrame] = {}

    @classmethod
    def from_csv(cls, spark: SparkSession, directory: str, sep: str = ",", suffix: str = ".csv") -> Sources:
        return cls({n: partial(read_text_csv, spark, f"{directory}/{n}{suffix}", n, sep) for n in REQUIRED_COLUMNS})

    @classmethod
    def from_parquet(cls, spark: SparkSession, directory: str, suffix: str = "") -> Sources:
        return cls({n: partial(read_text_parquet, spark, f"{directory}/{n}{suffix}", n) for n in REQUIRED_COLUMNS})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._checked:
            table = self._tables[name]
            self._checked[name] = as_text_table(table if isinstance(table, DataFrame) else table(), name)
        return self._checked[name]

    def __iter__(self):
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)
