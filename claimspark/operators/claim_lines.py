"""Eight claim files to one standardized spend table with one allowed-dollar definition."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.parsing import MONEY, bill_type, is_blank, parse_claim_date, parse_int, parse_money
from claimspark.sources.text_tables import INSTITUTIONAL_COST_SHARE, LINE_FILES

CLAIM_LINE_COLUMNS = {
    "src": "string",
    "bene_id": "string",
    "clm_id": "string",
    "line_num": "int",
    "svc_dt": "date",
    "bill_type2": "string",
    "pos_cd": "string",
    "spclty": "string",
    "hcpcs_cd": "string",
    "betos_cd": "string",
    "rndrng_npi": "string",
    "ndc": "string",
    "paid": MONEY,
    "allowed": MONEY,
    "medicare_primary": "boolean",
    "medicare_paid": "boolean",
}


@dataclass(frozen=True)
class LineFile:
    """Where a line-level file keeps the standard columns; a column left out is NULL in that file.

    ``primary`` and ``accepted`` are conditions in SQL.
    """

    date: str
    paid: str
    allowed: str
    columns: Mapping[str, str]
    primary: str = "true"
    accepted: str = "true"


_SUPPLIER_COLUMNS = {
    "clm_id": "CLM_ID",
    "pos_cd": "LINE_PLACE_OF_SRVC_CD",
    "spclty": "PRVDR_SPCLTY",
    "hcpcs_cd": "HCPCS_CD",
    "betos_cd": "BETOS_CD",
}


def _supplier_file(**extra: str) -> LineFile:
    return LineFile(
        date="LINE_1ST_EXPNS_DT",
        paid="LINE_NCH_PMT_AMT",
        allowed="LINE_ALOWD_CHRG_AMT",
        columns=_SUPPLIER_COLUMNS | extra,
        primary="coalesce(trim(LINE_BENE_PRMRY_PYR_CD), '') = ''",
        # Compared as it stands: NULL is accepted, a blank is not.
        accepted="coalesce(LINE_PRCSG_IND_CD, 'A') = 'A'",
    )


LINE_FILE_COLUMNS = {
    "carrier": _supplier_file(rndrng_npi="PRF_PHYSN_NPI"),
    "dme": _supplier_file(ndc="LINE_NDC_CD"),
    "pde": LineFile(
        date="SRVC_DT",
        paid="CVRD_D_PLAN_PD_AMT",
        allowed="TOT_RX_CST_AMT",
        columns={"clm_id": "PDE_ID", "ndc": "PROD_SRVC_ID"},
    ),
}


def conform(df: DataFrame, columns: Mapping[str, str] = CLAIM_LINE_COLUMNS) -> DataFrame:
    """Bring ``df`` to a column contract; columns it lacks become NULLs of the right type."""
    present = set(df.columns)
    return df.selectExpr(
        *[f"cast({name if name in present else 'NULL'} AS {kind}) AS {name}" for name, kind in columns.items()]
    )


def institutional_headers(src: str, lines: DataFrame, strict: bool = True) -> DataFrame:
    """Header fields of an institutional file, still one row per revenue line."""
    cost_share = reduce(
        lambda total, name: total + parse_money(name, strict), INSTITUTIONAL_COST_SHARE[src], F.lit(0).cast(MONEY)
    )
    return lines.select(
        F.lit(src).alias("src"),
        F.col("CLM_ID").alias("clm_id"),
        F.col("BENE_ID").alias("bene_id"),
        F.col("CLM_FROM_DT").alias("from_dt"),
        bill_type().alias("bill_type2"),
        F.col("NCH_PRMRY_PYR_CD").alias("msp_cd"),
        F.col("CLM_MDCR_NON_PMT_RSN_CD").alias("nonpay_cd"),
        parse_money("CLM_PMT_AMT", strict).alias("paid"),
        cost_share.cast(MONEY).alias("cost_share"),
    )


def collapse_claim_headers(headers: DataFrame) -> DataFrame:
    """One row per file and claim: the maximum of every header field, each taken by itself.

    All institutional files go through one aggregation, hence one shuffle instead of five. Lines of a claim are
    combined before the shuffle, so a claim with very many lines sends one row per task.
    """
    fields = [c for c in headers.columns if c not in ("src", "clm_id")]
    return headers.groupBy("src", "clm_id").agg(*[F.max(c).alias(c) for c in fields])


def institutional_claims(sources: Mapping[str, DataFrame], strict: bool = True) -> DataFrame:
    """Standard rows of the five institutional files: allowed is Medicare paid plus the beneficiary's share."""
    headers = reduce(
        DataFrame.unionByName, [institutional_headers(src, sources[src], strict) for src in INSTITUTIONAL_COST_SHARE]
    )
    claims = collapse_claim_headers(headers)
    return conform(
        claims.withColumns(
            {
                "svc_dt": parse_claim_date("from_dt", strict),
                "allowed": F.col("paid") + F.col("cost_share"),
                "medicare_primary": is_blank("msp_cd"),
                "medicare_paid": is_blank("nonpay_cd"),
            }
        )
    )


def line_claims(src: str, lines: DataFrame, strict: bool = True) -> DataFrame:
    """Standard rows of a line-level file; every line stays a row, no shuffle."""
    spec = LINE_FILE_COLUMNS[src]
    number = [parse_int("LINE_NUM", strict).alias("line_num")] if "LINE_NUM" in lines.columns else []
    return conform(
        lines.select(
            F.lit(src).alias("src"),
            F.col("BENE_ID").alias("bene_id"),
            *number,
            parse_claim_date(spec.date, strict).alias("svc_dt"),
            *[F.col(column).alias(name) for name, column in spec.columns.items()],
            parse_money(spec.paid, strict).alias("paid"),
            parse_money(spec.allowed, strict).alias("allowed"),
            F.expr(spec.primary).alias("medicare_primary"),
            F.expr(spec.accepted).alias("medicare_paid"),
        )
    )


def claim_line(sources: Mapping[str, DataFrame], strict: bool = True) -> DataFrame:
    """All eight files as one table: a row per institutional claim, per professional or supplier line, per fill.

    A cell that can't be read fails the job, or counts as blank if not ``strict``.
    """
    lines = [line_claims(src, sources[src], strict) for src in LINE_FILES]
    return reduce(DataFrame.unionByName, [institutional_claims(sources, strict), *lines])
