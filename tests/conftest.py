from __future__ import annotations

import os
import sys

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from claimspark.settings import scale_settings  # noqa: E402
from claimspark.sources.text_tables import REQUIRED_COLUMNS  # noqa: E402

SF_TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("claimspark-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    for key, value in scale_settings(0, 4).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def text_table(spark):
    """Source table from a few cells per row; every other column is NULL."""

    def make(name: str, rows: list[dict]) -> DataFrame:
        columns = REQUIRED_COLUMNS[name]
        for row in rows:
            assert set(row) <= set(columns), set(row) - set(columns)
        cells = {c: pa.array([row.get(c) for row in rows], pa.string()) for c in columns}
        return spark.createDataFrame(pa.table(cells))

    return make


@pytest.fixture
def sources(text_table):
    """All nine source tables, empty unless rows are given."""

    def make(**rows):
        return {name: text_table(name, rows.get(name, [])) for name in REQUIRED_COLUMNS}

    return make


@pytest.fixture
def with_conf(spark):
    """Set SQL settings for one test."""
    saved = {}

    def set_all(settings: dict[str, str]):
        for key, value in settings.items():
            saved.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_all
    for key, value in saved.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def months(value: str | None, family: str) -> dict:
    """The same cell in all twelve months of a family."""
    return {f"{family}_{m:02d}": value for m in range(1, 13)}


def person(bene_id: str, yr: int = 2016, **cells) -> dict:
    """A person with Part A+B fee-for-service and Part D all year unless cells say otherwise."""
    return {
        "BENE_ID": bene_id,
        "BENE_ENROLLMT_REF_YR": str(yr),
        "SEX_IDENT_CD": "2",
        "AGE_AT_END_REF_YR": "70",
        **months("3", "MDCR_ENTLMT_BUYIN_IND"),
        **months("0", "HMO_IND"),
        **months("S1234", "PTD_CNTRCT_ID"),
        **months("00", "DUAL_STUS_CD"),
        **cells,
    }


def values(df: DataFrame, *columns: str) -> list[tuple]:
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


def evaluate(spark, expression, cells: list) -> list:
    """Values of one column expression over rows of text cells, in order. Cells are columns ``a``, ``b``, ``c``."""
    rows = [(i, *(cell if isinstance(cell, tuple) else (cell,))) for i, cell in enumerate(cells)]
    names = "abc"[: len(rows[0]) - 1]
    df = spark.createDataFrame(rows, ", ".join(["i int", *(f"{n} string" for n in names)]))
    return [r["v"] for r in sorted(df.select("i", expression.alias("v")).collect())]


def check(spark, expression, expected: dict) -> None:
    """Compare an expression with its expected value for every cell (or tuple of cells)."""
    got = dict(zip(expected, evaluate(spark, expression, list(expected)), strict=True))
    assert got == expected


__all__ = ["F", "SF_TINY", "check", "evaluate", "months", "person", "values"]
