"""Text cells to typed columns. Source tables hold text only, so every number and date is cast here.

Each function takes a column name, or any SQL expression, and makes one Spark expression of it. Casts are strict by default:
with ANSI mode on (Spark's default) a cell that is neither blank nor a number fails the job. Otherwise such a cell counts as
blank, and ``problem_of`` says what is wrong with it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark.functions.codes import MONTH_NAMES


def _cast(strict: bool) -> str:
    return "cast" if strict else "try_cast"


def parse_int(cell: str, strict: bool = True) -> Column:
    """Whole number, NULL for a blank cell."""
    return F.expr(f"{_cast(strict)}(nullif(trim({cell}), '') AS int)")


#: Amounts are decimals, so that sums are exact and don't depend on the order in which partitions are added.
MONEY = "decimal(18,4)"


def _fine(text: str) -> str:
    """Whether a number may have more than four decimals: more digits after its point, or an exponent."""
    point = f"instr({text}, '.')"
    return f"(({point} > 0 AND length({text}) - {point} > 4) OR instr({text}, 'e') > 0 OR instr({text}, 'E') > 0)"


def parse_money(cell: str, strict: bool = True) -> Column:
    """Dollar amount, 0 for a blank cell. One with more than four decimals fails the job instead of being rounded, or is
    rounded if not ``strict``.

    A cell is parsed once; only one that looks as if it had more decimals is parsed again to tell whether it has.
    """
    text = f"nullif(trim({cell}), '')"
    amount = f"coalesce({_cast(strict)}({text} AS {MONEY}), cast(0 AS {MONEY}))"
    if not strict:
        return F.expr(amount)
    rounded = f"{_fine(text)} AND cast({text} AS double) <> cast(cast({text} AS {MONEY}) AS double)"
    return F.expr(f"CASE WHEN {rounded} THEN raise_error(concat('amount with more than four decimals: ', {cell})) ELSE {amount} END")


def _month(cell: str) -> str:
    names = ", ".join(f"'{name}'" for name in MONTH_NAMES)
    return f"nullif(array_position(array({names}), substring({cell}, 4, 3)), 0)"


def parse_claim_date(cell: str, strict: bool = True) -> Column:
    """``DD-Mon-YYYY`` to a date by character position; NULL for an unknown month name (case matters).

    The text is rearranged to ISO order and cast, which is cheaper per row than a pattern-driven parser.
    """
    return F.expr(
        f"{_cast(strict)}(concat(substring({cell}, 8, 4), '-', lpad(cast({_month(cell)} AS string), 2, '0'), '-', "
        f"substring({cell}, 1, 2)) AS date)"
    )


# What can be wrong with a cell, by the kind of its column.
PROBLEMS = {
    "int": ("not a whole number",),
    "money": ("not an amount", "more than four decimals", "too large"),
    "date": ("no such day", "unknown month"),
}


def problem_of(cell: str, kind: str) -> Column:
    """One of the ``PROBLEMS`` of the kind, or NULL for a cell that is blank or as it should be."""
    text = f"nullif(trim({cell}), '')"
    if kind == "int":
        return F.expr(f"CASE WHEN {text} IS NOT NULL AND try_cast({text} AS int) IS NULL THEN 'not a whole number' END")
    if kind == "money":
        number, amount = f"try_cast({text} AS double)", f"try_cast({text} AS {MONEY})"
        return F.expr(
            f"CASE WHEN {text} IS NULL THEN NULL WHEN {number} IS NULL THEN 'not an amount' "
            f"WHEN {amount} IS NULL THEN 'too large' "
            f"WHEN {_fine(text)} AND {number} <> cast({amount} AS double) THEN 'more than four decimals' END"
        )
    iso = f"concat(substring({cell}, 8, 4), '-', lpad(cast({_month(cell)} AS string), 2, '0'), '-', substring({cell}, 1, 2))"
    return F.expr(
        f"CASE WHEN {cell} IS NULL THEN NULL WHEN {_month(cell)} IS NULL THEN 'unknown month' "
        f"WHEN try_cast({iso} AS date) IS NULL THEN 'no such day' END"
    )


def is_blank(cell: str) -> Column:
    """True for NULL, empty and all-space cells; never NULL."""
    return F.expr(f"coalesce(trim({cell}), '') = ''")


def bill_type(facility: str = "CLM_FAC_TYPE_CD", classification: str = "CLM_SRVC_CLSFCTN_TYPE_CD") -> Column:
    """First two characters of the bill type; NULL if either part is NULL."""
    return F.concat(facility, classification)
