"""Codes to flags and labels. Like the parsing functions these take column names or SQL expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark.functions import codes


def _list(members: Iterable[str]) -> str:
    return ", ".join(f"'{m}'" for m in members)


def _literal(label: str, names: Sequence[str] | None) -> str:
    """A label, or its place in ``names``, as SQL."""
    return f"'{label}'" if names is None else f"{names.index(label)}Y"


def _case(code: str, labels: Mapping[str, str], otherwise: str, names: Sequence[str] | None = None) -> str:
    """First label whose blank-separated list holds the code; NULL codes get ``otherwise``."""
    whens = " ".join(
        f"WHEN {code} IN ({_list(members.split())}) THEN {_literal(label, names)}" for label, members in labels.items()
    )
    return f"CASE {whens} ELSE {otherwise} END"


def _by_code(code: str, labels: Mapping[str, str], otherwise: str, names: Sequence[str] | None = None) -> str:
    whens = " ".join(f"WHEN {code} = '{value}' THEN {_literal(label, names)}" for value, label in labels.items())
    return f"CASE {whens} ELSE {otherwise} END"


def in_part_ab_ffs(buyin: str, hmo: str) -> Column:
    """Part A and B that month and not in managed care; NULL managed-care code counts as none."""
    none = codes.NOT_MANAGED_CARE
    return F.expr(f"{buyin} IN ({_list(codes.PART_A_AND_B)}) AND coalesce({hmo}, '{none}') = '{none}'")


def in_part_d(contract: str) -> Column:
    """A Part D contract is on file; never NULL. An empty, non-NULL contract counts."""
    return F.expr(f"{contract} IS NOT NULL AND {contract} NOT IN ({_list(codes.NO_PART_D_CONTRACT)})")


def is_dual(status: str) -> Column:
    """Full or partial Medicaid that month; NULL counts as not."""
    return F.expr(f"coalesce({status} IN ({_list(codes.DUAL_ELIGIBLE)}), false)")


def age_band(age: str) -> Column:
    """Four bands; an unknown age falls in the last one."""
    return F.expr(
        f"CASE WHEN {age} < 65 THEN '<65' WHEN {age} < 75 THEN '65-74' WHEN {age} < 85 THEN '75-84' ELSE '85+' END"
    )


def sex_label(code: str) -> Column:
    return F.expr(_by_code(code, codes.SEX_LABELS, f"'{codes.UNKNOWN_SEX}'"))


# Every label a category function can give; its place is its code.
CATEGORY_LABELS = tuple(dict.fromkeys([*codes.SOURCE_CATEGORY.values(), *codes.BILL_TYPE_CATEGORY, "Other"]))
SUBCATEGORY_LABELS = tuple(
    dict.fromkeys(
        [*codes.SOURCE_SUBCATEGORY.values(), *codes.PLACE_SUBCATEGORY, "Other professional", *codes.BILL_TYPE_SUBCATEGORY, "Other facility"]
    )
)
SERVICE_LABELS = (*codes.BETOS_LABELS.values(), "Exceptions/unclassified", "Unclassified")


def service_category(src: str, bill: str, names: Sequence[str] | None = None) -> Column:
    """Topline category: the claim file decides first, then the bill type. Never NULL. With ``names`` the place of the label
    among them, here and below."""
    by_bill = _case(bill, codes.BILL_TYPE_CATEGORY, _literal("Other", names), names)
    return F.expr(_by_code(src, codes.SOURCE_CATEGORY, by_bill, names))


def subcategory(src: str, bill: str, place: str, names: Sequence[str] | None = None) -> Column:
    """Place of setting; bill types without a setting of their own are ``Other facility``."""
    by_place = _case(place, codes.PLACE_SUBCATEGORY, _literal("Other professional", names), names)
    by_bill = _case(bill, codes.BILL_TYPE_SUBCATEGORY, _literal("Other facility", names), names)
    by_file = _by_code(src, codes.SOURCE_SUBCATEGORY, by_bill, names)
    return F.expr(f"CASE WHEN {src} = 'carrier' THEN {by_place} ELSE {by_file} END")


def type_of_service(src: str, betos: str, names: Sequence[str] | None = None) -> Column:
    """Professional lines only: first BETOS letter. Empty text is an exception, NULL is unclassified."""
    by_letter = _by_code(f"substring({betos}, 1, 1)", codes.BETOS_LABELS, _literal("Exceptions/unclassified", names), names)
    unclassified = _literal("Unclassified", names)
    return F.expr(f"CASE WHEN {src} = 'carrier' THEN CASE WHEN {betos} IS NULL THEN {unclassified} ELSE {by_letter} END END")


def label_of(code: str, names: Sequence[str]) -> Column:
    """The label a code stands for; NULL for none. Spark takes a NULL place in an array of known labels for -1, so it is kept
    from it."""
    return F.when(F.col(code).isNotNull(), F.element_at(F.array(*[F.lit(name) for name in names]), F.col(code) + 1))
