"""The whole analysis as named tables and views."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.config import StudyWindow
from claimspark.functions.parsing import parse_int
from claimspark.operators import claim_lines, facts, member_months, primary_care, service_categories
from claimspark.plans import drivers, input_report, pmpm, validation
from claimspark.sources.code_lists import CodeLists
from claimspark.sources.store import TableStore
from claimspark.sources.text_tables import CLAIM_FILES


def _once(build: Callable[[CostDrivers], DataFrame]) -> Callable[[CostDrivers], DataFrame]:
    """Build a result's plan once per instance; analysing large plans again and again takes the driver seconds."""

    @wraps(build)
    def made(self: CostDrivers) -> DataFrame:
        if build.__name__ not in self._made:
            self._made[build.__name__] = build(self)
        return self._made[build.__name__]

    return made


class CostDrivers:
    """Every result of the analysis by name, each a DataFrame.

    The tables many results share (member months, claim lines, spend, the facts) are written once when first needed and
    scanned from there: below ``store``, or without one below the session's checkpoint folder, which then has to be
    set. Several analyses can use one store; each gets the tables of its own sources, lists and window.

    A cell that can't be read fails a ``strict`` analysis. In another one it counts as blank, and ``input_report`` says how
    many there are.
    """

    def __init__(
        self,
        sources: Mapping[str, DataFrame],
        lists: CodeLists,
        window: StudyWindow | None = None,
        store: TableStore | None = None,
        strict: bool = True,
    ):
        self.sources = sources
        self.strict = strict
        self.lists = lists
        self.window = window or StudyWindow()
        self.store = store or TableStore.for_session(lists.places.sparkSession, "analysis")
        self._made: dict[str, DataFrame] = {}

    def _table(
        self, name: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = (), of: Sequence[object] = ()
    ) -> DataFrame:
        """A stored table of the sources and of what else it depends on (``of``)."""
        return self.store.table(name, build, partition_by, [self.sources, self.strict, *of])

    def rebuild(
        self, sources: Mapping[str, DataFrame], years: Collection[int] = (), files: Collection[str] = ()
    ) -> CostDrivers:
        """The analysis of ``sources`` that differ from this one's in the enrollment of some ``years`` and in some claim
        ``files``, and in nothing else.

        Member months of those years, claim lines of those files and spend of either are built and written; the other
        partitions are read where this analysis wrote them. Reports and facts follow from the tables. This analysis
        stays as it is.
        """
        unknown = set(files) - set(CLAIM_FILES)
        if unknown:
            raise ValueError(f"no such claim files: {', '.join(sorted(unknown))}")
        new = CostDrivers(sources, self.lists, self.window, self.store, self.strict)
        of = [new.sources, new.strict]

        def member_month() -> DataFrame:
            # Told from the enrollment row, so that other years aren't unpivoted.
            changed = new.sources["beneficiary"].where(parse_int("BENE_ENROLLMT_REF_YR", self.strict).isin(list(years)))
            return member_months.member_month(changed, self.strict)

        self.store.rebuilt("member_month", self.member_month(), member_month, {"yr": years}, ["yr"], of)
        self.store.rebuilt("claim_line", self.claim_line(), lambda: claim_lines.claim_line(new.sources, new.strict), {"src": files}, ["src"], of)

        def spend() -> DataFrame:
            rows = new.categorized()
            changed = F.coalesce(F.col("yr").isin(list(years)), F.lit(False)) | F.col("src").isin(list(files))
            return service_categories.eligible_spend(rows.where(changed), new.member_month())

        self.store.rebuilt("spend", self.spend(), spend, {"yr": years, "src": files}, ["yr", "src"], of)
        return new

    # Enrollment

    @_once
    def member_month(self) -> DataFrame:
        """Partitioned by year: the study window then skips whole folders."""
        return self._table("member_month", lambda: member_months.member_month(self.sources["beneficiary"], self.strict), ["yr"])

    @_once
    def member_months_by_year(self) -> DataFrame:
        return member_months.member_months_by_year(self.member_month())

    # Claims

    @_once
    def claim_line(self) -> DataFrame:
        """Partitioned by claim file: results on one file or one category read that folder only."""
        return self._table("claim_line", lambda: claim_lines.claim_line(self.sources, self.strict), ["src"])

    @_once
    def categorized(self) -> DataFrame:
        """Not stored: codes are worked out as ``claim_line`` is read. ``spend`` and the checks on categories have it in common."""
        return service_categories.categorized(self.claim_line())

    @_once
    def claim_line_cat(self) -> DataFrame:
        return service_categories.labelled(self.categorized())

    @_once
    def spend(self) -> DataFrame:
        """Partitioned by year and claim file: the facts read the study years and their files only."""
        return self._table("spend", lambda: service_categories.eligible_spend(self.categorized(), self.member_month()), ["yr", "src"])

    # Facts

    @_once
    def mm_fact(self) -> DataFrame:
        return self._table("mm_fact", lambda: facts.mm_fact(self.member_month(), self.window), of=[self.window])

    @_once
    def spend_fact(self) -> DataFrame:
        return self._table("spend_fact", lambda: facts.spend_fact(self.spend(), self.window), of=[self.window])

    @_once
    def ip_fact(self) -> DataFrame:
        return self._table("ip_fact", lambda: facts.ip_fact(self.spend(), self.window), of=[self.window])

    @_once
    def members_fact(self) -> DataFrame:
        return self._table("members_fact", lambda: facts.members_fact(self.member_month(), self.window), of=[self.window])

    @_once
    def pc_fact(self) -> DataFrame:
        return self._table("pc_fact", lambda: facts.pc_fact(self.pc_step5(), self.window), of=[self.window, self.lists])

    # PMPM

    @_once
    def pmpm_by_category(self) -> DataFrame:
        return pmpm.pmpm_by_category(self.spend_fact(), self.mm_fact())

    @_once
    def pmpm_total(self) -> DataFrame:
        return pmpm.pmpm_total(self.pmpm_by_category())

    @_once
    def pmpm_growth(self) -> DataFrame:
        return pmpm.pmpm_growth(self.pmpm_by_category(), self.window)

    # Primary care

    @_once
    def pc_professional(self) -> DataFrame:
        return primary_care.pc_professional(self.spend(), self.lists).drop("is_physician")

    @_once
    def pc_wellness_npi(self) -> DataFrame:
        return self._table("pc_wellness_npi", lambda: primary_care.pc_wellness_npi(self.spend()))

    @_once
    def pc_step5(self) -> DataFrame:
        return self._table(
            "pc_step5",
            lambda: primary_care.pc_step5(
                primary_care.pc_professional(self.spend(), self.lists), self.pc_wellness_npi()
            ),
            ["yr"],
            of=[self.lists],
        )

    @_once
    def pc_outpatient_line(self) -> DataFrame:
        return primary_care.pc_outpatient_line(self.sources["outpatient"], self.strict)

    @_once
    def pc_facility_split(self) -> DataFrame:
        return self._table(
            "pc_facility_split",
            lambda: primary_care.pc_facility_split(self.pc_outpatient_line(), self.pc_step5()),
            of=[self.lists],
        )

    @_once
    def pc_fqhc(self) -> DataFrame:
        return primary_care.pc_fqhc(self.pc_outpatient_line(), self.lists)

    @_once
    def primary_care_by_year(self) -> DataFrame:
        return primary_care.primary_care_by_year(
            self.pc_step5(), self.pc_facility_split(), self.pc_fqhc(), self.spend_fact(), self.mm_fact(), self.window
        )

    @_once
    def primary_care_by_service(self) -> DataFrame:
        return primary_care.primary_care_by_service(self.pc_step5(), self.window)

    # Drivers of change

    def volume_price_split(self, by: Sequence[str] = ()) -> DataFrame:
        return drivers.volume_price_split(
            self.ip_fact(), self.mm_fact(), self.window.start, self.window.end, by
        )

    def utilization_rate(self, by: Sequence[str] = ()) -> DataFrame:
        return drivers.utilization_rate(self.ip_fact(), self.mm_fact(), by)

    @_once
    def growth_contribution(self) -> DataFrame:
        return drivers.growth_contribution(self.pmpm_by_category(), self.window.start, self.window.end)

    @_once
    def average_annual_growth(self) -> DataFrame:
        return drivers.average_annual_growth(self.pmpm_total())

    # Checks

    @_once
    def claim_sums(self) -> DataFrame:
        return self._table("claim_sums", lambda: validation.claim_sums(self.claim_line()))

    @_once
    def category_sums(self) -> DataFrame:
        return self._table(
            "category_sums", lambda: validation.category_sums(self.claim_line_cat(), self.window), of=[self.window]
        )

    @_once
    def spend_sums(self) -> DataFrame:
        return self._table(
            "spend_sums",
            lambda: validation.spend_sums(self.spend(), self.sources["outpatient"], self.window),
            of=[self.window],
        )

    def checks(self) -> dict[str, Callable[[], DataFrame]]:
        """The ten checks by name; each is built only when called.

        Those on row-level tables read sums by claim file, stored with a few rows each: one pass over the claim lines, one
        over the same lines with their categories, as spend takes them, and one over spend serve checks 1 to 4, 8 and 9.
        """
        return {
            "row_counts": lambda: validation.check_row_counts(self.sources, self.claim_sums()),
            "unmapped": lambda: validation.check_unmapped(self.category_sums()),
            "dollars_preserved": lambda: validation.check_dollars_preserved(self.claim_sums(), self.category_sums()),
            "eligible_share": lambda: validation.check_eligible_share(self.category_sums(), self.spend_sums()),
            "monthly_vs_annual": lambda: validation.check_monthly_vs_annual(
                self.sources["beneficiary"], self.mm_fact(), self.window
            ),
            "pmpm_rebuild": lambda: validation.check_pmpm_rebuild(
                self.pmpm_by_category(), self.spend_fact(), self.mm_fact()
            ),
            "wellness": lambda: validation.check_wellness(self.pc_wellness_npi()),
            "office_em": lambda: validation.check_office_em(self.spend_sums()),
            "dialysis_share": lambda: validation.check_dialysis_share(self.spend_sums()),
            "pc_facility": lambda: validation.check_pc_facility(self.pc_facility_split(), self.pc_fqhc()),
        }

    @_once
    def input_report(self) -> DataFrame:
        """Cells that can't be read and enrollment listed twice; from the source tables alone."""
        return input_report.input_report(self.sources)

    @_once
    def validation(self) -> DataFrame:
        return validation.validation([build() for build in self.checks().values()])
