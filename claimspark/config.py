"""Parameters of an analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StudyWindow:
    """Years that are reported; ``base`` is the year the average annual growth counts from."""

    start: int = 2016
    end: int = 2022
    base: int = 2016

    def contains(self, yr: Column | str = "yr") -> Column:
        year = F.col(yr) if isinstance(yr, str) else yr
        return year.between(self.start, self.end)
