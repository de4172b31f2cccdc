"""Spark-native claims cost-driver analysis: member months, allowed dollars, PMPM, growth and primary care."""

from claimspark.config import StudyWindow
from claimspark.plans.cost_drivers import CostDrivers
from claimspark.sources.code_lists import CodeLists
from claimspark.sources.text_tables import Sources

__all__ = ["CodeLists", "CostDrivers", "Sources", "StudyWindow"]
