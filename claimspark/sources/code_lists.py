"""The three primary care code lists as small text tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions import codes

LIST_COLUMNS = {
    "pc_service_codes": ("hcpcs_cd", "claim_type", "service_group"),
    "pc_place_of_service": ("pos_cd", "description"),
    "pc_medicare_specialty": ("prvdr_spclty", "description", "is_physician"),
}


@dataclass(frozen=True)
class CodeLists:
    service_codes: DataFrame
    places: DataFrame
    specialties: DataFrame

    @classmethod
    def builtin(cls, spark: SparkSession) -> CodeLists:
        """The lists of the specification: 133 service codes, 13 places, 6 specialties, so always broadcast."""
        services = [
            (code, codes.PROFESSIONAL_OR_FACILITY, group)
            for group, members in codes.SERVICE_CODES.items()
            for code in members.split()
        ] + [(code, codes.FACILITY_ONLY, group) for group, code in codes.FACILITY_ONLY_SERVICE_CODES.items()]
        rows = {
            "pc_service_codes": services,
            "pc_place_of_service": list(codes.PLACES_OF_SERVICE.items()),
            "pc_medicare_specialty": [(code, *rest) for code, rest in codes.SPECIALTIES.items()],
        }
        return cls(
            *[
                F.broadcast(spark.createDataFrame(rows[name], ", ".join(f"{c} string" for c in columns)))
                for name, columns in LIST_COLUMNS.items()
            ]
        )

    @classmethod
    def from_csv(cls, spark: SparkSession, directory: str) -> CodeLists:
        """Lists of the user, one ``<name>.csv`` each with a header row; all text, matched by column name.

        Whether a list is small enough to be broadcast is left to Spark, which knows its bytes.
        """
        return cls(
            *[
                spark.read.csv(f"{directory}/{name}.csv", header=True, inferSchema=False, enforceSchema=False).select(*columns)
                for name, columns in LIST_COLUMNS.items()
            ]
        )
