"""Uniqueness analysis of an ad table and the report on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.operators import duplicates as dup
from adloom.operators.validity import quality_counts
from adloom.session import materialize
from adloom.sources.ads import WRITING


@dataclass(frozen=True)
class Uniqueness:
    """Lazy parts of the analysis; each is worked out when it is used."""

    counts: DataFrame
    summary: DataFrame
    verdict: DataFrame
    duplicates: DataFrame
    preview: DataFrame

    @property
    def report(self) -> DataFrame:
        """The report in no particular order; it is put in order when it is written."""
        return dup.report(self.duplicates)


def analyze(ads: DataFrame, preview_limit: int = 10) -> Uniqueness:
    """Analyse ads with a `pos` column; error records take a position but are not compared."""
    marked = dup.marks(ads)
    found = dup.duplicates(marked)
    summed = dup.summary(marked)
    return Uniqueness(
        counts=quality_counts(ads),
        summary=summed,
        verdict=dup.verdict(summed),
        duplicates=found,
        preview=dup.preview_first(dup.duplicates(dup.marks(ads, dup.DECISIVE)), preview_limit),
    )


def write_report(analysis: Uniqueness, path: str) -> bool:
    """Write the report if a decisive criterion has duplicates; equal full records alone do not
    count. The files of the folder are in report order. The marks are worked out once, for both the decision and the
    report."""
    found = materialize(analysis.duplicates, "duplicates")
    if found.filter(F.col("type").isin(dup.DECISIVE)).isEmpty():
        return False
    ordered = dup.report(dup.in_report_order(found))
    ordered.write.mode("overwrite").options(**WRITING).csv(path)
    return True
