"""Bringing tables into the common ad format and putting them together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.text import stamp
from adloom.schema import ADS_COLUMNS


def align(df: DataFrame, rename: Mapping[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ten ad columns in order: missing ones empty, others dropped, `rename` applied first.

    `keep` names further columns to carry along in front.
    """
    df = df.withColumnsRenamed(dict(rename or {}))
    return df.select(
        *keep,
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
            for c in ADS_COLUMNS
        ],
    )


def union_ads(stored: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows of all tables, repeats included."""
    for df in more:
        stored = stored.unionByName(df)
    return stored


def union_sources(sources: Mapping[str, DataFrame], renames: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Tables of several sources in the common format, with the name of the source."""
    tables = [
        align(df, (renames or {}).get(name)).withColumn("source", F.lit(name)) for name, df in sources.items()
    ]
    return union_ads(*tables)


def stamp_rows(ads: DataFrame, now: Column | None = None) -> DataFrame:
    """Set `scraped_at` to the time of the run."""
    return ads.withColumn("scraped_at", stamp(F.current_timestamp() if now is None else now))


def sample_head(ads: DataFrame, n: int = 3, pos: str = "pos") -> DataFrame:
    """The first `n` rows in position order."""
    return ads.orderBy(pos).limit(n)
