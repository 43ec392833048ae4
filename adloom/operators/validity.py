"""Which records count as ads, and how many of them there are.

Two tests are in use and differ on purpose: a title of `" 403 ERROR "` is stored but not an error
page's, an empty title is no stored ad but no error either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.text import strip
from adloom.schema import ERROR_TITLE


def is_stored(title: Column | str = "title") -> Column:
    """Title is filled and is not the error mark as it stands."""
    title = F.col(title) if isinstance(title, str) else title
    return (title != "") & (title != ERROR_TITLE)


def is_no_error(title: Column | str = "title") -> Column:
    """Title is not the error mark once stripped; empty titles pass."""
    title = F.col(title) if isinstance(title, str) else title
    return strip(F.coalesce(title, F.lit(""))) != ERROR_TITLE


def stored_ads(ads: DataFrame) -> DataFrame:
    return ads.filter(is_stored())


def without_errors(ads: DataFrame) -> DataFrame:
    return ads.filter(is_no_error())


def stored_count(ads: DataFrame) -> DataFrame:
    """One row: how many ads count towards a target."""
    return ads.agg(F.count_if(is_stored()).alias("n"))


def quality_counts(ads: DataFrame) -> DataFrame:
    """One row from one pass: all records, valid ones and error pages."""
    return ads.agg(
        F.count("*").alias("total_records"),
        F.count_if(is_no_error()).alias("valid_records"),
        F.count_if(~is_no_error()).alias("error_records"),
    )
