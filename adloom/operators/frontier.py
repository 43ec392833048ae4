"""Listing pages to fetch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.functions.urls import normalize_base_url, page_path, set_query_param


def listing_choice(tried: DataFrame, by: Sequence[str] = ("page",)) -> DataFrame:
    """The first candidate of each page whose fetch has links: attempt, candidate. Pages without one have no row.

    `tried` is the frontier with `n_links`, the number of links found there, null for a failed fetch.
    """
    found = tried.filter(F.col("n_links") > 0)
    first = F.min_by(F.struct("attempt", "candidate"), "attempt").alias("_first")
    return found.groupBy(*by).agg(first).select(*by, "_first.*")


def listing_frontier(bases: DataFrame, pages: int, url: str = "url") -> DataFrame:
    """Candidate URLs of pages 1..`pages` of each base, in the order to try them.

    The first candidate has the page in the path, the second in the query.
    """
    base = normalize_base_url(F.col(url))
    numbered = bases.withColumn("_base", base).withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))
    forms = F.array(
        page_path(F.col("_base"), F.col("page")), set_query_param(F.col("_base"), "page", F.col("page"))
    )
    return numbered.select(*bases.columns, "page", F.posexplode(forms).alias("attempt", "candidate"))
