"""Crawl logs: one row per crawl and listing page, pages numbered from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.operators.running import SLAB_WIDTH, previous_value, running_totals


def fingerprint(ids: Column, size: int | None = None) -> Column:
    """A digest of all identifiers of a page in their order, or of the first `size` only."""
    return F.md5(F.to_json(ids if size is None else F.slice(ids, 1, size)))


def stuck_pages(log: DataFrame, width: int = SLAB_WIDTH) -> DataFrame:
    """Mark pages that repeat the page before them: `stuck`."""
    seen = previous_value(log, ["crawl_id"], "page_num", "fp", "_previous", width)
    repeats = (F.col("fp") == F.col("_previous")) & (F.col("page_num") > 1)
    return seen.withColumn("stuck", F.coalesce(repeats, F.lit(False))).drop("_previous")


def first_stops(log: DataFrame, width: int = SLAB_WIDTH) -> DataFrame:
    """The page a crawl ends before, its first empty or stuck one: crawl_id, stop. Other crawls have no row."""
    ends = stuck_pages(log, width).filter((F.col("n_links") == 0) | F.col("stuck"))
    return ends.groupBy("crawl_id").agg(F.min("page_num").alias("stop"))


def before_stop(rows: DataFrame, stops: DataFrame, cap: int | None = None) -> DataFrame:
    """The rows on pages before the stop of their crawl, and up to page `cap` if there is one."""
    if cap is not None:
        rows = rows.filter(F.col("page_num") <= cap)
    joined = rows.join(stops, "crawl_id", "left").filter(F.col("stop").isNull() | (F.col("page_num") < F.col("stop")))
    return joined.select(*rows.columns)


def crawl_prefix(log: DataFrame, cap: int | None = None, width: int = SLAB_WIDTH) -> DataFrame:
    """The pages a crawl gets to: up to its first empty or stuck page, or the cap."""
    return before_stop(log, first_stops(log, width), cap)


def crawl_progress(log: DataFrame, n: str = "n_links", width: int = SLAB_WIDTH) -> DataFrame:
    """Running number of links found per crawl."""
    return running_totals(log, ["crawl_id"], "page_num", {"found_so_far": F.col(n)}, width=width)


def page_estimate(log: DataFrame) -> DataFrame:
    """Links a crawl has if all pages but the last are like the first; zeros if that is empty."""
    ends = log.groupBy("crawl_id").agg(
        F.min_by("n_links", "page_num").alias("first"),
        F.max_by("n_links", "page_num").alias("last"),
        F.max("page_num").cast("bigint").alias("pages"),
    )
    some = F.col("first") > 0
    return ends.select(
        "crawl_id",
        F.when(some, F.col("pages")).otherwise(F.lit(0)).alias("pages"),
        F.when(some, F.col("first") * (F.col("pages") - 1) + F.col("last")).otherwise(F.lit(0)).alias("estimated"),
    )
