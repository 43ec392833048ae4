"""Accepting only unseen ads, and cutting at a budget.

Rows carry `pos`, an integer unique in the table that gives their order. Keys may repeat without
bound: repeats are combined before the shuffle, and rows are matched by position where every row
is wanted back, so a hot key is spread like any other rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.functions.text import headline, normalized, strip
from adloom.functions.urls import id_from_url
from adloom.operators.running import SLAB_WIDTH, cut, running_totals
from adloom.operators.validity import is_stored


def stored_ids(ads: DataFrame, ident: Callable[[Column], Column] = id_from_url) -> DataFrame:
    """Distinct identifiers, read off the URLs by `ident`; records without URL have none."""
    url = strip(F.coalesce(F.col("url"), F.lit("")))
    return ads.filter(url != "").select(ident(url).alias("id")).distinct()


def stored_titles(ads: DataFrame) -> DataFrame:
    """Distinct normalised titles of the stored ads; a title of spaces enters as empty."""
    return ads.filter(is_stored()).select(normalized(F.col("title")).alias("title_key")).distinct()


def distinct_keys(*keys: DataFrame) -> DataFrame:
    """Distinct union of key tables with the same column."""
    union = keys[0]
    for k in keys[1:]:
        union = union.union(k)
    return union.distinct()


def with_title_key(links: DataFrame) -> DataFrame:
    """Add the normalised title. Links without title are dropped, unless reading it failed
    (`_error` filled), which keeps them under a key of their own."""
    unread = F.col("_error").isNotNull() if "_error" in links.columns else F.lit(False)
    own = F.concat(F.lit("\x00unread "), F.col("pos").cast("string"))
    return links.withColumn(
        "title_key", F.when(unread, own).otherwise(normalized(F.col("title")))
    ).filter("title_key IS NOT NULL")


def not_stored(links: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Links whose key is not stored yet; repeats among them stay.

    The shuffle of the links feeds the join, so adaptive execution splits a hot key; repeats among the stored keys do
    not matter to an anti join.
    """
    return links.join(stored.select(key), key, "left_anti")


def first_seen(links: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The first link of each key."""
    rest = [c for c in links.columns if c != key]
    return (
        links.groupBy(key)
        .agg(F.min_by(F.struct(*rest), pos).alias("_row"))
        .select(key, "_row.*")
        .select(*links.columns)
    )


def accepted(links: DataFrame, stored: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """First link of each key that is not stored yet."""
    return first_seen(links, key, pos).join(stored.select(key).distinct(), key, "left_anti")


def skipped(links: DataFrame, stored: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Links that are stored already or repeat an earlier link: all the others."""
    taken = accepted(links.select(key, pos), stored, key, pos)
    return links.join(taken.select(pos), pos, "left_anti")


def skipped_preview(
    passed_over: DataFrame, page: Sequence[str] = ("page",), shown: int = 3, pos: str = "pos"
) -> DataFrame:
    """The first few skipped links of each page and how many more it has; `page` tells pages of all crawls apart."""
    page = list(page)
    totals = passed_over.groupBy(*page).agg(F.count("*").alias("total"))
    label = F.when(F.col("title") != "", headline(F.col("title"), 50)).otherwise(headline(F.col("url"), 50))
    return (
        passed_over.select(*page, pos, "id", label.alias("shown"))
        .withColumn("rank", F.row_number().over(W.partitionBy(*page).orderBy(pos)))
        .filter(F.col("rank") <= shown)
        .join(totals, page)
        .select(*page, "rank", pos, "id", "shown", F.greatest(F.col("total") - shown, F.lit(0)).alias("more"))
    )


def page_stats(
    links: DataFrame, stored: DataFrame, key: str, page: Sequence[str] = ("page",), pos: str = "pos"
) -> DataFrame:
    """Found, new and skipped links per page."""
    page = list(page)
    found = links.groupBy(*page).agg(F.count("*").alias("found"))
    new = (
        accepted(links.select(*page, key, pos), stored, key, pos).groupBy(*page).agg(F.count("*").alias("new"))
    )
    n_new = F.coalesce(F.col("new"), F.lit(0))
    return found.join(new, page, "left").select(
        *page, "found", n_new.alias("new"), (F.col("found") - n_new).alias("skipped")
    )


def crawl_summary(stored: DataFrame, found: DataFrame | int, new: DataFrame | int) -> DataFrame:
    """One row: links found, ads before, new ads, ads after. Only new rows count as new.

    Links and new ads are tables to count, or numbers of rows that have been counted already.
    """

    def count(rows: DataFrame | int) -> Column:
        return F.lit(rows).cast("long") if isinstance(rows, int) else rows.agg(F.count("*")).scalar()

    before = stored.agg(F.count_if(is_stored()).alias("before"))
    return before.select(
        count(found).alias("found"), "before", count(new).alias("new"), (F.col("before") + count(new)).alias("total_after")
    )


def budget_cut(
    links: DataFrame,
    budget: int | Column,
    by: Sequence[str] = (),
    pos: str | Sequence[Column] = "pos",
    width: int = SLAB_WIDTH,
) -> DataFrame:
    """The first `budget` rows in position order, overall or of each group in `by`.

    Slabs that start beyond the budget are dropped before any row is ranked.
    """
    keys = [*by, "_slab"]
    limit = F.lit(budget) if isinstance(budget, int) else budget
    rows = cut(links, by, pos, width)
    before = W.partitionBy(*by).orderBy("_slab").rowsBetween(W.unboundedPreceding, -1)
    slabs = (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        .filter(F.col("_before") < limit)
    )
    inside = W.partitionBy(*keys).orderBy(pos)
    return (
        rows.join(slabs, keys)
        .withColumn("_rank", F.col("_before") + F.row_number().over(inside))
        .filter(F.col("_rank") <= limit)
        .select(*links.columns)
    )


def remaining(target: int | Column, stored: DataFrame) -> Column:
    """What is still needed to reach the target, counting the stored ads."""
    target = F.lit(target) if isinstance(target, int) else target
    return target - stored.agg(F.count_if(is_stored())).scalar()


def budget_cut_pages(
    pages: DataFrame,
    target: int | Column,
    n: str = "n",
    by: Sequence[str] = (),
    page: str = "page",
    width: int = SLAB_WIDTH,
) -> DataFrame:
    """Whole pages until the target is reached; the page that reaches it is kept whole."""
    target = F.lit(target) if isinstance(target, int) else target
    summed = running_totals(pages, by, page, {"_done": F.col(n)}, width=width)
    return summed.filter(F.col("_done") - F.col(n) < target).drop("_done")
