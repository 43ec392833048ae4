"""Incremental ingest: which links of a crawl become new ads.

Links have crawl_id, page_num, pos (order over all crawls, unique), id, url and title. A listing
page without links is one row with a null id. They are read several times, so they should be a
stored table and not an extraction that would run again. New links or ads that a budget counts and cuts
are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.urls import id_from_url
from adloom.operators import incremental as inc
from adloom.operators.crawl import before_stop, fingerprint, first_stops
from adloom.operators.ordering import first_rows
from adloom.operators.shape import align
from adloom.operators.validity import stored_count, without_errors
from adloom.session import materialize, materialize_counted
from adloom.sources.ads import read_csv
from adloom.sources.files import exists
from adloom.sources.pages import extract_ads, listing_links

PAGE = ["crawl_id", "page_num"]

# More links than one listing page can have, to number links over all pages.
ORDER_IN_PAGE = 1_000_000


def page_log(links: DataFrame, compared: int | None = None) -> DataFrame:
    """One row per listing page: number of links and a digest of all their ids, null on a page without any.

    `compared` takes the first so many ids of a page only. What is gathered is one fetched page at a time.
    """
    ids = F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id"))))
    paged = links.groupBy(*PAGE).agg(F.count("id").alias("n_links"), ids.alias("_ids"))
    return paged.select(*PAGE, "n_links", F.when(F.col("n_links") > 0, fingerprint(F.col("_ids.id"), compared)).alias("fp"))


def reached(
    links: DataFrame, cap: int | None = None, detect_loops: bool = True, compared: int | None = None
) -> DataFrame:
    """The links on pages that their crawl gets to; they meet one row per crawl that tells where it ends.

    A page repeats the one before it if all their identifiers agree, or the first `compared` of them.
    """
    log = page_log(links, compared)
    if not detect_loops:
        log = log.withColumn("fp", F.lit(None).cast("string"))
    return before_stop(links.filter("id IS NOT NULL"), first_stops(log), cap)


def target_of(spark: SparkSession, path: str) -> Column | None:
    """As many ads as another table has stored; no target if there is no such table."""
    return stored_count(read_csv(spark, path)).scalar() if exists(spark, path) else None


def ingest_by_id(
    links: DataFrame,
    fetched: DataFrame,
    stored: DataFrame,
    target: int | Column | None = None,
    cap: int | None = None,
    ident: Callable[[Column], Column] = id_from_url,
) -> DataFrame:
    """Ads of the new links by identifier that could be fetched and have a title, with the `pos` of their link.

    `fetched` has the ad of each fetched page by its url. What a listing shows as title does not matter: links without one
    are fetched as well, and only the title on the ad's own page counts. With a target, ads are taken in link order until
    it is reached together with the stored ones. `ident` reads the identifier off a stored URL.
    """
    return _ads_of(inc.accepted(reached(links, cap), inc.stored_ids(stored, ident), "id"), fetched, stored, target)


def _ads_of(new: DataFrame, fetched: DataFrame, stored: DataFrame, target: int | Column | None) -> DataFrame:
    titled = fetched.filter(F.coalesce(F.col("title"), F.lit("")) != "")
    ads = titled.join(new.select("pos", "url"), "url")
    if target is None:
        return ads
    # Positions of links may be sparse, so ranges of them are found from a sample.
    return first_rows(materialize(ads, "new-ads"), inc.remaining(target, stored), ["pos"])


def ingest_by_title(
    links: DataFrame, stored: DataFrame, target: int | None = None, cap: int | None = None
) -> DataFrame:
    """New links by normalised title, whole pages at a time until `target` new ones per crawl."""
    named = inc.with_title_key(reached(links, cap, detect_loops=False))
    new = inc.accepted(named, inc.stored_titles(stored), "title_key").drop("title_key")
    if target is None:
        return new
    new = materialize(new, "new-links")
    sizes = new.groupBy(*PAGE).agg(F.count("*").alias("n"))
    kept = inc.budget_cut_pages(sizes, target, by=["crawl_id"], page="page_num")
    # Pages are taken from the first on, so the last one taken tells all of them.
    last = kept.groupBy("crawl_id").agg(F.max("page_num").alias("_last"))
    return new.join(last, "crawl_id").filter(F.col("page_num") <= F.col("_last")).select(*new.columns)


def run_summary(
    links: DataFrame, stored: DataFrame, cap: int | None = None, ident: Callable[[Column], Column] = id_from_url
) -> DataFrame:
    """Totals of a run: found, new and all links are counted on the pages that a crawl gets to."""
    found, n = materialize_counted(reached(links, cap), "reached")
    return inc.crawl_summary(stored, n, inc.accepted(found, inc.stored_ids(stored, ident), "id"))


def ingest(
    listings: DataFrame,
    pages: DataFrame,
    stored: DataFrame,
    host: str,
    target: int | Column | None = None,
    now: Column | None = None,
    ident: Callable[[Column], Column] = id_from_url,
    cap: int | None = None,
    compared: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A whole run: listing pages to links, links to new ones, their pages to ads, and the ads appended.

    `listings` has page_id (order of the pages over all crawls), crawl_id, page_num and html; `pages` has url and html of
    what could be fetched. `cap` is the last page of a crawl that is looked at, `compared` the number of identifiers by which
    pages are told to repeat (all, if None). Returns the table after the run and its totals, both of links on pages that a crawl gets to;
    found links and new ads are counted while they are written.
    """
    found = listing_links(listings, host).select("page_id", "ord", "url", "title")
    order = F.col("page_id") * ORDER_IN_PAGE + F.col("ord")
    links = listings.select("page_id", "crawl_id", "page_num").join(found, "page_id", "left")
    links = links.select(*PAGE, order.alias("pos"), ident(F.col("url")).alias("id"), "url", "title")
    found, n_found = materialize_counted(reached(materialize(links, "links"), cap, compared=compared), "reached")
    new = materialize(inc.accepted(found, inc.stored_ids(stored, ident), "id"), "new-links")
    ads, n_ads = materialize_counted(_ads_of(new, load(new, pages, now=now), stored, target), "ads")
    return align(stored).unionByName(align(ads)), inc.crawl_summary(stored, n_found, n_ads)


def load(
    new: DataFrame, pages: DataFrame, layout: str = "list", now: Column | None = None, drop_errors: bool = False
) -> DataFrame:
    """Ads of the accepted links out of the fetched pages; only those pages are parsed.

    Error pages have a title and are stored like others unless `drop_errors` is set.
    """
    wanted = pages.join(new.select("url"), "url", "left_semi")
    ads = extract_ads(wanted, layout, now, titled_only=layout == "list")
    return without_errors(ads) if drop_errors else ads
