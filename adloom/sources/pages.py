"""Ads, labels and links out of tables of fetched pages.

`parse` turns HTML into a struct of page parts, once per page; everything after it is Column
expressions, so the choice of fields stays visible to the optimizer.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.markup import hrefs_of
from adloom.functions.salary import salary_clean, salary_or_extracted
from adloom.functions.text import collapse, first_filled, stamp, strip
from adloom.functions.urls import absolute_url, canonical_url, id_from_html_url, id_from_url
from adloom.schema import ADS_COLUMNS
from adloom.session import spread
from adloom.sources import pagetree
from adloom.sources.pagetree import PARTS, read_fields, read_links

# Executors need not have this package installed: the helper travels with the function.
register_pickle_by_value(pagetree)

# Synonyms of the labels of each field, in the order they are tried.
SALARY_LABELS = ["Salary", "Pay", "Wage", "Rate"]
CONTRACT_LABELS = ["Contract Type", "Contract"]
HOURS_LABELS = ["Hours", "Working hours", "Work hours"]
COMPANY_LABELS = ["Recruiter", "Company", "Advertiser", "Employer"]
LOCATION_LABELS = ["Location", "Area"]

# Labels of the card layout and the class of the value beside each.
CARD_SALARY, CARD_LOCATION, CARD_HOURS, CARD_CONTRACT = "Wynagrodzenie", "Lokalizacja", "Wymiar pracy", "Typ umowy"
CARD_VALUES = {
    CARD_SALARY: "css-bf1kxk",
    CARD_LOCATION: "css-k31xxj",
    CARD_HOURS: "css-k31xxj",
    CARD_CONTRACT: "css-k31xxj",
}
CARD_DESCRIPTION = ".css-1i3492"

# Where location and description are looked for, in order.
LOCATION_TAGS = ["h4", "h3", "p"]
LOCATION_BLOCKS = ["data-q=vip-location", ".location", "itemprop=addressLocality"]
DESCRIPTION_BLOCKS = [
    "data-q=vip-description",
    "itemprop=description",
    "#vip__description",
    ".vip__description",
    ".description",
]

# How links to ads are told from other anchors.
LINK_MARKER = ("data-q", "search-result-anchor")
LINK_PREFIX = "/p/"
LINK_TOKEN = "/oferta/praca/"

ALL_LABELS = [*SALARY_LABELS, *CONTRACT_LABELS, *HOURS_LABELS, *COMPANY_LABELS, *LOCATION_LABELS]

# Parts of a page. `after_h1` has the text of the element behind a heading by its tag, `labels` and
# `cards` have values by label, `blocks` texts by selector; a link has its heading (`own`), the
# heading around it (`near`, marked links only) and its level-four heading.
PAGE_TYPE = (
    "struct<title:string,after_h1:map<string,string>,labels:map<string,string>,cards:map<string,string>,"
    "described:string,blocks:map<string,string>,_error:string>"
)
LINKS_TYPE = (
    "struct<links:array<struct<href:string,marked:boolean,own:string,near:string,h4:string>>,_error:string>"
)

_TEXT = pa.string()
_TEXTS = pa.map_(_TEXT, _TEXT)
_MAPS = ("after_h1", "labels", "cards", "blocks")
# What the fields of each layout are taken from.
LAYOUT_PARTS = {"list": ("title", "after_h1", "labels", "described", "blocks"), "card": ("title", "after_h1", "cards", "blocks")}
_PAGE = pa.struct(
    {
        "title": _TEXT,
        "after_h1": _TEXTS,
        "labels": _TEXTS,
        "cards": _TEXTS,
        "described": _TEXT,
        "blocks": _TEXTS,
        "_error": _TEXT,
    }
)
_LINK = pa.struct({"href": _TEXT, "marked": pa.bool_(), "own": _TEXT, "near": _TEXT, "h4": _TEXT})
_LINKS = pa.struct({"links": pa.list_(_LINK), "_error": _TEXT})


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages kept as one HTML file each, with the file as URL."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    return files.select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))


def _per_page(read: Callable[[str], dict], arrow: pa.DataType, spark_type: str) -> Callable[[Column], Column]:
    """A vectorised function that reads each page and reports what it cannot read in `_error`.

    Declared nondeterministic only so that a filter on a part does not make it run twice.
    """

    def parts(html):
        try:
            return read(html)
        except Exception as e:  # one broken page must not end the job
            return {"_error": f"{type(e).__name__}: {e}"}

    def pages(batch: pa.Array) -> pa.Array:
        return pa.array((parts(h.as_py()) for h in batch), type=arrow)

    return F.arrow_udf(pages, returnType=spark_type).asNondeterministic()


def parse(html: Column, labels: Sequence[str] = (), wanted: Collection[str] = PARTS) -> Column:
    """The parts of a page that make up an ad, of which only `wanted` ones are worked out.

    `labels` names labels beyond the known ones.
    """
    asked = frozenset(wanted)
    known = [*ALL_LABELS, *labels]
    selectors = frozenset([*LOCATION_BLOCKS, *DESCRIPTION_BLOCKS, CARD_DESCRIPTION])

    def read(text):
        page = read_fields(text, known, CARD_VALUES, selectors, asked)
        return {**page, **{m: list(page[m].items()) for m in _MAPS if m in page}}

    return _per_page(read, _PAGE, PAGE_TYPE)(html)


def parse_links(html: Column) -> Column:
    """The links of a page with their headings, in document order."""
    return _per_page(lambda text: {"links": read_links(text, LINK_MARKER)}, _LINKS, LINKS_TYPE)(html)


def _at(texts: Column, key: str) -> Column:
    return F.try_element_at(texts, F.lit(key))


def any_label(labels: Column, names: Sequence[str]) -> Column:
    """The first filled value of several labels."""
    return first_filled(*[_at(labels, n) for n in names])


def _list_fields(page: Column) -> dict[str, Column]:
    labels, blocks = page["labels"], page["blocks"]
    location = first_filled(
        *[collapse(_at(page["after_h1"], t)) for t in LOCATION_TAGS],
        *[collapse(_at(blocks, b)) for b in LOCATION_BLOCKS],
        *[_at(labels, n) for n in LOCATION_LABELS],
    )
    # The first block that exists is taken, even an empty one.
    description = F.coalesce(
        page["described"], *[collapse(_at(blocks, b)) for b in DESCRIPTION_BLOCKS], F.lit("")
    )
    return {
        "company": any_label(labels, COMPANY_LABELS),
        "salary": any_label(labels, SALARY_LABELS),
        "location": location,
        "work_time": any_label(labels, HOURS_LABELS),
        "contract_type": any_label(labels, CONTRACT_LABELS),
        "description": description,
    }


def _card_fields(page: Column) -> dict[str, Column]:
    cards = page["cards"]
    return {
        "company": F.coalesce(strip(_at(page["after_h1"], "p")), F.lit("")),
        "salary": F.coalesce(_at(cards, CARD_SALARY), F.lit("")),
        "location": F.coalesce(_at(cards, CARD_LOCATION), F.lit("")),
        "work_time": F.coalesce(_at(cards, CARD_HOURS), F.lit("")),
        "contract_type": F.coalesce(_at(cards, CARD_CONTRACT), F.lit("")),
        "description": F.coalesce(collapse(_at(page["blocks"], CARD_DESCRIPTION)), F.lit("")),
    }


def extract_ads(
    pages: DataFrame,
    layout: str = "list",
    now: Column | None = None,
    titled_only: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Pages (url, html) of single ads into the ad table, with `_error` for unreadable ones.

    `layout` is "list" (terms and definitions) or "card". `titled_only` drops pages without a
    title. A page of an error has a title and is kept, as `clean_errors` deals with those.
    """
    page = F.col("_page")
    parsed = spread(pages.select(*keep, "url", "html")).select(*keep, "url", parse(F.col("html"), wanted=LAYOUT_PARTS[layout]).alias("_page"))
    fields = _list_fields(page) if layout == "list" else _card_fields(page)
    ads = parsed.select(
        *keep,
        (id_from_url if layout == "list" else id_from_html_url)(F.col("url")).alias("id"),
        "url",
        F.coalesce(strip(page["title"]), F.lit("")).alias("title"),
        stamp(F.current_timestamp() if now is None else now).alias("scraped_at"),
        *[value.alias(name) for name, value in fields.items()],
        page["_error"].alias("_error"),
    )
    if titled_only:
        ads = ads.filter("title != ''")
    if layout == "list":
        # In steps, so that each text is worked out once and then reused.
        ads = ads.withColumn("salary", salary_clean(F.col("salary")))
        ads = ads.withColumn("salary", salary_or_extracted(F.col("salary"), F.col("description")))
    return ads.select(*keep, *ADS_COLUMNS, "_error")


def extract_labels(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The labels of each page with their values, one row per label that has one."""
    parsed = spread(pages.select(key, html)).select(key, parse(F.col(html), wanted=["labels"]).alias("_page"))
    return parsed.select(key, F.explode("_page.labels").alias("label", "value"))


def label_fallback(pages: DataFrame, key: str, fields: Mapping[str, Sequence[str]], html: str = "html") -> DataFrame:
    """One column per field with the first filled value of its labels."""
    extra = [n for names in fields.values() for n in names if n not in ALL_LABELS]
    parsed = spread(pages.select(key, html)).select(key, parse(F.col(html), extra, ["labels"]).alias("_page"))
    return parsed.select(key, *[any_label(F.col("_page.labels"), names).alias(f) for f, names in fields.items()])


def extract_links(pages: DataFrame, host: str, token: str | None = None) -> DataFrame:
    """Links of each listing page in document order, by pattern and without a parser.

    `token` keeps only targets that contain it.
    """
    links = pages.select("page_id", F.posexplode(hrefs_of(F.col("html"))).alias("ord", "href"))
    if token is not None:
        links = links.filter(F.contains(F.col("href"), F.lit(token)))
    return links.withColumn("url", canonical_url(F.col("href"), host))


def with_fallback(links: Column, primary: Callable[[Column], Column], fallback: Callable[[Column], Column]) -> Column:
    """The links that pass the first test, or those that pass the second if there are none."""
    chosen = F.filter(links, primary)
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.filter(links, fallback))


def listing_links(
    pages: DataFrame,
    host: str,
    keep: Sequence[str] = ("page_id",),
    primary: Callable[[Column], Column] | None = None,
    prefix: str = LINK_PREFIX,
) -> DataFrame:
    """Ad links with titles: marked anchors, else anchors below `prefix`.

    The title is a heading in the anchor; marked anchors may take it from the element around them.
    """
    marked = primary or (lambda a: a["marked"])
    parsed = spread(pages.select(*keep, "html")).select(*keep, parse_links(F.col("html")).alias("_page"))
    chosen = with_fallback(F.col("_page.links"), marked, lambda a: F.startswith(a["href"], F.lit(prefix)))
    link = F.col("link")
    return parsed.select(*keep, F.posexplode(chosen).alias("ord", "link")).select(
        *keep,
        "ord",
        canonical_url(link["href"], host).alias("url"),
        first_filled(strip(link["own"]), strip(link["near"])).alias("title"),
    )


def card_links(pages: DataFrame, host: str, keep: Sequence[str] = ("page_id",), token: str = LINK_TOKEN) -> DataFrame:
    """Links whose target contains `token`, query kept; the title is null without a heading."""
    parsed = spread(pages.select(*keep, "html")).select(*keep, parse_links(F.col("html")).alias("_page"))
    chosen = F.filter(F.col("_page.links"), lambda a: F.contains(a["href"], F.lit(token)))
    return parsed.select(*keep, F.posexplode(chosen).alias("ord", "link"), F.col("_page._error")).select(
        *keep,
        "ord",
        absolute_url(F.col("link.href"), host).alias("url"),
        strip(F.col("link.h4")).alias("title"),
        "_error",
    )


def sample_links(links: Column, n: int = 5) -> Column:
    """The first `n` links of a page."""
    return F.slice(links, 1, n)


def sample_ads(listing: DataFrame, details: DataFrame, host: str, n: int = 5, token: str = LINK_TOKEN) -> DataFrame:
    """Ads of the first `n` links of each listing page, found among fetched pages by URL."""
    hrefs = F.slice(F.filter(hrefs_of(F.col("html")), lambda h: F.contains(h, F.lit(token))), 1, n)
    wanted = listing.select(F.explode(hrefs).alias("href")).select(absolute_url(F.col("href"), host).alias("url"))
    return extract_ads(details.join(wanted.distinct(), "url", "left_semi"), "card", titled_only=False)


def register(spark: SparkSession) -> None:
    """Make `ad_links(html)` a table function of SQL: `SELECT ... FROM pages, LATERAL ad_links(html)`."""

    @F.udtf(returnType="ord int, href string, title string", useArrow=True)
    class AdLinks:
        def eval(self, html: str):
            for i, link in enumerate(read_links(html, LINK_MARKER)):
                yield i, link["href"], link["own"] or link["near"] or ""

    spark.udtf.register("ad_links", AdLinks)
