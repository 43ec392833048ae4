"""Text, URL and salary functions, and the common format."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.catalog import bindings as b
from adloom.functions import salary, text, urls
from adloom.functions.categories import CATEGORY_TERMS, category_filter
from adloom.operators import shape
from adloom.functions.markup import hrefs_of
from adloom.operators.frontier import listing_choice, listing_frontier

# Only what the common format needs to be told about pages as another source.
PAGE_RENAMES = {"html": "description"}


def _tried(s, f):
    """Every candidate with the links found there; two in three of the fetches give the page, the others none."""
    pages = b.table(s, f, "pages").select("page_id", "url", F.size(hrefs_of(F.col("html"))).alias("links"))
    fails = (F.col("page_id") + F.col("page") + F.col("attempt")) % 3 == 0
    return listing_frontier(pages, 3).withColumn("n_links", F.when(~fails, F.col("links")))


def _of_url(function, name):
    return lambda s, f: b.table(s, f, "pages").select("page_id", function(F.col("url")).alias(name))


def _of_page(s, f):
    return b.table(s, f, "pages").select("url", "html", F.col("page_id").cast("string").alias("id"))


def _now():
    return F.lit(b.RUN_TIME).cast("timestamp")


QUERIES = {
    "title_norm": lambda s, f: b.ads(s, f).select("pos", text.normalized(F.col("title")).alias("title_norm")),
    "collapse_ws": lambda s, f: b.ads(s, f).select("pos", text.collapse(F.col("description")).alias("description")),
    "id_from_url": _of_url(urls.id_from_url, "id"),
    "id_from_url_html": _of_url(urls.id_from_html_url, "id"),
    "normalize_base_url": _of_url(urls.normalize_base_url, "base"),
    "canonical_url": _of_url(lambda u: urls.canonical_url(F.regexp_replace(u, "^https?://[^/]*", ""), b.HOST), "url"),
    "absolute_url": _of_url(lambda u: urls.absolute_url(F.regexp_replace(u, "^http://[^/]*", ""), b.HOST), "url"),
    "set_query_param": lambda s, f: b.table(s, f, "pages").select(
        "page_id", urls.set_query_param(F.col("url"), "page", F.col("page_id")).alias("url")
    ),
    "listing_frontier": lambda s, f: listing_frontier(b.table(s, f, "pages").select("page_id", "url"), 3).select(
        "page_id", "page", "attempt", "candidate"
    ),
    "listing_choice": lambda s, f: listing_choice(_tried(s, f), ["page_id", "page"]),
    "salary_extract": lambda s, f: b.salary_texts(s, f).select(
        "p_partkey", salary.salary_or_extracted(F.lit(""), F.col("description")).alias("salary")
    ),
    "salary_clean": lambda s, f: b.raw_salaries(s, f).select("p_partkey", salary.salary_clean(F.col("raw")).alias("salary")),
    "category_filter": lambda s, f: category_filter(b.titled_parts(s, f)),
    "align_schema": lambda s, f: shape.align(
        b.table(s, f, "documents"), {"text": "description", "lang": "company", "source": "location"}, keep=("doc_id",)
    ),
    "union_all_ads": lambda s, f: shape.union_ads(
        b.stored(s, f), b.ads(s, f).filter((F.col("pos") - 2) % 3 != 0)
    ),
    "union_sources": lambda s, f: shape.union_sources(
        {"documents": b.ads(s, f), "pages": _of_page(s, f)}, {"pages": PAGE_RENAMES}
    ),
    "sample_head": lambda s, f: shape.sample_head(b.ads(s, f)).select("pos", "title", "salary", "location"),
    "stamp_rows": lambda s, f: shape.stamp_rows(b.ads(s, f), _now()).select("pos", "scraped_at"),
}

_BASE = "regexp_replace(rtrim(url, '/'), '/page[0-9]+$', '')"
_PARTS = f"""parts AS (SELECT page_id, u, regexp_extract(u, '^[^?#]*') AS path,
    regexp_extract(u, '[?]([^#]*)', 1) AS query, regexp_extract(u, '#.*$') AS fragment FROM urls)"""


def _with_page(page: str) -> str:
    return f"""path || '?' || CASE WHEN query = '' THEN 'page=' || {page}
        WHEN regexp_matches(query, '(^|&)page=') THEN regexp_replace(query, '(^|&)page=[^&]*', '\\1page=' || {page})
        ELSE query || '&page=' || {page} END || fragment"""


def _found(rule: str, spelled: str) -> str:
    return f"WHEN regexp_matches(description, '{rule}', 'i') THEN {spelled}"


# The amount, period and rules of salaries, as SQL takes them.
_N = "([0-9]+(?:,[0-9]{3})*(?:[.][0-9]+)?)"
_UNIT = r"\s*(?:per|/)\s*(hour|hr|day|week|month|annum|year|shift)"
_RULES = [(rf"£\s?{_N}\s*-\s*£\s?{_N}{_UNIT}", 3), (rf"£\s?{_N}\s*-\s*{_N}{_UNIT}", 3), (rf"£\s?{_N}{_UNIT}", 2)]


def _group(rule: str, i: int) -> str:
    return f"regexp_extract(description, '{rule}', {i}, 'i')"


def _spelled(rule: str, groups: int) -> str:
    high = f" || ' - £' || {_group(rule, 2)}" if groups == 3 else ""
    return f"'£' || {_group(rule, 1)}{high} || ' per ' || {_group(rule, groups)}"


_CATEGORY = " ".join(
    rf"WHEN regexp_matches(title, '\b(?:{'|'.join(terms)})\b', 'i') THEN '{name}'" for name, terms in CATEGORY_TERMS.items()
)

_EMPTY = ", ".join(f"'' AS {c}" for c in ("title", "company", "salary", "location", "work_time", "contract_type", "scraped_at"))

_FRONTIER = f"""urls AS (SELECT page_id, {_BASE} AS u FROM pages), {_PARTS},
    numbered AS (SELECT *, unnest([1, 2, 3]) AS page FROM parts),
    frontier AS (SELECT page_id, page, 0 AS attempt, CASE WHEN page = 1 THEN u
        ELSE rtrim(path, '/') || '/page' || page || substr(u, length(path) + 1) END AS candidate FROM numbered
        UNION ALL SELECT page_id, page, 1, {_with_page('page')} FROM numbered)"""

ORACLE = {
    "title_norm": f"WITH {b.ADS} SELECT pos, {b.TITLE_KEY} AS title_norm FROM ads",
    "collapse_ws": f"WITH {b.ADS} SELECT pos, {b.sql_collapse('description')} AS description FROM ads",
    "id_from_url": "SELECT page_id, split_part(rtrim(url, '/'), '/', -1) AS id FROM pages",
    "id_from_url_html": "SELECT page_id, replace(split_part(url, '/', -1), '.html', '') AS id FROM pages",
    "normalize_base_url": f"SELECT page_id, {_BASE} AS base FROM pages",
    "canonical_url": f"""SELECT page_id, '{b.HOST}' || split_part(regexp_replace(url, '^https?://[^/]*', ''), '?', 1) AS url
        FROM pages""",
    "absolute_url": f"""SELECT page_id, CASE WHEN url LIKE 'http://%' THEN '{b.HOST}' || regexp_replace(url, '^http://[^/]*', '')
        ELSE url END AS url FROM pages""",
    "set_query_param": f"""WITH urls AS (SELECT page_id, url AS u FROM pages), {_PARTS}
        SELECT page_id, {_with_page('page_id')} AS url FROM parts""",
    "listing_frontier": f"WITH {_FRONTIER} SELECT * FROM frontier",
    "listing_choice": f"""WITH {_FRONTIER} SELECT page_id, page, min(attempt) AS attempt, arg_min(candidate, attempt) AS candidate
        FROM frontier JOIN pages USING (page_id)
        WHERE (page_id + page + attempt) % 3 <> 0 AND regexp_matches(html, '(?i)<a[^>]*\\shref=') GROUP BY 1, 2""",
    "salary_extract": f"""WITH {b.SALARY_TEXTS} SELECT p_partkey,
        CASE {' '.join(_found(r, _spelled(r, g)) for r, g in _RULES)} ELSE '' END AS salary FROM texts""",
    "salary_clean": rf"""WITH {b.SQL_RAW_SALARIES}, cut AS (SELECT p_partkey, regexp_replace(regexp_replace(
            regexp_replace(raw, '\b0[0-9]{{9,10}}\b', '', 'g'), 'call or text[^.]*', '', 'gi'), '\S+@\S+', '', 'g') AS rest FROM raws)
        SELECT p_partkey, CASE WHEN regexp_matches(rest, '[£$€]|[0-9]+.*(?:per|/|hour|day|week|month|year|annum|shift)', 'i')
            THEN {b.sql_collapse('rest')} ELSE '' END AS salary FROM cut""",
    "category_filter": f"""WITH {b.TITLED_PARTS} SELECT * FROM (SELECT p_partkey, title, CASE {_CATEGORY} END AS category FROM titled)
        WHERE category IS NOT NULL""",
    "align_schema": """SELECT doc_id, '' AS id, '' AS url, '' AS title, lang AS company, '' AS salary, source AS location,
        '' AS work_time, '' AS contract_type, '' AS scraped_at, text AS description FROM documents""",
    "union_all_ads": f"WITH {b.ADS} SELECT pos, {b.ADS_LIST} FROM ads",
    "union_sources": f"""WITH {b.ADS} SELECT {b.ADS_LIST}, 'documents' AS source FROM ads
        UNION ALL SELECT {b.ADS_LIST}, 'pages' FROM (SELECT CAST(page_id AS VARCHAR) AS id, url, {_EMPTY}, html AS description FROM pages)""",
    "sample_head": f"WITH {b.ADS} SELECT pos, title, salary, location FROM ads ORDER BY pos LIMIT 3",
    "stamp_rows": f"WITH {b.ADS} SELECT pos, '{b.RUN_TIME}' AS scraped_at FROM ads",
}
