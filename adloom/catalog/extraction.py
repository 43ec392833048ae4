"""Fields, labels and links out of HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.catalog import bindings as b
from adloom.functions.markup import hrefs_of, title_of
from adloom.functions.text import collapse
from adloom.session import spread
from adloom.sources import pages as pg


def _pages(s, f):
    return b.table(s, f, "pages")


def _now():
    return F.lit(b.RUN_TIME).cast("timestamp")


def _udtf(s, f):
    pg.register(s)
    return s.sql("SELECT page_id, l.ord, l.href FROM {pages} p, LATERAL ad_links(p.html) l", pages=_pages(s, f))


FIELDS = {"pay": pg.SALARY_LABELS, "hours": pg.HOURS_LABELS, "employer": pg.COMPANY_LABELS}

QUERIES = {
    "extract_title": lambda s, f: spread(_pages(s, f).select("page_id", "html")).select(
        "page_id", collapse(F.coalesce(pg.parse(F.col("html"), wanted=["title"])["title"], F.lit(""))).alias("title")
    ),
    "title_by_pattern": lambda s, f: _pages(s, f).select("page_id", title_of(F.col("html")).alias("title")),
    "extract_links": lambda s, f: pg.extract_links(_pages(s, f), b.HOST, token="/").select("page_id", "ord", "url"),
    "udtf_links": _udtf,
    "sample_links": lambda s, f: _pages(s, f).select(
        "page_id", F.array_join(pg.sample_links(hrefs_of(F.col("html"))), " ").alias("links")
    ),
    "links_with_fallback": lambda s, f: pg.listing_links(
        _pages(s, f), b.HOST, primary=lambda a: F.startswith(a["href"], F.lit("/th")), prefix="/e"
    ).select("page_id", "ord", "url"),
    "link_titles": lambda s, f: pg.listing_links(b.listing_pages(s, f), b.HOST),
    "card_links": lambda s, f: pg.card_links(b.card_listing_pages(s, f), b.HOST).drop("_error"),
    "extract_labels": lambda s, f: pg.extract_labels(b.ad_pages(s, f, b.LIST_PAGE), "p_partkey"),
    "label_fallback": lambda s, f: pg.label_fallback(b.ad_pages(s, f, b.LIST_PAGE), "p_partkey", FIELDS),
    "extract_ads": lambda s, f: pg.extract_ads(b.ad_pages(s, f, b.LIST_PAGE), now=_now()).drop("_error"),
    "extract_ads_card": lambda s, f: pg.extract_ads(
        b.ad_pages(s, f, b.CARD_PAGE), "card", now=_now(), titled_only=False
    ).drop("_error"),
    "sample_ads": lambda s, f: pg.sample_ads(
        b.card_listing_pages(s, f), b.linked_card_pages(s, f), b.HOST
    ).select("id", "url", "title", "company"),
    "extract_ads_pages": lambda s, f: pg.extract_ads(_pages(s, f), now=_now(), keep=("page_id",))
    .drop("_error")
    .withColumns({c: collapse(F.col(c)) for c in ("title", "location")}),
}

_UNESCAPED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&middot;": "·", "&amp;": "&"}


def _unescape(c: str) -> str:
    for a, z in _UNESCAPED.items():
        c = f"regexp_replace({c}, '{a}?', '{z}', 'g')"
    return c


_TITLE = b.sql_collapse(
    _unescape(r"regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")
)
# Without labels, the place of an ad is the paragraph next to its heading.
_BESIDE = b.sql_collapse(
    _unescape(r"regexp_replace(regexp_extract(html, '(?is)</h1><p>(.*?)(?:</?p>|</article>)', 1), '<[^>]*>', ' ', 'g')")
)
_HREFS = r"""regexp_extract_all(html, '(?is)<a\b[^>]*?\shref="([^"]+)"', 1)"""
_ALL = f"hrefs AS (SELECT page_id, {_HREFS} AS hrefs FROM pages)"


def _exploded(items: str) -> str:
    return f"SELECT page_id, unnest(range(len({items}))) AS i, unnest({items}) AS href FROM hrefs"


_URL = f"'{b.HOST}' || split_part({_unescape('href')}, '?', 1)"
_AD_URL = f"'{b.HOST}/job/' || p_partkey || '.html'"
_CHOSEN = """CASE WHEN len(list_filter(hrefs, lambda h: starts_with(h, '/th'))) > 0
    THEN list_filter(hrefs, lambda h: starts_with(h, '/th')) ELSE list_filter(hrefs, lambda h: starts_with(h, '/e')) END"""
_PAY = "'£' || p_size || ' per hour. Call or text 07123456789'"

ORACLE = {
    "title_by_pattern": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "extract_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "extract_links": f"""WITH {_ALL} SELECT page_id, CAST(i AS INT) AS ord, {_URL} AS url FROM ({_exploded('hrefs')})
        WHERE contains(href, '/')""",
    "udtf_links": f"WITH {_ALL} SELECT page_id, CAST(i AS INT) AS ord, {_unescape('href')} AS href FROM ({_exploded('hrefs')})",
    "sample_links": f"WITH {_ALL} SELECT page_id, array_to_string(list_slice(hrefs, 1, 5), ' ') AS links FROM hrefs",
    "links_with_fallback": f"""WITH {_ALL} SELECT page_id, CAST(i AS INT) AS ord, {_URL} AS url FROM ({_exploded(_CHOSEN)})""",
    "link_titles": f"""SELECT p_partkey AS page_id, 0 AS ord, '{b.HOST}/job/' || p_partkey AS url, p_brand AS title
            FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT p_partkey, 1, '{b.HOST}/more/' || p_partkey, p_name FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT p_partkey, 0, '{b.HOST}/p/' || p_size, p_name FROM part WHERE p_partkey % 3 = 1
        UNION ALL SELECT p_partkey, 1, '{b.HOST}/p/' || p_partkey, '' FROM part WHERE p_partkey % 3 = 1""",
    "card_links": f"""SELECT p_partkey AS page_id, 0 AS ord, '{b.HOST}/oferta/praca/' || p_partkey || '.html?r=1' AS url,
            p_name AS title FROM part
        UNION ALL SELECT p_partkey, 1, 'https://x.example.org/oferta/praca/' || p_size, NULL FROM part""",
    "extract_labels": f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Salary' ELSE 'Pay' END AS label, {_PAY} AS value FROM part
        UNION ALL SELECT p_partkey, unnest(['Contract Type', 'Contract']), p_type FROM part
        UNION ALL SELECT p_partkey, 'Working hours', 'Part time' FROM part
        UNION ALL SELECT p_partkey, 'Employer', p_brand || ' & Co' FROM part""",
    "label_fallback": f"""SELECT p_partkey, {_PAY} AS pay, 'Part time' AS hours, p_brand || ' & Co' AS employer FROM part""",
    "extract_ads": f"""SELECT p_partkey || '.html' AS id, {_AD_URL} AS url, p_name AS title, p_brand || ' & Co' AS company,
            '£' || p_size || ' per hour.' AS salary, CASE WHEN p_partkey % 2 = 0 THEN 'Area ' || p_size ELSE '' END AS location,
            'Part time' AS work_time, p_type AS contract_type, '{b.RUN_TIME}' AS scraped_at,
            'A ' || p_name || ' by ' || p_brand AS description FROM part""",
    "extract_ads_card": f"""SELECT CAST(p_partkey AS VARCHAR) AS id, {_AD_URL} AS url, p_name AS title, p_brand AS company,
            p_size || ' zł' AS salary, '' AS location, 'pełny' AS work_time, p_type AS contract_type,
            '{b.RUN_TIME}' AS scraped_at, 'A ' || p_name || ' by ' || p_brand AS description FROM part""",
    "sample_ads": f"""SELECT p_partkey || '?r=1' AS id, '{b.HOST}/oferta/praca/' || p_partkey || '.html?r=1' AS url,
            p_name AS title, p_brand AS company FROM part WHERE p_size <= 25""",
    "extract_ads_pages": f"""SELECT page_id, split_part(rtrim(url, '/'), '/', -1) AS id, url, {_TITLE} AS title, '' AS company, '' AS salary,
            {_BESIDE} AS location, '' AS work_time, '' AS contract_type, '{b.RUN_TIME}' AS scraped_at, '' AS description FROM pages
        WHERE {_TITLE} <> ''""",
}
