"""The shared tables seen as ads, links, crawl logs, batch logs and pages, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.text import WHITESPACE
from adloom.operators.crawl import fingerprint
from adloom.operators.running import rank_in_order
from adloom.schema import ADS_COLUMNS, ERROR_TITLE
from adloom.session import materialize

HOST = "https://ads.example.com"
RUN_TIME = "2024-05-01 08:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# -- ads: documents with a title line, an identifier made of the text and some error records -----

def ads(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    ident = F.md5("text")
    return d.select(
        (F.col("doc_id") + 2).alias("pos"),
        ident.alias("id"),
        F.concat(F.lit(HOST + "/"), F.col("source"), F.lit("/"), ident, F.lit(".html")).alias("url"),
        F.when(F.col("doc_id") % 51 == 0, f" {ERROR_TITLE} ")
        .when(F.col("doc_id") % 17 == 0, ERROR_TITLE)
        .otherwise(F.substring_index("text", "\n", 1))
        .alias("title"),
        F.col("lang").alias("company"),
        F.lit("").alias("salary"),
        F.col("source").alias("location"),
        F.lit("Full time").alias("work_time"),
        F.lit("Permanent").alias("contract_type"),
        F.lit(RUN_TIME).alias("scraped_at"),
        F.col("text").alias("description"),
    )


ADS = f"""ads AS (
    SELECT doc_id + 2 AS pos, md5(text) AS id,
        '{HOST}/' || source || '/' || md5(text) || '.html' AS url,
        CASE WHEN doc_id % 51 = 0 THEN ' {ERROR_TITLE} ' WHEN doc_id % 17 = 0 THEN '{ERROR_TITLE}'
            ELSE split_part(text, chr(10), 1) END AS title,
        lang AS company, '' AS salary, source AS location, 'Full time' AS work_time,
        'Permanent' AS contract_type, '{RUN_TIME}' AS scraped_at, text AS description
    FROM documents)"""

ADS_LIST = ", ".join(ADS_COLUMNS)


def sql_strip(c: str) -> str:
    return f"trim({c}, '{WHITESPACE}')"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{WHITESPACE}]+', ' ', 'g'), ' ')"


V1 = f"title <> '' AND title <> '{ERROR_TITLE}'"
V2 = f"{sql_strip('title')} <> '{ERROR_TITLE}'"


# -- stored and arriving ads: every third document is stored already -----------------------------

def stored(spark: SparkSession, folder: str) -> DataFrame:
    return ads(spark, folder).filter((F.col("pos") - 2) % 3 == 0)


def all_links(spark: SparkSession, folder: str) -> DataFrame:
    """All ads as links: one crawl per location, 200 positions to a listing page."""
    return ads(spark, folder).select(
        F.col("location").alias("crawl_id"),
        F.floor((F.col("pos") - 2) / 200 + 1).alias("page_num"),
        "pos",
        "id",
        "url",
        "title",
    )


def links(spark: SparkSession, folder: str) -> DataFrame:
    """The ads that are not stored yet as links."""
    return all_links(spark, folder).filter((F.col("pos") - 2) % 3 != 0)


# Crawls that end early: one whose fourth page repeats the third, one whose third page is empty.
STUCK, EMPTY = "src3", "src5"
COPIED = 1_000_000_000


def crawled(spark: SparkSession, folder: str) -> DataFrame:
    """The links as crawls with a stuck and an empty page and anchors without title."""
    base = links(spark, folder)
    stuck, empty = F.col("crawl_id") == STUCK, F.col("crawl_id") == EMPTY
    own = base.filter(~(stuck & (F.col("page_num") == 4)) & ~(empty & (F.col("page_num") == 3)))
    again = base.filter(stuck & (F.col("page_num") == 3)).withColumns(
        {"page_num": F.lit(4).cast("bigint"), "pos": F.col("pos") + COPIED}
    )
    nothing = base.filter(empty & (F.col("page_num") == 3)).groupBy("crawl_id", "page_num").agg(F.min("pos").alias("pos"))
    nothing = nothing.withColumns({c: F.lit(None).cast("string") for c in ("id", "url", "title")})
    every = own.unionByName(again).unionByName(nothing)
    return every.withColumn("title", F.when(F.col("pos") % 5 == 0, F.when(F.col("id").isNotNull(), "")).otherwise(F.col("title")))


def fetched(spark: SparkSession, folder: str) -> DataFrame:
    """The ad behind each url that could be fetched, with the title on its own page."""
    there = ads(spark, folder).filter(F.col("pos") % 11 != 0)
    return there.groupBy("url").agg(F.min_by("title", "pos").alias("title"))


def target(spark: SparkSession, folder: str) -> Column:
    """Six tenths of all ads, as the number to reach."""
    return ads(spark, folder).agg(F.floor(F.count("*") * 6 / 10)).scalar()


SPLIT = f"""{ADS},
stored AS (SELECT * FROM ads WHERE (pos - 2) % 3 = 0),
links AS (SELECT location AS crawl_id, (pos - 2) // 200 + 1 AS page_num, pos, id, url, title
    FROM ads WHERE (pos - 2) % 3 <> 0)"""

CRAWLED = f"""own AS (
    SELECT * FROM links WHERE NOT (crawl_id = '{STUCK}' AND page_num = 4) AND NOT (crawl_id = '{EMPTY}' AND page_num = 3)
    UNION ALL SELECT crawl_id, 4, pos + {COPIED}, id, url, title FROM links WHERE crawl_id = '{STUCK}' AND page_num = 3
    UNION ALL SELECT crawl_id, page_num, min(pos), NULL, NULL, NULL FROM links
        WHERE crawl_id = '{EMPTY}' AND page_num = 3 GROUP BY ALL),
crawled AS (SELECT * REPLACE (CASE WHEN id IS NOT NULL AND pos % 5 = 0 THEN '' ELSE title END AS title) FROM own),
crawl_pages AS (SELECT crawl_id, page_num, count(id) AS n, list(id ORDER BY pos) AS fp FROM crawled GROUP BY 1, 2),
crawl_marks AS (SELECT *, n > 0 AND coalesce(fp = lag(fp) OVER (PARTITION BY crawl_id ORDER BY page_num), false) AS stuck
    FROM crawl_pages),
fetched AS (SELECT url, arg_min(title, pos) AS title FROM ads WHERE pos % 11 <> 0 GROUP BY 1)"""


def sql_reached(stops: str, name: str = "reached") -> str:
    """The crawled links before the first page of their crawl that `stops`."""
    return f"""{name}_stop AS (SELECT crawl_id, min(page_num) AS stop FROM crawl_marks WHERE {stops} GROUP BY 1),
{name} AS (SELECT c.* FROM crawled c LEFT JOIN {name}_stop s ON s.crawl_id = c.crawl_id
    WHERE id IS NOT NULL AND (stop IS NULL OR page_num < stop))"""


# Identifiers as read off the stored URLs, and normalised titles of the stored ads.
STORED_IDS = f"""stored_ids AS (SELECT DISTINCT split_part(url, '/', -1) AS id FROM stored)"""
TITLE_KEY = f"lower({sql_strip('title')})"
STORED_TITLES = f"""stored_titles AS (SELECT DISTINCT {TITLE_KEY} AS title_key FROM stored WHERE {V1})"""


# -- crawl log: events as links of one crawl per user, two items to a page -----------------------

PAGE_SIZE = 2


def crawl_log(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "events").select(F.col("user_id").alias("crawl_id"), "event_id", "event_type")
    paged = rank_in_order(items, ["crawl_id"], "event_id", "rank").withColumn(
        "page_num", F.floor((F.col("rank") + (PAGE_SIZE - 1)) / PAGE_SIZE)
    )
    ids = F.sort_array(F.collect_list(F.when(F.col("event_type") != "error", F.struct("event_id", "event_type"))))
    log = paged.groupBy("crawl_id", "page_num").agg(
        F.count_if(F.col("event_type") != "error").alias("n_links"), fingerprint(ids.event_type).alias("fp")
    )
    return materialize(log, "crawl-log")


CRAWL_LOG = f"""items AS (
    SELECT user_id AS crawl_id, event_id, event_type,
        (row_number() OVER (PARTITION BY user_id ORDER BY event_id) + {PAGE_SIZE - 1}) // {PAGE_SIZE} AS page_num
    FROM events),
log AS (
    SELECT crawl_id, page_num, count(*) FILTER (event_type <> 'error') AS n_links,
        md5(coalesce('["' || string_agg(event_type, '","' ORDER BY event_id) FILTER (event_type <> 'error') || '"]', '[]')) AS fp
    FROM items GROUP BY 1, 2)"""


# -- batch log: orders as batches of one crawl per customer --------------------------------------

def batch_log(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("crawl_id"),
        "o_orderkey",
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("duration_cents"),
    )
    return rank_in_order(o, ["crawl_id"], "o_orderkey", "rn").select("crawl_id", "rn", "duration_cents")


BATCH_LOG = """batches AS (
    SELECT o_custkey AS crawl_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn,
        CAST(round(o_totalprice * 100) AS BIGINT) AS duration_cents
    FROM orders)"""


# -- salary texts: parts with a price tag in one of several wordings -----------------------------

def _wordings(low: str, high: str) -> list[str]:
    return [
        f"Pay £{low} - £{high} per hour plus tips",
        f"From £ {low}-{high}/week",
        f"Only £{low}/hr today",
        f"EARN £{low} - £{high} PER SHIFT",
        f"Up to £{low},000.50 per annum",
        f"£{low} – £{high} per day",
        f"£{low} an hour",
        "Competitive pay",
    ]


def _spelled(template: str) -> Column:
    low, high = F.col("p_size").cast("string"), (F.col("p_size") + 5).cast("string")
    return F.replace(F.replace(F.lit(template), F.lit("<L>"), low), F.lit("<H>"), high)


def salary_texts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("p_partkey") % 8
    text = F.coalesce(*[F.when(kind == i, _spelled(t)) for i, t in enumerate(_wordings("<L>", "<H>"))])
    name = F.concat(F.col("p_name"), F.lit(". "))
    return table(spark, folder, "part").select("p_partkey", F.concat(name, text).alias("description"))


def _sql_cases(templates: list[str], modulus: int) -> str:
    cases = []
    for i, t in enumerate(templates):
        spelled = "'" + t.replace("<L>", "' || p_size || '").replace("<H>", "' || (p_size + 5) || '") + "'"
        cases.append(f"WHEN {i} THEN {spelled}")
    return f"CASE p_partkey % {modulus} {' '.join(cases)} END"


SALARY_TEXTS = f"""texts AS (
    SELECT p_partkey, p_name || '. ' || {_sql_cases(_wordings("<L>", "<H>"), 8)} AS description FROM part)"""

RAW_SALARIES = [
    "£<L> per hour 07123456789 ask",
    "<L> per day. Call or text Sam. Now",
    "£<L>-<H> jobs@example.com",
    "Negotiable",
    "<L> /  HOUR ref 123456789",
    "call OR text 07000000000 about pay",
]


def raw_salaries(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("p_partkey") % len(RAW_SALARIES)
    text = F.coalesce(*[F.when(kind == i, _spelled(t)) for i, t in enumerate(RAW_SALARIES)])
    return table(spark, folder, "part").select("p_partkey", text.alias("raw"))


SQL_RAW_SALARIES = f"""raws AS (SELECT p_partkey, {_sql_cases(RAW_SALARIES, len(RAW_SALARIES))} AS raw FROM part)"""


# -- ad pages: parts as HTML in the two layouts ---------------------------------------------------

LIST_PAGE = (
    "<html><head><title>ad</title></head><body><nav><a href='/'>home</a></nav><h1> {name} </h1>"
    "{place}<dl><dt>{pay}</dt><dd>£{size} per  hour. Call or text 07123456789</dd>"
    "<dt>Contract Type</dt><dd><b>{kind}</b><dt>Working hours<dd>Part<br>time</dl>"
    "<div><span>Employer</span><span>{brand} &amp; Co</span></div>"
    "<h3>Description</h3><div><p>A {name}</p><div>by <i>{brand}</i></div></div><footer>x</footer></body></html>"
)
CARD_PAGE = (
    "<body><div><h1>{name}</h1><p> {brand} </p></div><div><p>Wynagrodzenie</p><p class='x css-bf1kxk'>{size} zł</p></div>"
    "<div><div><span>Lokalizacja</span></div><p>none</p></div><div><p>Wymiar pracy</p><p class=css-k31xxj>pełny</div>"
    "<div><p>Typ umowy</p><p class='css-k31xxj'>{kind}</p></div><div class='css-1i3492'>A {name}<div>by {brand}</div></div>"
)


LISTINGS = [
    "<div><h4>{brand}</h4><a data-q='search-result-anchor' href='/job/{key}?x=1'><span>go</span></a>"
    "<a data-q='search-result-anchor' href='more/{key}'><h3> {name} </h3></a></div><a href='/p/9'>no</a>",
    "<p><a href='/p/{key}/../{size}'><b class='my-title'>{name}</b></a><a href='/p/{key}'>bare</a></p><a href='/q/1'>no</a>",
    "<p>no ads</p><a href='/q/1'>no</a>",
]
CARD_LISTING = (
    "<a href='/oferta/praca/{key}.html?r=1'><div><h4>{name}</h4></div></a>"
    "<a href='https://x.example.org/oferta/praca/{size}'><h3>none</h3></a><a href='/other'><h4>no</h4></a>"
)


def listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("p_partkey") % len(LISTINGS)
    html = F.coalesce(*[F.when(kind == i, _filled(t)) for i, t in enumerate(LISTINGS)])
    return table(spark, folder, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))


def card_listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("page_id"), _filled(CARD_LISTING).alias("html"))


def _filled(template: str) -> Column:
    place = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<h4>Area "), F.col("p_size"), F.lit("</h4>"))).otherwise("")
    pay = F.when(F.col("p_partkey") % 3 == 0, "Salary range").otherwise("Pay")
    values = {
        "{name}": F.col("p_name"), "{brand}": F.col("p_brand"), "{kind}": F.col("p_type"),
        "{size}": F.col("p_size").cast("string"), "{place}": place, "{pay}": pay,
        "{key}": F.col("p_partkey").cast("string"),
    }
    page = F.lit(template)
    for mark, value in values.items():
        page = F.replace(page, F.lit(mark), value)
    return page


def ad_pages(spark: SparkSession, folder: str, template: str) -> DataFrame:
    url = F.concat(F.lit(HOST + "/job/"), F.col("p_partkey"), F.lit(".html"))
    return table(spark, folder, "part").select("p_partkey", url.alias("url"), _filled(template).alias("html"))


def linked_card_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages behind the first link of each card listing, and as many that no listing has."""
    number = F.when(F.col("p_size") <= 25, F.col("p_partkey")).otherwise(-F.col("p_partkey") - 1)
    url = F.concat(F.lit(HOST + "/oferta/praca/"), number, F.lit(".html?r=1"))
    return table(spark, folder, "part").select(url.alias("url"), _filled(CARD_PAGE).alias("html"))


# -- a whole run over parts: listing pages of crawls, the pages behind their links, some stored ads --

def part_listings(spark: SparkSession, folder: str) -> DataFrame:
    """The listing pages as crawls of five; every third page has no ads."""
    pages = listing_pages(spark, folder)
    number = F.col("page_id")
    return pages.select(
        "page_id", F.floor(number / 5).alias("crawl_id"), (F.pmod(number, F.lit(5)) + 1).alias("page_num"), "html"
    )


def part_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages behind links to parts; one in seven could not be fetched."""
    path = F.when(F.col("p_partkey") % 3 == 0, "/job/").otherwise("/p/")
    url = F.concat(F.lit(HOST), path, F.col("p_partkey"))
    there = table(spark, folder, "part").filter(F.col("p_partkey") % 7 != 0)
    return there.select(url.alias("url"), _filled(LIST_PAGE).alias("html"))


def part_ads(spark: SparkSession, folder: str) -> DataFrame:
    """Ads of every fourth part as stored ones."""
    url = F.concat(F.lit(HOST + "/job/"), F.col("p_partkey"))
    own = {"id": F.col("p_partkey").cast("string"), "url": url, "title": F.col("p_name")}
    rows = table(spark, folder, "part").filter(F.col("p_partkey") % 4 == 0)
    return rows.select(*[own.get(c, F.lit("")).alias(c) for c in ADS_COLUMNS])


PART_RUN = f"""listed AS (
    SELECT p_partkey, 0 AS ord, '{HOST}/job/' || p_partkey AS url, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 1, '{HOST}/more/' || p_partkey, CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 0, '{HOST}/p/' || p_size, CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT p_partkey, 1, '{HOST}/p/' || p_partkey, CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 3 = 1),
stops AS (SELECT p_partkey // 5 AS crawl_id, min(p_partkey) AS stop FROM part WHERE p_partkey % 3 = 2 GROUP BY 1),
found AS (SELECT l.* FROM listed l LEFT JOIN stops ON crawl_id = p_partkey // 5 WHERE stop IS NULL OR p_partkey < stop),
kept AS (SELECT CAST(p_partkey AS VARCHAR) AS id, '{HOST}/job/' || p_partkey AS url, p_name AS title FROM part
    WHERE p_partkey % 4 = 0),
new AS (SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey, ord) AS turn FROM found)
    WHERE turn = 1 AND id NOT IN (SELECT id FROM kept)),
there AS (SELECT '{HOST}' || CASE WHEN p_partkey % 3 = 0 THEN '/job/' ELSE '/p/' END || p_partkey AS url, p_name AS title
    FROM part WHERE p_partkey % 7 <> 0),
added AS (SELECT id, url, title FROM new JOIN there USING (url))"""


# -- titles with and without a category term ------------------------------------------------------

SUFFIXES = ["Shop Assistant", "night courier", "cleaners", "BAR STAFF wanted", "picker packer", "clerk", "Factory Operative"]


def titled_parts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("p_partkey") % len(SUFFIXES)
    suffix = F.coalesce(*[F.when(kind == i, F.lit(s)) for i, s in enumerate(SUFFIXES)])
    return table(spark, folder, "part").select("p_partkey", F.concat_ws(" ", "p_name", suffix).alias("title"))


TITLED_PARTS = f"""titled AS (SELECT p_partkey, p_name || ' ' || {_sql_cases(SUFFIXES, len(SUFFIXES))} AS title FROM part)"""
