"""Column expressions against plain Python."""


import pytest
from pyspark.sql import functions as F

from adloom.functions import salary, text, urls
from adloom.functions.categories import category_of
from adloom.functions.markup import hrefs_of, title_of

HOST = "https://ads.example.com"


def evaluate(spark, function, values):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("x"))).collect()]


TEXTS = ["", "  a  b\t\nc ", " x y　", "\x1c z\x85", "plain", "a​b", "é  É "]


def test_strip_and_collapse_follow_unicode(spark):
    assert evaluate(spark, text.strip, TEXTS) == [t.strip() for t in TEXTS]
    assert evaluate(spark, text.collapse, TEXTS) == [" ".join(t.split()) for t in TEXTS]
    assert evaluate(spark, text.normalized, TEXTS) == [t.strip().lower() for t in TEXTS]


def test_display_forms(spark):
    assert evaluate(spark, lambda c: text.shorten(c, 3), ["abc", "abcd"]) == ["abc", "abc..."]
    assert evaluate(spark, lambda c: text.headline(c, 3), ["ab", "abcd"]) == ["ab...", "abc..."]
    assert evaluate(spark, lambda c: text.first_filled(F.lit(None), F.lit(""), c), ["", "v"]) == ["", "v"]
    numbers = [0.05, 0.15, 0.25, 0.35, 12.25, 1234567.75, 2.675]
    one = evaluate(spark, lambda c: text.one_decimal(c.cast("double"), "s"), [repr(n) for n in numbers])
    assert one == [f"{n:.1f}s" for n in numbers]


URLS = [
    "https://h.example/a/b/123", "https://h.example/a/123/", "https://h.example/x.html", "x.html?y=1", "///", "",
    "https://h.example/a.html/b.html", "https://h.example/jobs/page12", "https://h.example/jobs/page12//",
    "https://h.example/p?q=1/page2",
]


def test_ids_and_bases(spark):
    assert evaluate(spark, urls.id_from_url, URLS) == [
        "123",
        "123",
        "x.html",
        "x.html?y=1",
        "",
        "",
        "b.html",
        "page12",
        "page12",
        "page2",
    ]
    assert evaluate(spark, urls.id_from_html_url, URLS) == [
        "123",
        "",
        "x",
        "x?y=1",
        "",
        "",
        "b",
        "page12",
        "",
        "page2",
    ]
    assert evaluate(spark, urls.normalize_base_url, URLS) == [
        "https://h.example/a/b/123",
        "https://h.example/a/123",
        "https://h.example/x.html",
        "x.html?y=1",
        "",
        "",
        "https://h.example/a.html/b.html",
        "https://h.example/jobs",
        "https://h.example/jobs",
        "https://h.example/p?q=1",
    ]


HREFS = [
    "/p/1?x=2", "rel/2", "/a/../b", "/a/./b/", "../up", "/..", "/a/b/..", "https://o.example/z/../q?r", "//cdn.example/x",
    "", "#top", "?only=query", "/a#frag", "a//b", "mailto:x@y", "/.hidden/x", "/a/.../b",
]


def test_canonical_and_absolute_urls(spark):
    assert evaluate(spark, lambda c: urls.canonical_url(c, HOST), HREFS) == [
        "https://ads.example.com/p/1",
        "https://ads.example.com/rel/2",
        "https://ads.example.com/b",
        "https://ads.example.com/a/b/",
        "https://ads.example.com/up",
        "https://ads.example.com/",
        "https://ads.example.com/a/",
        "https://o.example/z/../q",
        "https://cdn.example/x",
        "https://ads.example.com",
        "https://ads.example.com#top",
        "https://ads.example.com",
        "https://ads.example.com/a#frag",
        "https://ads.example.com/a/b",
        "mailto:x@y",
        "https://ads.example.com/.hidden/x",
        "https://ads.example.com/a/.../b",
    ]
    assert evaluate(spark, lambda c: urls.absolute_url(c, HOST), HREFS) == [
        "https://ads.example.com/p/1?x=2",
        "rel/2",
        "https://ads.example.com/a/../b",
        "https://ads.example.com/a/./b/",
        "../up",
        "https://ads.example.com/..",
        "https://ads.example.com/a/b/..",
        "https://o.example/z/../q?r",
        "https://ads.example.com//cdn.example/x",
        "",
        "#top",
        "?only=query",
        "https://ads.example.com/a#frag",
        "a//b",
        "mailto:x@y",
        "https://ads.example.com/.hidden/x",
        "https://ads.example.com/a/.../b",
    ]


QUERIES = [
    "https://h.example/jobs", "https://h.example/jobs?a=1&page=9&b=2", "https://h.example/jobs?a=&b=x%20y&a=2&c=3&b=%C3%A9#f",
    "https://h.example/?a=1+2&a=*~-_.&k%25=v%2F", "https://h.example/j?x=%zz&flag", "HTTPS://h.example/j?q=a=b",
]


def test_set_query_param_keeps_the_others(spark):
    assert evaluate(spark, lambda c: urls.set_query_param(c, "page", F.lit(3)), QUERIES) == [
        "https://h.example/jobs?page=3",
        "https://h.example/jobs?a=1&page=3&b=2",
        "https://h.example/jobs?b=x+y&b=%C3%A9&a=2&c=3&page=3#f",
        "https://h.example/?a=1+2&a=%2A~-_.&k%25=v%2F&page=3",
        "https://h.example/j?x=%25zz&page=3",
        "https://h.example/j?q=a%3Db&page=3",
    ]


def test_page_goes_into_the_path(spark):
    got = evaluate(spark, lambda c: urls.page_path(c, F.lit(4)), ["https://h.example/a", "https://h.example/a?q=1"])
    assert got == ["https://h.example/a/page4", "https://h.example/a/page4?q=1"]
    assert evaluate(spark, lambda c: urls.page_path(c, F.lit(1)), ["u"]) == ["u"]


SALARIES = {
    "£10 - £12 per hour": "£10 - £12 per hour",
    "pay £ 10-12/hr now": "£10 - £12 per hr",
    "£1,200.50 per month": "£1,200.50 per month",
    "EARN £50 - £120 PER SHIFT": "£50 - £120 per SHIFT",
    "£50-£120 per day": "£50 - £120 per day",
    "£10 – £25 per hour": "£25 per hour",
    "£9 per hours": "£9 per hour",
    "£5 per day or £10 - £12 per hour": "£10 - £12 per hour",
    "£10 an hour": "",
    "12 per hour": "",
    "£ 10 - £12 per week": "£10 - £12 per week",
    "": "",
}


def test_salary_in_text(spark):
    assert evaluate(spark, salary.salary_in, list(SALARIES)) == list(SALARIES.values())


def test_later_salary_rules_never_fire(spark):
    """Earn-ranges and day or shift ranges are all found by the first rule already."""
    texts = ["EARN £5 - £6 PER DAY", "earn £5-£6 per shift", "£5 - £6 / day", "£ 1,000 - £ 2,000 per shift"]
    assert all(x for x in evaluate(spark, lambda c: F.regexp_extract(c, salary.RANGE, 0), texts))


def test_salary_clean(spark):
    cases = {
        "£10 per  hour 07123456789": "£10 per hour",
        "CALL or text Ann. £5 an hour": ". £5 an hour",
        "12 per day a@b.example": "12 per day",
        "ask a@b.example": "",
        "call or text £10 per hour": "",
        "12\nper hour": "",
        "0712345678 and 12345": "",
        "ref 012345678 per hour": "ref 012345678 per hour",
        " 07123456789 £8": "£8",
    }
    assert evaluate(spark, salary.salary_clean, list(cases)) == list(cases.values())


def test_implausible_salary_is_cleared_and_then_looked_up(spark):
    df = spark.createDataFrame([("Negotiable", "earn £7 per hour"), ("£8/hr", "£7 per hour")], "s string, d string")
    df = df.withColumn("s", salary.salary_clean(F.col("s")))
    got = df.select(salary.salary_or_extracted(F.col("s"), F.col("d"))).collect()
    assert [r[0] for r in got] == ["£7 per hour", "£8/hr"]


def test_categories_in_rule_order(spark):
    titles = ["Cashier and courier", "NIGHT COURIER", "cleaners", "cleaner", "developer", "Bar  staff"]
    assert evaluate(spark, category_of, titles) == ["retail", "delivery", None, "cleaning", None, None]


def test_raw_html(spark):
    pages = ["<h1 class=x> A <b>b</b>\n &amp;c &pound5</h1><h1>z</h1>", "<p>none</p>", "<H1>up</H1>"]
    assert evaluate(spark, title_of, pages) == ["A b &c £5", "", "up"]
    anchors = """<a id="q" href="/a?x=1&amp;y=2">1</a><area href="/no"><A HREF = '/b"c'><a href=/d>4<a href="">5"""
    assert evaluate(spark, hrefs_of, [anchors, "<p>"]) == [["/a?x=1&y=2", '/b"c', "/d"], []]


@pytest.mark.parametrize("seconds, shown", [(0, "0.0s"), (90.04, "90.0s")])
def test_one_decimal(spark, seconds, shown):
    assert spark.range(1).select(text.one_decimal(F.lit(float(seconds)), "s")).first()[0] == shown
