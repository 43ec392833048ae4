"""Incremental ingest, running totals, crawl logs and batches against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from adloom.operators import batches, crawl, running
from adloom.operators import incremental as inc
from adloom.operators.shape import align, sample_head, stamp_rows, union_sources
from adloom.plans.ingest import ingest, ingest_by_id, ingest_by_title, load, page_log, reached, run_summary
from adloom.schema import ADS_COLUMNS

ERR = "403 ERROR"
LINKS = "crawl_id string, page_num bigint, pos bigint, id string, url string, title string"


def links_of(spark, pages):
    """Links from a list of pages, each a list of (id, title)."""
    data, pos = [], 0
    for n, page in enumerate(pages, 1):
        for ident, title in page or [(None, None)]:
            data.append(("c", n, pos, ident, f"https://h.example/{ident}", title))
            pos += 1
    return spark.createDataFrame(data, LINKS)


def positions(df):
    return sorted(r["pos"] for r in df.collect())


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_running_totals(spark, width):
    rnd = random.Random(width)
    data = [(g, p, rnd.randint(0, 9), rnd.choice("ab")) for g in "xy" for p in rnd.sample(range(50), 20)]
    df = spark.createDataFrame(data, "g string, p bigint, v bigint, s string").repartition(5)
    got = running.running_totals(df, ["g"], "p", {"t": F.col("v"), "n": F.lit(1)}, {"n": "all"}, width)
    seen = running.previous_value(df, ["g"], "p", "s", "before", width)
    before = {(r["g"], r["p"]): r["before"] for r in seen.collect()}
    for r in got.collect():
        own = sorted((x for x in data if x[0] == r["g"]), key=lambda x: x[1])
        upto = [x for x in own if x[1] <= r["p"]]
        assert (r["t"], r["n"], r["all"]) == (sum(x[2] for x in upto), len(upto), len(own))
        assert before[r["g"], r["p"]] == (upto[-2][3] if len(upto) > 1 else None)


def test_previous_value_may_be_null(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 2, None), ("g", 3, "b")], "g string, p bigint, s string")
    for width in (1, 2, 9):
        got = running.previous_value(df, ["g"], "p", "s", "before", width).orderBy("p").collect()
        assert [r["before"] for r in got] == [None, "a", None]


def random_links(spark, n=300, seed=3):
    rnd = random.Random(seed)
    data = [
        ("c", p // 7 + 1, p, rnd.choice(["hot", "hot", f"i{rnd.randint(0, 60)}", f"n{p}"]), f"u{p}", rnd.choice(["A ", "a", "", f"T{p}"]))
        for p in range(n)
    ]
    stored = [{"url": f" https://h.example/i{i}/ ", "title": f"T{i}"} for i in range(0, 60, 2)] + [
        {"url": "", "title": "no url"}, {"url": "https://h.example/hot", "title": ERR},
    ]
    return data, spark.createDataFrame(data, LINKS).repartition(4), stored


def scan(data, key, stored):
    """Accepted positions by going through the links one by one."""
    seen, new = set(stored), []
    for row in sorted(data, key=lambda r: r[2]):
        if key(row) not in seen:
            seen.add(key(row))
            new.append(row[2])
    return new


def test_new_skipped_and_first_seen_by_id(spark, make_ads):
    data, links, stored = random_links(spark)
    ads = make_ads(stored)
    ids = inc.stored_ids(ads)
    known = {s["url"].strip().rstrip("/").split("/")[-1] for s in stored if s["url"].strip()}
    assert {r["id"] for r in ids.collect()} == known
    new = scan(data, lambda r: r[3], known)
    assert positions(inc.accepted(links, ids, "id")) == new
    skipped = inc.skipped(links, ids, "id")
    assert positions(skipped) == sorted({r[2] for r in data} - set(new))
    assert positions(inc.not_stored(links, ids, "id")) == [r[2] for r in data if r[3] not in known]
    assert positions(inc.first_seen(links, "id")) == scan(data, lambda r: r[3], ())
    stats = {r["page_num"]: (r["found"], r["new"], r["skipped"]) for r in inc.page_stats(links, ids, "id", ["page_num"]).collect()}
    for page in {r[1] for r in data}:
        own = [r[2] for r in data if r[1] == page]
        assert stats[page] == (len(own), len(set(own) & set(new)), len(set(own) - set(new)))
    shown = inc.skipped_preview(skipped, ["page_num"]).collect()
    for page in {r[1] for r in data}:
        out = sorted({r[2] for r in data if r[1] == page} - set(new))
        assert sorted(r["pos"] for r in shown if r["page_num"] == page) == out[:3]
        assert all(r["more"] == max(len(out) - 3, 0) for r in shown if r["page_num"] == page)


def test_new_by_title(spark, make_ads):
    data, links, stored = random_links(spark)
    known = {s["title"].strip().lower() for s in stored if s["title"] and s["title"] != ERR}
    got = inc.accepted(inc.with_title_key(links), inc.stored_titles(make_ads(stored)), "title_key")
    assert positions(got) == scan(data, lambda r: r[5].strip().lower(), known)


def test_titles_missing_unread_and_blank(spark, make_ads):
    rows = [(1, None, None), (2, None, "timeout"), (3, None, "timeout"), (4, "", None), (5, " ", None)]
    links = spark.createDataFrame(rows, "pos bigint, title string, _error string")
    keyed = inc.with_title_key(links)
    assert positions(inc.accepted(keyed, inc.stored_titles(make_ads([{"title": ""}])), "title_key")) == [2, 3, 4]
    assert positions(inc.accepted(keyed, inc.stored_titles(make_ads([{"title": "  "}])), "title_key")) == [2, 3]


@pytest.mark.parametrize("width", [2, 7, 1000])
def test_budgets(spark, width):
    rows = [("ab"[p % 3 == 0], p * 3, p % 4) for p in range(40)]
    df = spark.createDataFrame(rows, "g string, pos bigint, n bigint")
    assert positions(inc.budget_cut(df, 11, width=width)) == [r[1] for r in rows][:11]
    assert inc.budget_cut(df, 0, width=width).count() == 0 and inc.budget_cut(df, 99, width=width).count() == 40
    each = inc.budget_cut(df, 5, by=["g"], width=width)
    assert positions(each) == sorted(sum(([r[1] for r in rows if r[0] == g][:5] for g in "ab"), []))
    kept, done = [], 0
    for _, p, n in rows:
        if done < 10:
            kept.append(p)
        done += n
    assert positions(inc.budget_cut_pages(df, 10, page="pos", width=width)) == kept


def test_remaining_counts_stored_ads(spark, make_ads):
    stored = make_ads([{"title": "x"}, {"title": ERR}, {"title": ""}])
    assert spark.range(1).select(inc.remaining(1321, stored)).first()[0] == 1320


def test_crawl_stops_at_empty_stuck_and_cap(spark):
    log = [
        ("empty", 1, 2, "a"), ("empty", 2, 0, ""), ("empty", 3, 2, "b"),
        ("stuck", 1, 2, "a"), ("stuck", 2, 2, "b"), ("stuck", 3, 2, "b"), ("stuck", 4, 1, "c"),
        ("alike", 1, 2, "a"), ("alike", 2, 2, "b"), ("alike", 3, 2, "a"),
        ("none", 1, 0, ""), ("long", 1, 1, "x"), *[("long", p, 1, f"p{p}") for p in range(2, 41)],
    ]
    df = spark.createDataFrame(log, "crawl_id string, page_num bigint, n_links bigint, fp string")
    for width in (1, 4, 1000):
        reached = crawl.crawl_prefix(df, width=width)
        pages = {}
        for r in reached.collect():
            pages.setdefault(r["crawl_id"], []).append(r["page_num"])
        assert {c: sorted(p) for c, p in pages.items()} == {
            "empty": [1], "stuck": [1, 2], "alike": [1, 2, 3], "long": list(range(1, 41)),
        }
        capped = crawl.crawl_prefix(df, cap=25, width=width).filter("crawl_id = 'long'")
        assert capped.count() == 25
        progress = crawl.crawl_progress(reached, width=width).filter("crawl_id = 'stuck'").orderBy("page_num")
        assert [r["found_so_far"] for r in progress.collect()] == [2, 4]
    estimate = {r["crawl_id"]: (r["pages"], r["estimated"]) for r in crawl.page_estimate(df).collect()}
    assert estimate["stuck"] == (4, 2 * 3 + 1) and estimate["none"] == (0, 0)


def fetched_of(spark, pages):
    """The ads behind the links of a list of pages, titled as there; "-" stands for one without a title of its own."""
    rows = {i: "" if t == "-" else t or "own title" for page in pages for i, t in page if t != "failed"}
    return spark.createDataFrame([(f"https://h.example/{i}", t) for i, t in rows.items()], "url string, title string")


def test_page_log_and_ingest_by_id(spark, make_ads):
    pages = [
        [(f"a{i}", f"A{i}") for i in range(12)],
        [("a0", "A0"), ("s", "S"), ("b1", ""), ("b2", ERR), ("b3", "B3"), ("b4", "failed"), ("b5", "-")],
        [(f"c{i}", f"C{i}") for i in range(10)] + [("d", "D")],
        [(f"c{i}", f"C{i}") for i in range(10)] + [("e", "E")],
        [(f"c{i}", f"C{i}") for i in range(10)] + [("e", "E")],
        [("f", "F")],
    ]
    links, fetched = links_of(spark, pages), fetched_of(spark, pages)
    log = {r["page_num"]: (r["n_links"], r["fp"]) for r in page_log(links).collect()}
    assert log[1][0] == 12 and log[3][1] != log[4][1] == log[5][1]
    stored = make_ads([{"url": "https://h.example/s", "title": "S"}, {"url": "https://h.example/t", "title": ERR}])
    got = ingest_by_id(links, fetched, stored, 99).orderBy("pos").collect()
    want = [f"a{i}" for i in range(12)] + ["b1", "b2", "b3"] + [f"c{i}" for i in range(10)] + ["d", "e"]
    assert [r["url"].split("/")[-1] for r in got] == want
    assert ingest_by_id(links, fetched, stored).count() == len(want)
    assert ingest_by_id(links, fetched, stored, 5).count() == 4
    new = inc.accepted(reached(links), inc.stored_ids(stored), "id").count()
    assert tuple(run_summary(links, stored).first()) == (41, 1, new, 1 + new)
    assert ingest_by_id(links, fetched, stored, 1).count() == 0


def test_pages_alike_in_ten_ids_or_joined_text_only_are_not_stuck(spark):
    ten = [(f"c{i}", "") for i in range(10)]
    links = links_of(spark, [[*ten, ("x", "")], [*ten, ("y", "")], [("a,b", "")], [("a", ""), ("b", "")], [("a", ""), ("b", "")]])
    assert {r["page_num"] for r in reached(links).collect()} == {1, 2, 3, 4}
    two, one = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"))
    assert spark.range(1).select(crawl.fingerprint(two, 1) == crawl.fingerprint(one)).first()[0]


def test_a_whole_run(spark, make_ads):
    page = "<div><a data-q='search-result-anchor' href='/job/{0}'>{1}</a></div>"
    rows = [
        (0, "c", 1, page.format(1, "<h3>One</h3>") + page.format(2, "")),
        (1, "c", 2, page.format(1, "") + page.format(3, "<h3>Three</h3>")),
        (2, "c", 3, "<p>none</p>"),
        (3, "c", 4, page.format(9, "")),
        (4, "d", 1, page.format(4, "") + page.format(5, "")),
    ]
    listings = spark.createDataFrame(rows, "page_id long, crawl_id string, page_num long, html string")
    pages = [(f"https://h.example/job/{k}", f"<h1>Ad {k}</h1>") for k in (1, 2, 4, 9)] + [("https://h.example/job/5", "<p>no title</p>")]
    stored = make_ads([{"id": "4", "url": "https://h.example/job/4", "title": "Old"}]).drop("pos")
    fetched = spark.createDataFrame(pages, "url string, html string")
    after, totals = ingest(listings, fetched, stored, "https://h.example")
    assert sorted((r["id"], r["title"]) for r in after.collect()) == [("1", "Ad 1"), ("2", "Ad 2"), ("4", "Old")]
    assert tuple(totals.first()) == (6, 1, 2, 3)
    after, totals = ingest(listings, fetched, stored, "https://h.example", target=2)
    assert sorted(r["id"] for r in after.collect()) == ["1", "4"] and totals.first()["total_after"] == 2


def test_rows_without_a_place_in_the_order_are_refused(spark):
    for row in [(None, 1, 1), ("g", None, 1)]:
        df = spark.createDataFrame([("g", 2, 1), row], "g string, p bigint, v bigint")
        with pytest.raises(Exception, match="no place in the order"):
            running.running_totals(df, ["g"], "p", {"t": F.col("v")}).collect()
    df = spark.createDataFrame([("g", 1, None), ("g", 2, 3)], "g string, p bigint, v bigint")
    assert [r["t"] for r in running.running_totals(df, ["g"], "p", {"t": F.col("v")}).orderBy("p").collect()] == [0, 3]


def test_ingest_by_title_takes_whole_pages(spark, make_ads):
    pages = [[("1", "A"), ("2", " a "), ("3", "B")], [("4", "S"), ("5", "C")], [("6", "D")], [], [("7", "E")]]
    links = links_of(spark, pages)
    stored = make_ads([{"title": " s"}])
    def idents(df):
        return sorted(r["id"] for r in df.collect())
    assert idents(ingest_by_title(links, stored)) == ["1", "3", "5", "6"]
    assert idents(ingest_by_title(links, stored, target=3)) == ["1", "3", "5"]
    assert idents(ingest_by_title(links, stored, target=2)) == ["1", "3"]
    assert idents(ingest_by_title(links, stored, cap=2)) == ["1", "3", "5"]


def test_load_parses_accepted_pages_only(spark):
    pages = spark.createDataFrame(
        [("https://h.example/1", "<h1>one</h1>"), ("https://h.example/2", "<h1>two</h1>"), ("https://h.example/3", "<p>no")],
        "url string, html string",
    )
    new = spark.createDataFrame([("https://h.example/1",), ("https://h.example/3",)], "url string")
    assert [(r["id"], r["title"]) for r in load(new, pages).collect()] == [("1", "one")]
    assert load(new, pages, "card").count() == 2
    failed = spark.createDataFrame([("https://h.example/1", "<h1> 403 ERROR </h1>")], "url string, html string")
    assert load(new, failed).count() == 1 and load(new, failed, drop_errors=True).count() == 0


def test_batches(spark):
    log = [("c", i, d) for i, d in enumerate([1000, 2000, 1500, 333, 50, 10, 70], 1)]
    df = spark.createDataFrame(log, "crawl_id string, rn bigint, duration_cents bigint")
    for width in (2, 1000):
        got = batches.batch_assign(df, 3).orderBy("rn").collect()
        assert [(r["batch_no"], r["n_batches"]) for r in got] == [(i // 3 + 1, 3) for i in range(7)]
        start = F.lit("2024-05-01 23:59:50").cast("timestamp")
        eta = batches.batch_eta(df, start, width).orderBy("rn").collect()
        times = []
        for i, r in enumerate(eta):
            times.append(log[i][2] / 100)
            average, left = sum(c for _, _, c in log[: i + 1]) / 100 / (i + 1), 7 - i - 1
            assert r["avg_batch_time"] == average
            assert r["eta_seconds"] == (left * average + left * 5 if left else None)
            assert r["elapsed"] == pytest.approx(sum(times) + 10 * i)
        assert eta[0]["eta_time"] == "00:01:30" and eta[0]["remaining_text"] == "1.5 min" and eta[6]["eta_time"] is None
    total = batches.batch_summary(df).first()
    assert (total["batches"], total["total_text"]) == (7, "109.6s (1.8 min)")


def test_common_format(spark, make_ads):
    other = spark.createDataFrame([("7", None, "x")], "ref string, title string, more string")
    row = align(other, {"ref": "id"}).first().asDict()
    assert list(row) == ADS_COLUMNS and row == {**dict.fromkeys(ADS_COLUMNS, ""), "id": "7"}
    ads = make_ads([{"id": "1"}, {"id": "2"}, {"id": "3"}, {"id": "4"}])
    both = union_sources({"a": ads, "b": other}, {"b": {"ref": "id"}})
    assert both.groupBy("source").count().orderBy("source").collect() == [("a", 4), ("b", 1)]
    assert [r["id"] for r in sample_head(ads).collect()] == ["1", "2", "3"]
    assert stamp_rows(ads, F.lit("2024-01-02 03:04:05").cast("timestamp")).first()["scraped_at"] == "2024-01-02 03:04:05"


def test_a_run_to_a_target_a_cap_and_by_first_ids(spark, make_ads):
    """Links are numbered with gaps of a million between pages; the target counts ads that could be fetched."""
    html = "".join(f"<a data-q='search-result-anchor' href='/job/{{}}{k}'><h3>t</h3></a>" for k in range(3))
    tail = "<a data-q='search-result-anchor' href='/job/{}'><h3>t</h3></a>"
    listings = [(10, "c", 1, html.replace("{}", "a")), (20, "c", 2, html.replace("{}", "b")),
                (30, "c", 3, html.replace("{}", "b") + tail.format("z")), (40, "c", 4, html.replace("{}", "d"))]
    listings = spark.createDataFrame(listings, "page_id long, crawl_id string, page_num long, html string")
    urls = [f"https://h.example/job/{p}{k}" for p in "abd" for k in range(3)] + ["https://h.example/job/z"]
    pages = spark.createDataFrame([(u, f"<h1>{u[-2:]}</h1>") for u in urls if u[-2:] != "a1"], "url string, html string")
    stored = make_ads([{"id": "old", "url": "https://h.example/job/old", "title": "old"}])

    def added(**options):
        after, totals = ingest(listings, pages, stored, "https://h.example", **options)
        return sorted(r["id"] for r in after.select("id").collect()), totals.first()

    assert added()[0] == sorted(["old", "a0", "a2", "b0", "b1", "b2", "z", "d0", "d1", "d2"])
    ids, totals = added(target=5)
    assert ids == sorted(["old", "a0", "a2", "b0", "b1"]) and (totals["new"], totals["total_after"]) == (4, 5)
    assert added(cap=1)[0] == sorted(["old", "a0", "a2"])
    assert added(compared=3)[0] == sorted(["old", "a0", "a2", "b0", "b1", "b2"])
    assert added(target=1)[0] == ["old"]
