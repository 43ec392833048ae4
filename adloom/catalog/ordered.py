"""Ranks, totals and budgets in any order, and runs to a target, a page cap or by the first identifiers of a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.catalog import bindings as b
from adloom.operators import crawl, ordering
from adloom.plans.ingest import ingest, reached
from adloom.session import materialize

CAP, COMPARED, RECENT = 5, 10, 3


def _events(s, f):
    return b.table(s, f, "events").select("event_id", "ts", "user_id", "event_type")


def _first_third(s, f):
    events = _events(s, f)
    budget = events.agg(F.floor(F.count("*") / 3)).scalar()
    return ordering.first_rows(events, budget, ["ts", "event_id"], range_rows=2000).select("event_id", "ts")


def _progress(s, f):
    is_link = (F.col("event_type") != "error").cast("bigint")
    rows = ordering.running_totals(
        _events(s, f), ["ts", "event_id"], {"found_so_far": is_link, "seen_so_far": F.lit(1).cast("bigint")}, range_rows=2000
    )
    return rows.select("event_id", "found_so_far", "seen_so_far")


def _ranked(s, f):
    order = [F.col("user_id").desc(), F.col("ts").desc(), F.col("event_id")]
    rows = ordering.rank(_events(s, f), order, "rank", by=["event_type"], count="total", range_rows=2000)
    return rows.select("event_type", "event_id", "rank", "total")


def _run_to_target(s, f):
    stored = b.part_ads(s, f)
    target = b.table(s, f, "part").agg(F.floor(F.count("*") * 3 / 10)).scalar()
    after, _ = ingest(b.part_listings(s, f), b.part_pages(s, f), stored, b.HOST, target=target)
    return after.select("id", "url", "title")


QUERIES = {
    "budget_cut_by_time": _first_third,
    "budget_cut_by_user_time": lambda s, f: ordering.first_rows(
        _events(s, f), RECENT, [F.col("ts").desc(), F.col("event_id")], by=["user_id"], range_rows=2000
    ).select("user_id", "event_id", "ts"),
    "progress_by_time": _progress,
    "rank_by_type": _ranked,
    "ingest_run_target": _run_to_target,
    "crawl_prefix_capped": lambda s, f: crawl.crawl_prefix(b.crawl_log(s, f), cap=CAP).select("crawl_id", "page_num", "n_links"),
    "reached_by_first_ids": lambda s, f: reached(
        materialize(b.crawled(s, f), "links"), compared=COMPARED
    ).select("crawl_id", "page_num", "pos", "id"),
}

ORACLE = {
    "budget_cut_by_time": """SELECT event_id, ts FROM events
        QUALIFY row_number() OVER (ORDER BY ts, event_id) <= (SELECT count(*) // 3 FROM events)""",
    "budget_cut_by_user_time": f"""SELECT user_id, event_id, ts FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= {RECENT}""",
    "progress_by_time": """SELECT event_id,
            CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS BIGINT) AS found_so_far,
            row_number() OVER (ORDER BY ts, event_id) AS seen_so_far
        FROM events""",
    "rank_by_type": """SELECT event_type, event_id,
            row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC, ts DESC, event_id) AS rank,
            count(*) OVER (PARTITION BY event_type) AS total
        FROM events""",
    "ingest_run_target": f"""WITH {b.PART_RUN},
        placed AS (SELECT n.*, row_number() OVER (ORDER BY p_partkey, ord) AS k
            FROM (SELECT id, url, p_partkey, ord FROM found
                QUALIFY row_number() OVER (PARTITION BY id ORDER BY p_partkey, ord) = 1) n
            JOIN there USING (url) WHERE id NOT IN (SELECT id FROM kept))
        SELECT id, url, title FROM kept
        UNION ALL SELECT id, url, title FROM placed JOIN there USING (url)
            WHERE k <= (SELECT count(*) * 3 // 10 FROM part) - (SELECT count(*) FROM kept)""",
    "crawl_prefix_capped": f"""WITH {b.CRAWL_LOG},
        marked AS (SELECT *, coalesce(fp = lag(fp) OVER (PARTITION BY crawl_id ORDER BY page_num), false) AS stuck FROM log)
        SELECT crawl_id, page_num, n_links FROM marked m WHERE page_num <= {CAP} AND NOT EXISTS (
            SELECT 1 FROM marked x WHERE x.crawl_id = m.crawl_id AND x.page_num <= m.page_num AND (x.n_links = 0 OR x.stuck))""",
    "reached_by_first_ids": f"""WITH {b.SPLIT}, {b.CRAWLED},
        firsts AS (SELECT * REPLACE (n > 0 AND coalesce(fp[1:{COMPARED}] = lag(fp[1:{COMPARED}])
            OVER (PARTITION BY crawl_id ORDER BY page_num), false) AS stuck) FROM crawl_marks),
        stops AS (SELECT crawl_id, min(page_num) AS stop FROM firsts WHERE n = 0 OR stuck GROUP BY 1)
        SELECT crawl_id, page_num, pos, id FROM crawled LEFT JOIN stops USING (crawl_id)
        WHERE id IS NOT NULL AND (stop IS NULL OR page_num < stop)""",
}
