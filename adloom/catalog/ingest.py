"""Incremental ingest, crawl logs and batch logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.catalog import bindings as b
from adloom.functions.urls import id_from_html_url
from adloom.operators import batches, crawl
from adloom.operators import incremental as inc
from adloom.operators import shape
from adloom.plans.ingest import ingest, ingest_by_id, ingest_by_title, run_summary
from adloom.session import materialize, staging_path
from adloom.sources.ads import append_parquet


def _stored_ids(s, f):
    return inc.stored_ids(b.stored(s, f), id_from_html_url)


def _by_id(links, s, f):
    return inc.accepted(links, _stored_ids(s, f), "id")


def _candidates(s, f):
    return materialize(_by_id(b.links(s, f), s, f), "candidates")


def _appended(s, f):
    path = staging_path(s, "append")
    shape.align(b.stored(s, f)).write.parquet(path)
    ads = b.ads(s, f)
    fresh = _by_id(b.links(s, f), s, f).select("pos")
    append_parquet(shape.align(ads.join(fresh, "pos", "left_semi")), path)
    return s.read.parquet(path)


def _distinct(s, f):
    titles = inc.stored_titles(b.ads(s, f)).select(F.col("title_key").alias("key"))
    ids = inc.stored_ids(b.ads(s, f), id_from_html_url)
    return inc.distinct_keys(titles, ids.select(F.col("id").alias("key")))


def _skipped(s, f):
    return inc.skipped(b.links(s, f), _stored_ids(s, f), "id")


def _pages(s, f):
    return crawl.crawl_prefix(b.crawl_log(s, f))


def _crawled(s, f):
    return materialize(b.crawled(s, f), "links")


def _run(s, f):
    return ingest(b.part_listings(s, f), b.part_pages(s, f), b.part_ads(s, f), b.HOST)


def _new_sizes(s, f):
    return _candidates(s, f).groupBy("crawl_id", "page_num").agg(F.count("*").alias("n"))


QUERIES = {
    "distinct_keys": _distinct,
    "new_by_id": lambda s, f: inc.not_stored(b.links(s, f), _stored_ids(s, f), "id").select("pos", "id", "title"),
    "new_by_title": lambda s, f: inc.accepted(
        inc.with_title_key(b.links(s, f)), inc.stored_titles(b.stored(s, f)), "title_key"
    ).select("pos", "url", "title_key"),
    "first_seen": lambda s, f: inc.first_seen(b.all_links(s, f), "id").select("id", "pos", "title"),
    "skipped_dups": lambda s, f: _skipped(s, f).select("pos", "id"),
    "skipped_preview": lambda s, f: inc.skipped_preview(_skipped(s, f), ["crawl_id", "page_num"]),
    "page_stats": lambda s, f: inc.page_stats(
        b.links(s, f), _stored_ids(s, f), "id", ("crawl_id", "page_num")
    ),
    "crawl_summary": lambda s, f: run_summary(_crawled(s, f), b.stored(s, f), ident=id_from_html_url),
    "incremental_by_id": lambda s, f: ingest_by_id(
        _crawled(s, f), b.fetched(s, f), b.stored(s, f), b.target(s, f), ident=id_from_html_url
    ).select("pos", "url", "title"),
    "incremental_by_title": lambda s, f: ingest_by_title(_crawled(s, f), b.stored(s, f), target=20).select(
        "pos", "url", "title"
    ),
    "ingest_run": lambda s, f: _run(s, f)[0].select("id", "url", "title"),
    "ingest_run_totals": lambda s, f: _run(s, f)[1],
    "incremental_append": _appended,
    "budget_cut": lambda s, f: inc.budget_cut(
        _candidates(s, f), inc.remaining(b.target(s, f), b.stored(s, f)), width=1000
    ).select("pos", "id"),
    "budget_cut_by_source": lambda s, f: inc.budget_cut(
        _candidates(s, f), 15, by=["crawl_id"], width=1000
    ).select("crawl_id", "pos", "id"),
    "budget_cut_pages": lambda s, f: inc.budget_cut_pages(_new_sizes(s, f), 15, by=["crawl_id"], page="page_num", width=4),
    "page_fingerprint": lambda s, f: crawl.stuck_pages(b.crawl_log(s, f), width=16),
    "crawl_prefix": _pages,
    "crawl_progress": lambda s, f: crawl.crawl_progress(_pages(s, f)).select("crawl_id", "page_num", "found_so_far"),
    "page_estimate": lambda s, f: crawl.page_estimate(b.crawl_log(s, f)),
    "batch_assign": lambda s, f: batches.batch_assign(b.batch_log(s, f)).select(
        "crawl_id", "rn", "batch_no", "n_batches"
    ),
    "batch_eta": lambda s, f: batches.batch_eta(b.batch_log(s, f), F.lit(b.RUN_TIME).cast("timestamp")).drop("n_batches"),
    "batch_summary": lambda s, f: batches.batch_summary(b.batch_log(s, f)),
}

_WITH = f"""WITH {b.SPLIT}, {b.STORED_TITLES},
stored_ids AS (SELECT DISTINCT replace(split_part(url, '/', -1), '.html', '') AS id FROM stored),
accepted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS turn FROM links)
    WHERE turn = 1 AND id NOT IN (SELECT id FROM stored_ids)),
skipped AS (SELECT * FROM links WHERE pos NOT IN (SELECT pos FROM accepted)),
budget AS (SELECT (SELECT CAST(floor(count(*) * 6 / 10) AS BIGINT) FROM ads)
    - (SELECT count(*) FROM stored WHERE {b.V1}) AS n)"""

_TITLES = f"""
named AS (SELECT *, {b.TITLE_KEY} AS title_key FROM links),
unseen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title_key ORDER BY pos) AS turn FROM named)
    WHERE turn = 1 AND title_key NOT IN (SELECT title_key FROM stored_titles))"""

_NEW = """new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS turn FROM reached)
    WHERE turn = 1 AND id NOT IN (SELECT id FROM stored_ids))"""

_PREFIX = f"""{b.CRAWL_LOG},
marked AS (SELECT *, coalesce(fp = lag(fp) OVER (PARTITION BY crawl_id ORDER BY page_num), false) AS stuck FROM log),
reached AS (SELECT * FROM marked m WHERE NOT EXISTS (
    SELECT 1 FROM marked x WHERE x.crawl_id = m.crawl_id AND x.page_num <= m.page_num AND (x.n_links = 0 OR x.stuck)))"""

# Round to one decimal on the exact value of the double, ties to even.
_TENTH = "printf('%.1f', {})"

ORACLE = {
    "distinct_keys": f"""{_WITH} SELECT {b.TITLE_KEY} AS key FROM ads WHERE {b.V1} UNION SELECT id FROM ads""",
    "new_by_id": f"{_WITH} SELECT pos, id, title FROM links WHERE id NOT IN (SELECT id FROM stored_ids)",
    "new_by_title": f"{_WITH}, {_TITLES} SELECT pos, url, title_key FROM unseen",
    "first_seen": f"{_WITH} SELECT id, pos, title FROM ads QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1",
    "skipped_dups": f"{_WITH} SELECT pos, id FROM skipped",
    "skipped_preview": f"""{_WITH}, ranked AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, page_num ORDER BY pos) AS rank,
            count(*) OVER (PARTITION BY crawl_id, page_num) AS total FROM skipped)
        SELECT crawl_id, page_num, CAST(rank AS INT) AS rank, pos, id,
            left(CASE WHEN title <> '' THEN title ELSE url END, 50) || '...' AS shown, greatest(total - 3, 0) AS more
        FROM ranked WHERE rank <= 3""",
    "page_stats": f"""{_WITH} SELECT l.crawl_id, l.page_num, count(*) AS found, count(a.pos) AS new,
            count(*) - count(a.pos) AS skipped
        FROM links l LEFT JOIN accepted a ON a.pos = l.pos GROUP BY 1, 2""",
    "crawl_summary": f"""{_WITH}, {b.CRAWLED}, {b.sql_reached("n = 0 OR stuck")}, {_NEW},
        c AS (SELECT (SELECT count(*) FROM reached) AS found,
            (SELECT count(*) FROM stored WHERE {b.V1}) AS before, (SELECT count(*) FROM new) AS new)
        SELECT found, before, new, before + new AS total_after FROM c""",
    "incremental_by_id": f"""{_WITH}, {b.CRAWLED}, {b.sql_reached("n = 0 OR stuck")}, {_NEW}
        SELECT pos, url, title FROM (SELECT n.pos, n.url, f.title, row_number() OVER (ORDER BY n.pos) AS k
            FROM new n JOIN fetched f ON f.url = n.url WHERE f.title <> '')
        WHERE k <= (SELECT n FROM budget)""",
    "incremental_by_title": f"""{_WITH}, {b.CRAWLED}, {b.sql_reached("n = 0")},
        named AS (SELECT *, {b.TITLE_KEY} AS title_key FROM reached),
        unseen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title_key ORDER BY pos) AS turn FROM named)
            WHERE turn = 1 AND title_key NOT IN (SELECT title_key FROM stored_titles)),
        sizes AS (SELECT crawl_id, page_num, count(*) AS n FROM unseen GROUP BY 1, 2),
        kept AS (SELECT *, sum(n) OVER (PARTITION BY crawl_id ORDER BY page_num) - n AS before FROM sizes)
        SELECT u.pos, u.url, u.title FROM unseen u JOIN kept k ON k.crawl_id = u.crawl_id AND k.page_num = u.page_num
        WHERE k.before < 20""",
    "ingest_run": f"WITH {b.PART_RUN} SELECT * FROM kept UNION ALL SELECT * FROM added",
    "ingest_run_totals": f"""WITH {b.PART_RUN}, c AS (SELECT (SELECT count(*) FROM found) AS found,
            (SELECT count(*) FROM kept) AS before, (SELECT count(*) FROM added) AS new)
        SELECT found, before, new, before + new AS total_after FROM c""",
    "incremental_append": f"""{_WITH} SELECT {b.ADS_LIST} FROM stored UNION ALL
        SELECT {b.ADS_LIST} FROM ads WHERE pos IN (SELECT pos FROM accepted)""",
    "budget_cut": f"""{_WITH} SELECT pos, id FROM (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM accepted)
        WHERE k <= (SELECT n FROM budget)""",
    "budget_cut_by_source": f"""{_WITH} SELECT crawl_id, pos, id FROM accepted
        QUALIFY row_number() OVER (PARTITION BY crawl_id ORDER BY pos) <= 15""",
    "budget_cut_pages": f"""{_WITH}, sizes AS (SELECT crawl_id, page_num, count(*) AS n FROM accepted GROUP BY 1, 2),
        summed AS (SELECT *, sum(n) OVER (PARTITION BY crawl_id ORDER BY page_num) - n AS before FROM sizes)
        SELECT crawl_id, page_num, n FROM summed WHERE before < 15""",
    "page_fingerprint": f"WITH {_PREFIX} SELECT crawl_id, page_num, n_links, fp, stuck FROM marked",
    "crawl_prefix": f"WITH {_PREFIX} SELECT crawl_id, page_num, n_links, fp FROM reached",
    "crawl_progress": f"""WITH {_PREFIX} SELECT crawl_id, page_num,
            CAST(sum(n_links) OVER (PARTITION BY crawl_id ORDER BY page_num) AS BIGINT) AS found_so_far
        FROM reached""",
    "page_estimate": f"""WITH {b.CRAWL_LOG}, ends AS (SELECT crawl_id, arg_min(n_links, page_num) AS a,
            arg_max(n_links, page_num) AS z, max(page_num) AS pages FROM log GROUP BY 1)
        SELECT crawl_id, CASE WHEN a > 0 THEN pages ELSE 0 END AS pages,
            CASE WHEN a > 0 THEN a * (pages - 1) + z ELSE 0 END AS estimated FROM ends""",
    "batch_assign": f"""WITH {b.BATCH_LOG} SELECT crawl_id, rn, (rn - 1) // 5 + 1 AS batch_no,
            (count(*) OVER (PARTITION BY crawl_id) + 4) // 5 AS n_batches FROM batches""",
    "batch_eta": f"""WITH {b.BATCH_LOG}, summed AS (SELECT crawl_id, rn,
            CAST(CAST(sum(duration_cents) OVER (PARTITION BY crawl_id ORDER BY rn) AS BIGINT) AS DOUBLE) / 100 AS seconds,
            count(*) OVER (PARTITION BY crawl_id) - rn AS todo FROM batches),
        timed AS (SELECT crawl_id, rn, seconds + (rn - 1) * 10 AS elapsed, seconds / rn AS avg_batch_time,
            CASE WHEN todo > 0 THEN todo * (seconds / rn) + todo * 5 END AS eta_seconds FROM summed)
        SELECT *, {_TENTH.format('elapsed')} || 's' AS elapsed_text,
            {_TENTH.format('eta_seconds / 60')} || ' min' AS remaining_text,
            strftime(TIMESTAMP '{b.RUN_TIME}' + to_microseconds(CAST(round((elapsed + eta_seconds) * 1000000) AS BIGINT)), '%H:%M:%S') AS eta_time
        FROM timed""",
    "batch_summary": f"""WITH {b.BATCH_LOG}, summed AS (SELECT crawl_id, count(*) AS batches,
            CAST(CAST(sum(duration_cents) AS BIGINT) AS DOUBLE) / 100 AS seconds FROM batches GROUP BY 1),
        timed AS (SELECT *, seconds + (batches - 1) * 10 AS total_time FROM summed)
        SELECT crawl_id, batches, total_time, seconds / batches AS avg_batch_time,
            {_TENTH.format('total_time')} || 's (' || {_TENTH.format('total_time / 60')} || ' min)' AS total_text
        FROM timed""",
}
