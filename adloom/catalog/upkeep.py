"""Stored state that follows a table: filters of its keys, and duplicates kept up to date."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.catalog import bindings as b
from adloom.catalog import ingest, quality
from adloom.functions.urls import id_from_html_url
from adloom.operators import duplicates as dup
from adloom.operators import incremental as inc
from adloom.operators import membership as mem
from adloom.operators.validity import without_errors
from adloom.plans import dupstate
from adloom.session import materialize, staging_path

PARTS = 3


def _stored_ids(s, f):
    return inc.stored_ids(b.stored(s, f), id_from_html_url)


def _filtered(s, f):
    """New links, with a filter that three appends to the table have written one after the other."""
    stored = materialize(_stored_ids(s, f), "stored-ids")
    shape, path = mem.sized(stored.count()), staging_path(s, "filter")
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    for k in range(PARTS):
        filter_ = mem.add_to_filter(s, path, stored.filter(part == k), "id", shape)
    links = b.links(s, f).select("pos", "id", "title")
    return mem.not_stored(links, stored, "id", filter_, shape)


def _titles_filtered(s, f):
    """New titles with a filter that is far too small, so that many of them meet the stored ones."""
    stored, shape = materialize(inc.stored_titles(b.stored(s, f)), "stored-titles"), mem.Shape(2, 1)
    new = inc.first_seen(inc.with_title_key(b.links(s, f)), "title_key")
    filter_ = mem.key_filter(stored, "title_key", shape)
    return mem.not_stored(new, stored, "title_key", filter_, shape).select("pos", "url", "title_key")


def _state(s, f):
    """Counts of three appends, the second of them twice, and of a clean-up that removes the error records."""
    ads, path = b.ads(s, f), staging_path(s, "state")

    def marks(rows):
        return dup.marks(rows, exclude_errors=False)

    for k in (0, 1, 1, 2):
        dupstate.apply_batch(s, path, f"append {k}", added=marks(ads.filter(F.col("pos") % PARTS == k)))
    errors = ads.join(without_errors(ads).select("pos"), "pos", "left_anti").select(*ads.columns)
    dupstate.apply_batch(s, path, "clean-up", removed=marks(errors))
    return path


QUERIES = {
    "new_by_id_filtered": _filtered,
    "new_by_title_filtered": _titles_filtered,
    "dup_summary_incremental": lambda s, f: dupstate.summary(s, _state(s, f)),
    "key_counts_incremental": lambda s, f: dupstate.counts(s, _state(s, f)).filter("n > 1").select(
        "type", dup.shown_value().alias("value"), "n"
    ),
}

ORACLE = {
    "new_by_id_filtered": ingest.ORACLE["new_by_id"],
    "new_by_title_filtered": ingest.ORACLE["new_by_title"],
    "dup_summary_incremental": quality.ORACLE["dup_summary"],
    "key_counts_incremental": " UNION ALL ".join(
        f"SELECT '{kind}' AS type, value, n FROM ({quality.ORACLE[name]})"
        for kind, name in ((dup.ID, "dup_id"), (dup.URL, "dup_url"), (dup.TITLE_COMPANY, "dup_title_company"),
                           (dup.FULL_CONTENT, "dup_full_content"))
    ),
}
