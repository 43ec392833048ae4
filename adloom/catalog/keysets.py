"""Sets of identifiers and titles, stored and arriving, kept as bitmaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from adloom.catalog import bindings as b
from adloom.functions.urls import id_from_html_url
from adloom.operators import incremental as inc
from adloom.operators import keysets as ks
from adloom.session import materialize


def _sides(s, f, kind):
    """The column, and the stored and the arriving keys of a kind."""
    stored, links = b.stored(s, f), b.links(s, f)
    if kind == "id":
        return "id", inc.stored_ids(stored, id_from_html_url), links.select("id")
    return "title_key", inc.stored_titles(stored), inc.with_title_key(links).select("title_key")


def _sets(s, f, kind):
    """Numbers and both sets; the stored keys were numbered first, the arriving ones behind them."""
    key, stored, arriving = _sides(s, f, kind)
    stored, arriving = materialize(stored, "stored-keys"), materialize(arriving.distinct(), "arriving-keys")
    first = materialize(ks.numbered(stored, key), "numbers")
    numbers = materialize(ks.extended(first, arriving, key), "numbers")
    return key, numbers, ks.key_set(stored, key, first), ks.key_set(arriving, key, numbers)


def _sizes(s, f):
    parts = []
    for kind in ("id", "title"):
        _, _, stored, arriving = _sets(s, f, kind)
        names = {"first_only": "stored_only", "second_only": "arriving_only"}
        parts.append(ks.sizes(stored, arriving).withColumnsRenamed(names).withColumn("kind", F.lit(kind)))
    return reduce(lambda x, y: x.unionByName(y), parts)


def _new(s, f):
    key, numbers, stored, arriving = _sets(s, f, "title")
    return ks.members(ks.difference(arriving, stored), numbers, key)


QUERIES = {"key_sets": _sizes, "key_set_new_titles": _new}

_WITH = f"""WITH {b.ADS}, st AS (SELECT * FROM ads WHERE (pos - 2) % 3 = 0), li AS (SELECT * FROM ads WHERE (pos - 2) % 3 <> 0),
    keys AS (SELECT 'id' AS kind, id AS k, true AS old FROM st UNION SELECT 'id', id, false FROM li
        UNION SELECT 'title', {b.TITLE_KEY}, true FROM st WHERE {b.V1}
        UNION SELECT 'title', {b.TITLE_KEY}, false FROM li WHERE title IS NOT NULL),
    sides AS (SELECT kind, k, bool_or(old) AS stored, bool_or(NOT old) AS arriving FROM keys GROUP BY ALL)"""

ORACLE = {
    "key_sets": f"""{_WITH} SELECT kind, count(*) AS either, count(*) FILTER (stored AND arriving) AS both,
        count(*) FILTER (NOT arriving) AS stored_only, count(*) FILTER (NOT stored) AS arriving_only
        FROM sides GROUP BY kind""",
    "key_set_new_titles": f"{_WITH} SELECT k AS title_key FROM sides WHERE kind = 'title' AND NOT stored",
}
