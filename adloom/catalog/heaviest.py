"""Frequent keys from stored sketches, and categories by a table of terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.catalog import bindings as b
from adloom.catalog import quality
from adloom.operators import duplicates as dup
from adloom.operators import heavy
from adloom.operators.terms import WORD, category_terms
from adloom.session import staging_path

TOP, PARTS = 20, 3


def _heavy(s, f):
    """The top keys of all ads, with sketches of three appends, the second of which was stored twice."""
    ads, path = b.ads(s, f), staging_path(s, "sketches")
    for k in (0, 1, 1, 2):
        part = dup.marks(ads.filter(F.col("pos") % PARTS == k), dup.DECISIVE, exclude_errors=False)
        heavy.store_sketch(path, f"append {k}", part)
    return heavy.heavy_keys(dup.marks(ads, dup.DECISIVE, exclude_errors=False), heavy.stored_sketch(s, path), TOP)


def _branded(s, f):
    titles = b.titled_parts(s, f).join(b.table(s, f, "part").select("p_partkey", "p_brand"), "p_partkey")
    return titles.select("p_partkey", F.concat_ws(" - ", "p_brand", "title").alias("title"))


def _part_terms(s, f):
    """A term for each part, of two to five words; some are in no title."""
    kind, brand, name = F.col("p_partkey") % 4, F.col("p_brand"), F.col("p_name")
    term = (
        F.when(kind == 0, F.concat_ws("/", name, F.lit("Shop ASSISTANT")))
        .when(kind == 1, F.concat_ws(", ", brand, name))
        .when(kind == 2, F.concat_ws(" ", F.substring_index(name, " ", -1), F.lit("bar-staff")))
        .otherwise(F.concat_ws(" ", F.col("p_type"), name))
    )
    return b.table(s, f, "part").select(F.col("p_partkey").alias("rule"), F.col("p_type").alias("category"), term.alias("term"))


QUERIES = {
    "heavy_keys": _heavy,
    "category_terms": lambda s, f: category_terms(_branded(s, f), _part_terms(s, f), "p_partkey", "title"),
}


def _words(c: str) -> str:
    return f"' ' || array_to_string(regexp_extract_all(lower({c}), '{WORD}'), ' ') || ' '"


ORACLE = {
    "heavy_keys": f"""SELECT type, key, n, rank FROM (
        SELECT *, rank() OVER (PARTITION BY type ORDER BY n DESC) AS rank FROM ({quality.ORACLE['key_counts_raw']}))
    WHERE rank <= {TOP}""",
    "category_terms": f"""WITH {b.TITLED_PARTS}, texts AS (
        SELECT p_partkey, {_words("p_brand || ' - ' || title")} AS words FROM titled JOIN part USING (p_partkey)
    ), terms AS (
        SELECT p_partkey AS rule, p_type AS category, CASE p_partkey % 4
            WHEN 0 THEN p_name || '/Shop ASSISTANT' WHEN 1 THEN p_brand || ', ' || p_name
            WHEN 2 THEN split_part(p_name, ' ', -1) || ' bar-staff' ELSE p_type || ' ' || p_name END AS term
        FROM part
    ), first_terms AS (
        SELECT {_words('term')} AS words, min(rule) AS rule FROM terms GROUP BY 1
    ), found AS (
        SELECT p_partkey, min(t.rule) AS rule
        FROM (SELECT words, list(p_partkey) AS keys FROM texts GROUP BY 1) x JOIN first_terms t ON contains(x.words, t.words),
            unnest(x.keys) AS u(p_partkey)
        GROUP BY 1
    )
    SELECT p_partkey, rule, category, term FROM found JOIN terms USING (rule)""",
}
