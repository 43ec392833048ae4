"""Validity, duplicates, previews, verdicts and clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.catalog import bindings as b
from adloom.operators import duplicates as dup
from adloom.operators import validity as v
from adloom.plans.cleanup import clean_errors
from adloom.plans.uniqueness import analyze
from adloom.session import staging_path


def _one(criterion: str):
    def query(spark, folder):
        found = dup.duplicates(dup.marks(b.ads(spark, folder), [criterion]))
        return dup.report(found).select(
            F.col("Value").alias("value"), F.col("Row_Positions").alias("row_positions"), F.col("Count").alias("n")
        )

    return query


def _marks(spark, folder):
    return dup.marks(b.ads(spark, folder))


def _raw_marks(spark, folder):
    return dup.marks(b.ads(spark, folder), dup.DECISIVE, exclude_errors=False)


def _cleaned(spark, folder):
    path = staging_path(spark, "clean")
    b.ads(spark, folder).drop("pos").write.parquet(path)
    clean_errors(spark, path, "parquet")
    return spark.read.parquet(path)


def _backup(spark, folder):
    """The table before cleaning, as the backup keeps it."""
    path = staging_path(spark, "kept")
    b.ads(spark, folder).drop("pos").write.parquet(path)
    return spark.read.parquet(clean_errors(spark, path, "parquet").backup)


QUERIES = {
    "duplicates_report": lambda s, f: analyze(b.ads(s, f)).report,
    "dup_id": _one(dup.ID),
    "dup_url": _one(dup.URL),
    "dup_title_company": _one(dup.TITLE_COMPANY),
    "dup_full_content": _one(dup.FULL_CONTENT),
    "dup_summary": lambda s, f: dup.summary(_marks(s, f)),
    "dup_verdict": lambda s, f: dup.verdict(dup.summary(_marks(s, f))),
    "dup_summary_raw": lambda s, f: dup.summary(_raw_marks(s, f), dup.DECISIVE),
    "key_counts_raw": lambda s, f: dup.key_counts(_raw_marks(s, f)).select("type", "key", "n"),
    "second_occurrence": lambda s, f: dup.second_occurrence(_raw_marks(s, f)),
    "dup_preview_first": lambda s, f: analyze(b.ads(s, f), 10).preview,
    "dup_preview_second": lambda s, f: dup.preview_second(_raw_marks(s, f)),
    "quality_counts": lambda s, f: v.quality_counts(b.ads(s, f)),
    "valid_count": lambda s, f: v.stored_count(b.ads(s, f)),
    "valid_v1": lambda s, f: v.stored_ads(b.ads(s, f)).select("pos", "id", "title"),
    "valid_v2": lambda s, f: v.without_errors(b.ads(s, f)).select("pos", "id", "title"),
    "clean_errors": _cleaned,
    "clean_backup": _backup,
}

_KEYS = f"""
keys AS (
    SELECT pos, title, {b.sql_strip('id')} AS k_id, {b.sql_strip('url')} AS k_url,
        {b.sql_strip('title')} AS k_title, {b.sql_strip('company')} AS k_company,
        concat_ws('|', {', '.join(b.sql_strip(c) for c in b.ADS_COLUMNS)}) AS k_full
    FROM ads),
raw AS (
    SELECT 'ID' AS type, k_id AS key, pos, title FROM keys WHERE k_id <> ''
    UNION ALL SELECT 'URL', k_url, pos, title FROM keys WHERE k_url <> ''
    UNION ALL SELECT 'Title+Company', k_title || '|' || k_company, pos, title FROM keys
        WHERE k_title <> '' AND k_company <> ''),
marks AS (
    SELECT type, key, pos FROM raw WHERE {b.V2}
    UNION ALL SELECT 'Full_Content', k_full, pos FROM keys WHERE {b.V2}),
dups AS (
    SELECT type, key, count(*) AS n, min(pos) AS first, list(pos ORDER BY pos) AS positions
    FROM marks GROUP BY ALL HAVING count(*) > 1)"""

_WITH = f"WITH {b.ADS}, {_KEYS}"

_VALUE = "CASE WHEN type = 'Full_Content' THEN left(key, 100) || '...' ELSE key END"


def _positions(sep: str) -> str:
    return f"array_to_string(positions, '{sep}')"


def _one_sql(criterion: str) -> str:
    return f"{_WITH} SELECT {_VALUE} AS value, {_positions(',')} AS row_positions, n FROM dups WHERE type = '{criterion}'"


def _summary_sql(marks: str, types: list[str]) -> str:
    values = ", ".join(f"('{t}')" for t in types)
    return f"""SELECT t.type, CAST(count(*) FILTER (n > 1) AS BIGINT) AS duplicated_keys,
        CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess
    FROM (VALUES {values}) t(type)
    LEFT JOIN (SELECT type, key, count(*) AS n FROM {marks} GROUP BY ALL) c ON c.type = t.type GROUP BY t.type"""


def _cut(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN left({c}, {n}) || '...' ELSE {c} END"


_TITLE = "split_part(key, '|', 1)"
_COMPANY = "substr(key, length(split_part(key, '|', 1)) + 2)"

_SECOND = """seconds AS (
    SELECT type, key, pos FROM raw QUALIFY row_number() OVER (PARTITION BY type, key ORDER BY pos) = 2)"""

ORACLE = {
    "duplicates_report": f"""{_WITH} SELECT type AS "Type", {_VALUE} AS "Value", {_positions(',')} AS "Row_Positions",
        n AS "Count", 0 AS "Part" FROM dups""",
    **{f"dup_{k}": _one_sql(c) for k, c in zip(("id", "url", "title_company", "full_content"), dup.CRITERIA)},
    "dup_summary": f"{_WITH} {_summary_sql('marks', dup.CRITERIA)}",
    "dup_verdict": f"""{_WITH}, summed AS ({_summary_sql('marks', dup.CRITERIA)}),
        lines AS (SELECT type, excess FROM summed
            UNION ALL SELECT 'Overall', CAST(sum(excess) AS BIGINT) FROM summed WHERE type <> 'Full_Content')
        SELECT type, excess, CASE WHEN excess > 0 THEN 'WARNING' ELSE 'OK' END AS verdict FROM lines""",
    "dup_summary_raw": f"{_WITH} {_summary_sql('raw', dup.DECISIVE)}",
    "key_counts_raw": f"{_WITH} SELECT type, key, count(*) AS n FROM raw GROUP BY ALL",
    "second_occurrence": f"{_WITH}, {_SECOND} SELECT type, key, pos FROM seconds",
    "dup_preview_first": f"""{_WITH}, ranked AS (
            SELECT *, row_number() OVER (PARTITION BY type ORDER BY first) AS rank FROM dups WHERE type <> 'Full_Content')
        SELECT type, CAST(rank AS INT) AS rank,
            CASE type WHEN 'URL' THEN {_cut('key', 80)} WHEN 'Title+Company' THEN {_cut(_TITLE, 50)} ELSE key END AS shown,
            CASE type WHEN 'Title+Company' THEN {_cut(_COMPANY, 30)} ELSE '' END AS company,
            {_positions(', ')} AS row_positions, 0 AS part, n
        FROM ranked WHERE rank <= 10""",
    "dup_preview_second": f"""{_WITH}, {_SECOND}, ranked AS (
            SELECT *, row_number() OVER (PARTITION BY type ORDER BY pos) AS rank, count(*) OVER (PARTITION BY type) AS total,
                CASE type WHEN 'ID' THEN 5 ELSE 3 END AS shown FROM seconds)
        SELECT type, CAST(rank AS INT) AS rank, key, pos, greatest(total - shown, 0) AS more FROM ranked WHERE rank <= shown""",
    "quality_counts": f"""WITH {b.ADS} SELECT count(*) AS total_records, count(*) FILTER ({b.V2}) AS valid_records,
        count(*) FILTER (NOT ({b.V2})) AS error_records FROM ads""",
    "valid_count": f"WITH {b.ADS} SELECT count(*) AS n FROM ads WHERE {b.V1}",
    "valid_v1": f"WITH {b.ADS} SELECT pos, id, title FROM ads WHERE {b.V1}",
    "valid_v2": f"WITH {b.ADS} SELECT pos, id, title FROM ads WHERE {b.V2}",
    "clean_backup": f"WITH {b.ADS} SELECT {b.ADS_LIST} FROM ads",
    "clean_errors": f"WITH {b.ADS} SELECT {b.ADS_LIST} FROM ads WHERE {b.V2}",
}
