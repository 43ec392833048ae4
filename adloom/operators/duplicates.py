"""Duplicates by several keys at once.

All criteria travel through the same shuffle as rows (type, key, pos). A key may hold any share of
the table: counts are combined before they are shuffled, and positions are gathered per slab of
positions, never per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.functions.text import concat_key, headline, join_numbers, shorten, strip
from adloom.operators.running import slab_of
from adloom.operators.validity import without_errors

# Names of the criteria in the order of the report.
ID, URL, TITLE_COMPANY, FULL_CONTENT = CRITERIA = ["ID", "URL", "Title+Company", "Full_Content"]

# The checks that decide whether a table counts as unique.
DECISIVE = [ID, URL, TITLE_COMPANY]

# Characters of a full record that the report shows, and widths of the previews.
PREVIEW_CHARS = 100
URL_CHARS, TITLE_CHARS, COMPANY_CHARS = 80, 50, 30

# Positions after which a row of the report is full and a key goes on in its next part.
POSITIONS_PER_PART = 100_000


def _field(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def _escaped(part: Column) -> Column:
    """Mark the separators inside a key part, so that only those between parts stay bare."""
    part = F.replace(F.coalesce(part, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(part, F.lit("|"), F.lit("\\|"))


def _key(criterion: str, exact_keys: bool) -> Column:
    """The key of one criterion; null where the record takes no part in it."""
    if criterion == ID:
        return F.nullif(_field("id"), F.lit(""))
    if criterion == URL:
        return F.nullif(_field("url"), F.lit(""))
    if criterion == TITLE_COMPANY:
        title = _escaped(_field("title")) if exact_keys else _field("title")
        return F.when(
            (_field("title") != "") & (_field("company") != ""), F.concat_ws("|", title, _field("company"))
        )
    # Long records are compared by digest; the shown part rides along behind it.
    return F.concat(F.sha2("_record", 256), F.left("_record", F.lit(PREVIEW_CHARS)))


def _record(content: Sequence[str], exact_keys: bool) -> Column:
    parts = [F.col(c).cast("string") for c in content]
    return concat_key([_escaped(p) for p in parts] if exact_keys else parts)


def marks(
    ads: DataFrame,
    criteria: Sequence[str] = CRITERIA,
    content: Sequence[str] | None = None,
    exclude_errors: bool = True,
    exact_keys: bool = False,
    pos: str = "pos",
) -> DataFrame:
    """One row (type, key, pos) per record and criterion it takes part in.

    `content` lists the columns of the full-content key, by default all but the position.
    Composite keys are joined by `|`, so `a|b`+`c` equals `a`+`b|c`; `exact_keys` tells them apart.
    """
    rows = without_errors(ads) if exclude_errors else ads
    if FULL_CONTENT in criteria:
        content = content or [c for c in ads.columns if c != pos]
        rows = rows.withColumn("_record", _record(content, exact_keys))
    pairs = [F.struct(F.lit(c).alias("type"), _key(c, exact_keys).alias("key")) for c in criteria]
    place = F.coalesce(F.col(pos), F.raise_error(F.lit("a record without position")).cast("bigint"))
    exploded = rows.select(place.alias("pos"), F.inline(F.array(*pairs)))
    # The position stands in the filter so that a missing one is told whatever is asked of the marks.
    return exploded.filter("key IS NOT NULL AND pos IS NOT NULL").select("type", "key", "pos")


def key_counts(marked: DataFrame) -> DataFrame:
    """How often each key occurs and where it occurs first."""
    return marked.groupBy("type", "key").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def duplicates(marked: DataFrame, positions_per_part: int = POSITIONS_PER_PART) -> DataFrame:
    """Keys that occur more than once: type, key, n, first, part, positions (ascending).

    Positions are gathered in slabs. A slab belongs to part k of its key if k times `positions_per_part` positions,
    rounded down, come before it. So a part holds less than twice as many positions, and a key with up to that many is
    part 0 alone. `n` counts all positions of the key.
    """
    cells = (
        marked.withColumn("slab", slab_of("pos", positions_per_part))
        .groupBy("type", "key", "slab")
        .agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        .filter("slab IS NOT NULL")
    )
    # One narrow row per key and slab. The filter on the slab is the one the join would add, so that both uses of
    # `cells` are the same plan and share one scan and one shuffle.
    sizes = cells.select("type", "key", "slab", F.size("positions").alias("size"), F.col("positions")[0].alias("at"))
    whole = W.partitionBy("type", "key")
    before = whole.orderBy("slab").rowsBetween(W.unboundedPreceding, -1)
    places = (
        sizes.withColumns(
            {
                "n": F.sum("size").over(whole),
                "first": F.min("at").over(whole),
                "part": F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / positions_per_part),
            }
        )
        .filter("n > 1")
        .drop("size", "at")
    )
    return (
        cells.join(places, ["type", "key", "slab"])
        .groupBy("type", "key", "n", "first", "part")
        .agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    )


def shown_value() -> Column:
    """What the report shows for a key; a full record always ends in an ellipsis."""
    digested = F.substring("key", 65, PREVIEW_CHARS)
    return F.when(F.col("type") == FULL_CONTENT, headline(digested, PREVIEW_CHARS)).otherwise(F.col("key"))


def _rank_of_type() -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CRITERIA]), F.col("type"))


def report(found: DataFrame) -> DataFrame:
    """The duplicates report: Type, Value, Row_Positions, Count (of these positions), Part (0 but for very hot keys)."""
    return found.select(
        F.col("type").alias("Type"),
        shown_value().alias("Value"),
        join_numbers(F.col("positions")).alias("Row_Positions"),
        F.size("positions").cast("bigint").alias("Count"),
        F.col("part").alias("Part"),
    )


def in_report_order(found: DataFrame) -> DataFrame:
    """Sections in their fixed order, keys by first occurrence."""
    return found.orderBy(_rank_of_type(), "first", "key", "part")


def summary(marked: DataFrame, criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """Per criterion: keys that occur more than once, and records beyond the first of each.

    Criteria without duplicates have a row of zeros.
    """
    per_type = marked.groupBy("type", "key").count().groupBy("type").agg(
        F.count_if(F.col("count") > 1).alias("duplicated_keys"),
        F.sum(F.col("count") - 1).alias("excess"),
    )
    wide = per_type.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("type") == c, F.col(m))), F.lit(0)).alias(f"{m}_{i}")
            for i, c in enumerate(criteria)
            for m in ("duplicated_keys", "excess")
        ]
    )
    rows = [
        F.struct(
            F.lit(c).alias("type"),
            F.col(f"duplicated_keys_{i}").alias("duplicated_keys"),
            F.col(f"excess_{i}").alias("excess"),
        )
        for i, c in enumerate(criteria)
    ]
    return wide.select(F.inline(F.array(*rows)))


OVERALL = "Overall"


def verdict(summed: DataFrame) -> DataFrame:
    """OK or WARNING per criterion and overall; full content does not count overall."""
    decisive = F.when(F.col("type").isin(DECISIVE), F.col("excess")).otherwise(0)
    overall = summed.agg(F.lit(OVERALL).alias("type"), F.sum(decisive).alias("excess"))
    return summed.select("type", "excess").unionByName(overall).withColumn(
        "verdict", F.when(F.col("excess") > 0, "WARNING").otherwise("OK")
    )


def preview_first(found: DataFrame, limit: int = 10) -> DataFrame:
    """The first keys of each decisive criterion among `duplicates` by first occurrence, with positions."""
    by_first = W.partitionBy("type").orderBy("first", "key")
    top = found.filter(F.col("type").isin(DECISIVE)).withColumn("rank", F.dense_rank().over(by_first))
    title_company = F.split("key", r"\|", 2)
    return top.filter(F.col("rank") <= limit).select(
        "type",
        "rank",
        F.when(F.col("type") == URL, shorten(F.col("key"), URL_CHARS))
        .when(F.col("type") == TITLE_COMPANY, shorten(title_company[0], TITLE_CHARS))
        .otherwise(F.col("key"))
        .alias("shown"),
        F.when(F.col("type") == TITLE_COMPANY, shorten(title_company[1], COMPANY_CHARS))
        .otherwise(F.lit(""))
        .alias("company"),
        join_numbers(F.col("positions"), ", ").alias("row_positions"),
        "part",
        "n",
    )


def second_occurrence(marked: DataFrame) -> DataFrame:
    """Where each duplicated key occurs for the second time."""
    in_key = W.partitionBy("type", "key").orderBy("pos")
    return marked.withColumn("seen", F.row_number().over(in_key)).filter("seen = 2").drop("seen")


# How many keys the clean-up check shows.
SHOWN_KEYS = {ID: 5, URL: 3, TITLE_COMPANY: 3}


def preview_second(marked: DataFrame) -> DataFrame:
    """The first few duplicated keys by second occurrence, and how many more there are."""
    seconds = second_occurrence(marked)
    totals = seconds.groupBy("type").agg(F.count("*").alias("total"))
    shown = F.coalesce(*[F.when(F.col("type") == c, F.lit(k)) for c, k in SHOWN_KEYS.items()])
    by_pos = W.partitionBy("type").orderBy("pos", "key")
    return (
        seconds.withColumn("rank", F.row_number().over(by_pos))
        .filter(F.col("rank") <= max(SHOWN_KEYS.values()))
        .filter(F.col("rank") <= shown)
        .join(totals, "type")
        .select("type", "rank", "key", "pos", F.greatest(F.col("total") - shown, F.lit(0)).alias("more"))
    )
