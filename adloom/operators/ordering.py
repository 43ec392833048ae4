"""Running totals, ranks and budgets in any order, without a task that holds a whole group.

`operators.running` needs dense integer positions. Here rows are ordered by any columns: times, texts, sparse numbers.
Splitters from a sample cut the ordered rows into ranges of about equal size, rows are counted and summed per range, and
each range starts where the ranges before it end. The order should end in a column that tells rows apart: then a value on
a third of the rows is cut into as many ranges as any other third.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.operators import incremental, running
from adloom.session import materialize

#: Rows of a range, about, in tables of so many that the tasks of a shuffle would get more.
RANGE_ROWS = 1_000_000

#: Rows a range has at least, about, so that small tables are not cut into crumbs.
LEAST_ROWS = 1_000


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def ranges_of(df: DataFrame, rows: int, range_rows: int = RANGE_ROWS) -> int:
    """Into how many ranges so many rows are cut: as many as a shuffle has tasks, more for large tables."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(math.ceil(rows / range_rows), min(tasks, math.ceil(rows / min(LEAST_ROWS, range_rows))), 1)


def in_ranges(
    df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), range_rows: int = RANGE_ROWS
) -> DataFrame:
    """The rows with the number of their range, `_slab`, written to the shared folder.

    Ranges follow `by` and then `order`, so the ranges of a group follow each other. Rows come back to the same range
    whenever the table is read, as splitters of a second shuffle would be others. A null in `by` stops the job; in
    `order` it comes first, or where its column says. `df` is read for its count, for the sample and for its rows.
    """
    named = df.withColumns({name: running.present(df, name) for name in by}) if by else df
    count = ranges_of(df, df.count(), range_rows)
    dealt = named.repartitionByRange(count, *by, *_columns(order))
    return materialize(dealt.withColumn("_slab", F.spark_partition_id()), "ranges")


def running_totals(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add running sums in the given order within each group, the current row included; nulls add nothing.

    `totals` maps names in `sums` to columns that get the sum over the whole group. Rows that are equal in all of
    `order` come in any order among themselves, but each gets a sum of its own.
    """
    ranged = in_ranges(df, order, by, range_rows)
    return running.running_totals(ranged, by, _columns(order), sums, totals).drop("_slab")


def rank(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str,
    by: Sequence[str] = (),
    count: str | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Number the rows of each group from 1 in the given order; `count` gets the group size."""
    one = {name: F.lit(1).cast("bigint")}
    return running_totals(df, order, one, by, {name: count} if count else None, range_rows)


def first_rows(
    df: DataFrame,
    budget: int | Column,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """The first `budget` rows in the given order, overall or of each group; ranges beyond it are not ranked."""
    ranged = in_ranges(df, order, by, range_rows)
    return incremental.budget_cut(ranged, budget, by, _columns(order)).drop("_slab")
