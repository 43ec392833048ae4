"""Order-dependent operators that never put a whole group into one task.

A window partitioned by a group key sends the group to one task, which fails when one group holds
a third of all rows. The operators here need an integer position that is unique within the group.
They cut it into slabs of `width` positions, so a window over (group, slab) sees at most `width`
rows, and carry the result from slab to slab with a second window over one row per slab.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLAB_WIDTH = 1_000_000


def slab_of(pos: str, width: int) -> Column:
    """The first position of the slab a position lies in."""
    return F.col(pos) - F.pmod(F.col(pos), F.lit(width))


def present(df: DataFrame, name: str) -> Column:
    """A column of which a null stops the job, as its row would have no place in the order."""
    missing = F.raise_error(F.lit(f"a row without {name} has no place in the order"))
    return F.coalesce(F.col(name), missing.cast(df.schema[name].dataType))


def cut(df: DataFrame, by: Sequence[str], pos: str, width: int = SLAB_WIDTH) -> DataFrame:
    """Add the slab of each row as `_slab`, unless it is there already.

    Operators applied one after the other to a table that has been cut share its partitioning. Rows that belong to no
    group or have no position are never lost: the job fails.
    """
    if "_slab" in df.columns:
        return df
    df = df.withColumns({name: present(df, name) for name in [*by, pos]})
    return df.withColumn("_slab", slab_of(pos, width))


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    pos: str | Sequence[Column],
    sums: Mapping[str, Column],
    totals: Mapping[str, str] | None = None,
    width: int = SLAB_WIDTH,
) -> DataFrame:
    """Add running sums in position order within each group, the current row included.

    Nulls add nothing. `totals` maps names in `sums` to columns that get the sum over the whole group.
    Positions should be dense, like row numbers: a slab of them is what a task takes. `operators.ordering` takes any order;
    it gives tables with `_slab` and the order as columns.
    """
    keys = [*by, "_slab"]
    rows = cut(df, by, pos, width)
    over_slabs = W.partitionBy(*by)
    before = over_slabs.orderBy("_slab").rowsBetween(W.unboundedPreceding, -1)
    slabs = rows.groupBy(*keys).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"_sum_{k}") for k, v in sums.items()])
    slabs = slabs.select(
        *keys,
        *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums],
        *[F.sum(f"_sum_{k}").over(over_slabs).alias(name) for k, name in (totals or {}).items()],
    )
    inside = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.join(slabs, keys)
    out = out.select(
        "*", *[(F.col(f"_before_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(k) for k, v in sums.items()]
    )
    return out.select(*df.columns, *sums, *(totals or {}).values())


def rank_in_order(
    df: DataFrame, by: Sequence[str], pos: str, name: str, count: str | None = None, width: int = SLAB_WIDTH
) -> DataFrame:
    """Number the rows of each group from 1 in position order; `count` gets the group size."""
    return running_totals(df, by, pos, {name: F.lit(1).cast("bigint")}, {name: count} if count else None, width)


def previous_value(
    df: DataFrame, by: Sequence[str], pos: str, value: str, name: str, width: int = SLAB_WIDTH
) -> DataFrame:
    """Add the value of the preceding row of the group, null on its first row."""
    keys = [*by, "_slab"]
    rows = cut(df, by, pos, width)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v")), pos).alias("_last"))
    carried = last.select(*keys, F.lag("_last").over(W.partitionBy(*by).orderBy("_slab"))["v"].alias("_carried"))
    inside = W.partitionBy(*keys).orderBy(pos)
    before = F.when(F.row_number().over(inside) == 1, F.col("_carried")).otherwise(F.lag(value).over(inside))
    return rows.join(carried, keys).select(*df.columns, before.alias(name))
