"""Sets of keys as bitmaps: keys get dense numbers, a set is one row for each 64 numbers of which it has any.

A dictionary is a table (key, num) whose numbers, from 0, leave no gaps; later keys are numbered behind those that are there, so
stored sets stay as they are. A set is a table (word, bits): bit `num % 64` of word `num / 64`. Union, intersection and
difference join such rows by word and leave the keys alone, so their size is that of the sets over 64. (The bitmap
aggregates of Spark know or and and only, on binaries; a difference needs the bits of both sides.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.operators.ordering import RANGE_ROWS, rank

#: Keys of a word.
WORD = 64


def numbered(keys: DataFrame, key: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """A dictionary of the distinct keys of a table, in key order; null has no number.

    Numbers are handed out by ranges of keys: none is worked out in one task, and repeats are combined before.
    """
    distinct = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    return rank(distinct, [key], "num", range_rows=range_rows).select(key, (F.col("num") - 1).alias("num"))


def extended(numbers: DataFrame, keys: DataFrame, key: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The dictionary with the keys it did not have, numbered behind the others. It should be a stored table."""
    unknown = keys.select(key).join(numbers.select(key), key, "left_anti")
    there = F.coalesce(numbers.agg(F.max("num") + 1).scalar(), F.lit(0))
    return numbers.unionByName(numbered(unknown, key, range_rows).withColumn("num", F.col("num") + there))


def key_set(rows: DataFrame, key: str, numbers: DataFrame) -> DataFrame:
    """The set of the keys of a table: word, bits. A null key is in no set; one without a number stops the job."""
    keys = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    unknown = F.raise_error(F.concat(F.lit("no number for key "), F.col(key).cast("string")))
    found = keys.join(numbers, key, "left").select(F.coalesce("num", unknown.cast("long")).alias("num"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("num") % WORD).cast("int"))
    words = found.select(F.floor(F.col("num") / WORD).alias("word"), bit.alias("bit"))
    return words.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def union(*sets: DataFrame) -> DataFrame:
    """What any of the sets has; adding a set again changes nothing."""
    whole = sets[0]
    for other in sets[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _side_by_side(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    return a.select("word", F.col("bits").alias("a")).join(b.select("word", F.col("bits").alias("b")), "word", how)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """What both sets have."""
    both = _side_by_side(a, b, "inner").select("word", F.col("a").bitwiseAND(F.col("b")).alias("bits"))
    return both.filter("bits != 0")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """What the first set has and the second has not."""
    rest = F.col("a").bitwiseAND(F.bitwise_not(F.coalesce("b", F.lit(0).cast("long"))))
    return _side_by_side(a, b, "left").select("word", rest.alias("bits")).filter("bits != 0")


def _total(bits: Column) -> Column:
    return F.coalesce(F.sum(F.bit_count(bits).cast("long")), F.lit(0).cast("long"))


def size(keys: DataFrame) -> DataFrame:
    """One row: how many keys a set has."""
    return keys.agg(_total(F.col("bits")).alias("n"))


def sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row from one pass over both sets: sizes of either, both, the first alone and the second alone."""
    zero = F.lit(0).cast("long")
    rows = _side_by_side(a, b, "full").select(F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))
    x, y = F.col("a"), F.col("b")
    return rows.agg(
        _total(x.bitwiseOR(y)).alias("either"),
        _total(x.bitwiseAND(y)).alias("both"),
        _total(x.bitwiseAND(F.bitwise_not(y))).alias("first_only"),
        _total(y.bitwiseAND(F.bitwise_not(x))).alias("second_only"),
    )


def members(keys: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """The keys of a set."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("_bit")
    there = F.call_function("shiftright", F.col("bits"), F.col("_bit")).bitwiseAND(F.lit(1).cast("long")) == 1
    nums = keys.select("word", "bits", bit).filter(there).select((F.col("word") * WORD + F.col("_bit")).alias("num"))
    return nums.join(numbers, "num").select(key)
