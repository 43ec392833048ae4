"""The most frequent keys, exactly: small counts by hash bucket stored for each batch, then a pass over candidates only.

A sketch holds, for each type, `DEPTH` lines of `WIDTH` buckets and the number of rows whose key falls into each. Sketches of
parts of a table add up to that of the table. No key occurs more often than its buckets say, so with a count that
the top `k` surely reach, the buckets below it rule out most keys, and no key of the top, ties included, is ever among those.
On flat data they rule out few, and the second pass counts nearly all keys; the result is the same.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.session import materialize

#: Lines of a sketch and buckets of a line: 2 MB of counts for each type, 32 KB once they are bits.
DEPTH, WIDTH = 4, 1 << 16

#: Types a sketch may tell apart, so that the bits of all of them stay within 2 MB.
MOST_TYPES = 64

SKETCH = "type string, line int, bucket int, n long"


def _bucket(line: int) -> Column:
    return F.pmod(F.xxhash64("key", F.lit(line)), F.lit(WIDTH)).cast("int")


def sketch(marked: DataFrame) -> DataFrame:
    """Rows by type, line and bucket, with the columns of `SKETCH`; rows without type or key are left out."""
    keyed = marked.filter("type IS NOT NULL AND key IS NOT NULL")
    places = F.posexplode(F.array(*[_bucket(line) for line in range(DEPTH)])).alias("line", "bucket")
    return keyed.select("type", places).groupBy("type", "line", "bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame) -> DataFrame:
    """The sketch of all rows that several sketches were made of."""
    return sketches.groupBy("type", "line", "bucket").agg(F.sum("n").alias("n"))


def store_sketch(path: str, batch: str, marked: DataFrame) -> None:
    """Store the sketch of a batch in a folder of sketches; a batch that is stored again takes the place of its first try."""
    sketch(marked).coalesce(1).write.mode("overwrite").parquet(f"{path}/of={quote(batch, safe='')}")


def stored_sketch(spark: SparkSession, path: str) -> DataFrame:
    """The sketch of all batches of a folder."""
    return merged(spark.read.schema(f"{SKETCH}, of string").parquet(path).drop("of"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type", "key").agg(F.count("*").alias("n"))


def _first(counts: DataFrame, k: int) -> DataFrame:
    """The `k` largest counts of each type with their places; equal ones in any order."""
    order = W.partitionBy("type").orderBy(F.col("n").desc())
    return counts.select("type", "n", F.row_number().over(order).alias("place")).filter(F.col("place") <= k)


def surely_reached(marked: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """For each type a count `least` that its `k` most frequent keys reach: type, least.

    It is the k-th largest among the keys of the `k` fullest buckets of the first line, and 1 if those hold fewer keys.
    """
    order = W.partitionBy("type").orderBy(F.col("n").desc(), "bucket")
    full = sizes.filter("line = 0").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    # At most k rows of a type, and MOST_TYPES types.
    full = F.broadcast(full.select(F.col("type").alias("_type"), F.col("bucket").alias("_bucket")))
    inside = (F.col("type") == F.col("_type")) & (_bucket(0) == F.col("_bucket"))
    best = _first(_counted(marked.join(full, inside, "left_semi")), k)
    least = F.when(F.max("place") == k, F.min("n")).otherwise(1)
    return best.groupBy("type").agg(least.cast("long").alias("least"))


def candidates(marked: DataFrame, sizes: DataFrame, least: DataFrame) -> DataFrame:
    """The rows whose key may occur `least` times or more, told without a shuffle of the rows."""
    heavy = sizes.join(least, "type").filter("n >= least")
    word, bit = F.floor(F.col("bucket") / 64), F.col("bucket") % 64
    words = heavy.groupBy("type", "line", word.cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")
    )
    per_line = WIDTH // 64
    every = heavy.select("type").distinct().select("type", F.explode(F.sequence(F.lit(0), F.lit(DEPTH * per_line - 1))).alias("at"))
    every = every.select("type", F.floor(F.col("at") / per_line).cast("int").alias("line"), (F.col("at") % per_line).alias("word"))
    whole = every.join(words, ["type", "line", "word"], "left")
    bits = F.sort_array(F.collect_list(F.struct("line", "word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    # One row of 32 KB for each type.
    packed = whole.groupBy("type").agg(bits.alias("_bits")).select(F.col("type").alias("_type"), F.col("_bits")["bits"].alias("_bits"))
    hit = F.lit(True)
    for line in range(DEPTH):
        at = _bucket(line)
        found = F.element_at("_bits", (F.floor(at / 64) + (line * per_line + 1)).cast("int"))
        hit = hit & (F.call_function("shiftrightunsigned", found, at % 64).bitwiseAND(F.lit(1).cast("long")) == 1)
    rows = marked.select("type", "key").join(F.broadcast(packed), F.col("type") == F.col("_type"))
    return rows.filter(hit).select("type", "key")


def heavy_keys(marked: DataFrame, sketched: DataFrame, k: int) -> DataFrame:
    """The `k` most frequent keys of each type and those equal to the last of them: type, key, n, rank.

    Equal counts share a rank, the next is as far down as there are keys above it. `sketched` is the sketch of the rows, or
    of a table that held more of them. Rows without type or key are left out; no rows give none.
    """
    if k < 1:
        raise ValueError("k counts from 1")
    sizes = materialize(sketched, "sketch")
    if sizes.select("type").distinct().count() > MOST_TYPES:
        raise ValueError(f"a sketch tells at most {MOST_TYPES} types apart")
    least = materialize(surely_reached(marked, sizes, k), "least")
    counts = materialize(_counted(candidates(marked, sizes, least)), "heavy")
    # Different counts among the first k, so at most k rows of a type.
    ranks = _first(counts, k).groupBy("type", "n").agg(F.min("place").cast("long").alias("rank"))
    return counts.join(F.broadcast(ranks), ["type", "n"]).select("type", "key", "n", "rank")
