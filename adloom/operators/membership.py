"""Which keys may be stored: split-block Bloom filters beside a table, so that new keys never meet the stored ones.

A filter is a table: its rows are the blocks of 256 bits that are not empty, (bucket, block, b0 to b3). A key sets one bit in each of the
four words of its block. Filters of parts of a table are built with partial aggregation and merged by bit-or, so an
append adds its own blocks. A filter says of every stored key that it may be there, and of others rarely; whatever it
says, the results of the operators here are those of a plain anti join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.session import materialize

WORDS = ("b0", "b1", "b2", "b3")

#: Bits for each key that `sized` plans for, and the most blocks of a filter: 64 MB.
BITS_PER_KEY, MOST_BLOCKS = 16, 1 << 21


@dataclass(frozen=True)
class Shape:
    """Buckets of a filter and blocks of a bucket; filters of one shape can be merged."""

    buckets: int = 64
    blocks: int = 1024

    def __post_init__(self) -> None:
        if min(self.buckets, self.blocks) < 1 or self.buckets * self.blocks > MOST_BLOCKS:
            raise ValueError(f"a filter has between 1 and {MOST_BLOCKS} blocks")


def sized(keys: int, buckets: int = 64) -> Shape:
    """A shape for so many keys, within the bound on a filter; beyond it more keys may be stored than are."""
    wanted = -(-keys * BITS_PER_KEY // (256 * buckets))
    return Shape(buckets, max(1, min(wanted, MOST_BLOCKS // buckets)))


def _places(key: str, shape: Shape) -> dict[str, Column]:
    """Bucket, block and the bit of each word of a key."""
    h, bits = F.xxhash64(key), F.xxhash64(key, F.lit("bits"))
    places = {
        "bucket": F.pmod(h, F.lit(shape.buckets)).cast("int"),
        "block": F.pmod(F.shiftright(h, 32), F.lit(shape.blocks)).cast("int"),
    }
    shifts = {w: F.shiftright(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k, w in enumerate(WORDS)}
    return places | shifts


def _bit(at: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(at))


def key_filter(stored: DataFrame, key: str, shape: Shape) -> DataFrame:
    """The filter of the keys of a table: bucket, block, b0 to b3. Null keys are in no filter."""
    places = _places(key, shape)
    at = stored.filter(F.col(key).isNotNull()).select(*[c.alias(name) for name, c in places.items()])
    return at.groupBy("bucket", "block").agg(*[F.bit_or(_bit(w)).alias(w) for w in WORDS])


def merged(*filters: DataFrame) -> DataFrame:
    """One filter of all keys that any of the filters, all of one shape, has."""
    whole = filters[0]
    for other in filters[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy("bucket", "block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def _packed(filter_: DataFrame, shape: Shape) -> DataFrame:
    """One row for each bucket: the words of its blocks as arrays by block."""
    spark = filter_.sparkSession
    every = spark.range(shape.buckets * shape.blocks).select(
        F.floor(F.col("id") / shape.blocks).cast("int").alias("bucket"), (F.col("id") % shape.blocks).cast("int").alias("block")
    )
    whole = every.join(filter_, ["bucket", "block"], "left")
    blocks = F.sort_array(F.collect_list(F.struct("block", *[F.coalesce(w, F.lit(0).cast("long")).alias(w) for w in WORDS])))
    packed = whole.groupBy("bucket").agg(blocks.alias("_blocks"))
    return packed.select("bucket", *[F.col("_blocks")[w].alias(w) for w in WORDS])


def flagged(links: DataFrame, key: str, filter_: DataFrame, shape: Shape, name: str = "_maybe") -> DataFrame:
    """Add whether the key of a row may be among the filtered ones, without a shuffle of the rows."""
    places = {f"_at_{n}": c for n, c in _places(key, shape).items()}
    packed = _packed(filter_, shape).withColumnsRenamed({c: f"_in_{c}" for c in ("bucket", *WORDS)})
    # At most MOST_BLOCKS blocks of 32 bytes.
    rows = links.withColumns(places).join(F.broadcast(packed), F.col("_at_bucket") == F.col("_in_bucket"), "left")
    hit = F.lit(True)
    for w in WORDS:
        word = F.element_at(F.col(f"_in_{w}"), F.col("_at_block") + 1)
        hit = hit & (word.bitwiseAND(_bit(f"_at_{w}")) != 0)
    return rows.select(*[F.col(c) for c in links.columns], (F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()).alias(name))


def not_stored(links: DataFrame, stored: DataFrame, key: str, filter_: DataFrame, shape: Shape) -> DataFrame:
    """Links whose key is not stored yet; repeats among them stay, and so do links without key.

    Those the filter does not know are surely new and go straight to the result; only the others are shuffled to meet the
    stored keys. The filter may know more keys than are stored, never fewer: it is that of `stored` or of a table that was
    larger. `links` is read twice.
    """
    told = flagged(links, key, filter_, shape)
    surely = told.filter(~F.col("_maybe")).drop("_maybe")
    perhaps = told.filter("_maybe").drop("_maybe")
    return surely.unionByName(perhaps.join(stored.select(key), key, "left_anti").select(*links.columns))


def write_filter(filter_: DataFrame, path: str) -> None:
    """Store a filter beside its table."""
    filter_.write.mode("overwrite").parquet(path)


def add_to_filter(spark: SparkSession, path: str, added: DataFrame, key: str, shape: Shape) -> DataFrame:
    """Merge the keys of an append into a stored filter, and give the new one.

    Adding keys again changes nothing, so an append that is run again after a failure may do so. The old filter stays in
    place until the new one is written in full; where there is none, one of the added keys alone is written.
    """
    from adloom.sources.files import delete, exists, rename

    fresh = key_filter(added, key, shape)
    if exists(spark, path):
        fresh = merged(spark.read.parquet(path), fresh)
    fresh = materialize(fresh, "filter")
    staged, old = f"{path}.new", f"{path}.old"
    write_filter(fresh, staged)
    if exists(spark, path):
        delete(spark, old)
        rename(spark, path, old)
    rename(spark, staged, path)
    delete(spark, old)
    return spark.read.parquet(path)
