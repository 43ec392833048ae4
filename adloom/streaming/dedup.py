"""First-seen deduplication and append of unseen ads over streams."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adloom.operators.incremental import first_seen
from adloom.sources.ads import append_parquet
from adloom.sources.files import children, delete, exists, rename, size_of, touch


def first_seen_stream(
    stream: DataFrame, key: Sequence[str], time: str, horizon: str, spread: int = 16
) -> DataFrame:
    """Drop ads whose key was seen within the horizon; state older than that is let go.

    A first pass over (key, part of the stream) thins out a hot key before all that is left of it
    meets in one state partition; `spread` is the number of parts, 1 goes without the pass.
    """
    timed = stream.withWatermark(time, horizon)
    if spread > 1:
        parts = F.pmod(F.xxhash64(F.col(time)), F.lit(spread))
        timed = timed.withColumn("_part", parts).dropDuplicatesWithinWatermark([*key, "_part"]).drop("_part")
    return timed.dropDuplicatesWithinWatermark(list(key))


# Folders into which the stored keys are dealt out, unless a table says otherwise; a batch reads those its keys fall into.
BUCKETS = 64

# What a table holds beside its buckets, all unseen by readers: how many there are, buckets being rewritten, and replaced ones.
COUNT, FRESH, REPLACED = "_buckets-", "_compacting", "_replaced"


def _buckets(spark: SparkSession, folder: str) -> list[str]:
    return [n for n in children(spark, folder) if n.startswith("_bucket=")]


def _is_plain(spark: SparkSession, table: str) -> bool:
    """Whether there is a table that is not dealt into buckets."""
    return not _buckets(spark, table) and any(n[0] not in "_." for n in children(spark, table))


def buckets_of(spark: SparkSession, table: str) -> int:
    """Into how many buckets a table is dealt; the number is fixed with its first batch."""
    said = [n for n in children(spark, table) if n.startswith(COUNT)]
    return int(said[0].removeprefix(COUNT)) if said else BUCKETS


def append_unseen(
    stream: DataFrame, table: str, key: str, pos: str, checkpoint: str, trigger: dict | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Append the first ad of each key that the table does not have yet, batch by batch.

    The stored table is the state. It is partitioned by a hash of the key, `_bucket`, and a batch reads the key column of
    its own buckets only; a table stored without buckets is read whole. A batch that is run again after a failure finds
    its ads stored and adds none twice. `buckets` counts for a new table; it should be so large that a bucket fits a task.
    A batch adds a file to each bucket it touches, so call `compact` between runs.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        restore(spark, table)
        dealt, plain = _buckets(spark, table), _is_plain(spark, table)
        if not dealt and not plain:
            touch(spark, f"{table}/{COUNT}{buckets}")  # before the first file, so that no batch can take another number
        count = buckets_of(spark, table)
        bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(count)).cast("int")
        fresh = first_seen(batch, key, pos).withColumn("_bucket", bucket).persist()
        added = fresh
        if dealt or plain:
            stored = spark.read.parquet(table)
            if dealt:
                own = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most as many numbers as buckets
                stored = stored.filter(F.col("_bucket").isin(own))
            known = stored.select(key).join(fresh.select(key), key, "left_semi")
            added = fresh.join(known, key, "left_anti")
        if plain:
            append_parquet(added.select(*batch.columns), table)
        else:
            # Dealt out by bucket, so that a batch adds one file to each it touches.
            rows = added.select(*batch.columns, "_bucket").repartition("_bucket")
            rows.write.mode("append").partitionBy("_bucket").parquet(table)
        fresh.unpersist()

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def restore(spark: SparkSession, table: str) -> None:
    """Undo what a compaction that was cut short has left: a bucket without its folder gets the old one back."""
    old = f"{table}/{REPLACED}"
    if exists(spark, old):
        there = set(_buckets(spark, table))
        for name in _buckets(spark, old):
            if name not in there:
                rename(spark, f"{old}/{name}", f"{table}/{name}")
        delete(spark, old)
    delete(spark, f"{table}/{FRESH}")


def compact(spark: SparkSession, table: str, files: int = 32, file_bytes: int = 256 << 20) -> int:
    """Rewrite the buckets that have over `files` files into files of about `file_bytes`; how many buckets that were.

    Rows stay as they are. All of them are written by one job that shuffles by (bucket, part of it), beside the table; then
    each folder is swapped by renaming. If that is cut short, `restore`, which every batch and every compaction begins
    with, gives a bucket its old files back. No stream may append meanwhile: one writer at a time.
    """
    restore(spark, table)
    many = [n for n in _buckets(spark, table) if len([f for f in children(spark, f"{table}/{n}") if f[0] not in "_."]) > files]
    if not many:
        return 0
    largest = max(size_of(spark, f"{table}/{n}") for n in many)
    parts = math.ceil(largest / file_bytes)
    rows = spark.read.parquet(table).filter(F.col("_bucket").isin([int(n.partition("=")[2]) for n in many]))
    part = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "_bucket"]), F.lit(parts))
    fresh, old = f"{table}/{FRESH}", f"{table}/{REPLACED}"
    dealt = rows.withColumn("_part", part).repartition(len(many) * parts, "_bucket", "_part").drop("_part")
    dealt.write.partitionBy("_bucket").parquet(fresh)
    touch(spark, f"{old}/_begun")
    for name in many:
        rename(spark, f"{table}/{name}", f"{old}/{name}")
        rename(spark, f"{fresh}/{name}", f"{table}/{name}")
    delete(spark, old)
    delete(spark, fresh)
    return len(many)
