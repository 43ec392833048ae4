"""State machines over streams: crawls from pages in any order, and the earliest event of each key."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.catalog import bindings as b
from adloom.catalog import ingest
from adloom.session import staging_path
from adloom.streaming.stateful import crawl_prefix_stream, first_by_time_stream

#: Files that pages are dealt over, out of order, and the days by which rows may be late: more than the tables span.
FILES, LATE = 6, 20_000


def _crawl_prefix(s, f):
    """Pages in shuffled batches; the query is stopped after the first files and started again when there are more."""
    path = staging_path(s, "pages")
    number = F.make_dt_interval(F.lit(0), F.lit(0), F.col("page_num").cast("int"))
    log = b.crawl_log(s, f).withColumn("ts", F.lit(b.RUN_TIME).cast("timestamp") + number)
    part = F.pmod(F.xxhash64("crawl_id", "page_num"), F.lit(FILES))
    for half in (part < FILES // 2, part >= FILES // 2):
        log.filter(half).repartition(FILES // 2, part).write.mode("append").parquet(f"{path}/in")
        stream = s.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
        reached = crawl_prefix_stream(stream, f"{LATE} days", 86_400 * LATE)
        writer = reached.writeStream.format("parquet").option("checkpointLocation", f"{path}/state")
        writer.trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return s.read.parquet(f"{path}/out").select("crawl_id", "page_num", "n_links", "fp")


def _first_by_time(s, f):
    """Events in shuffled batches; a last row without key, far ahead, tells that all have come."""
    path = staging_path(s, "events")
    key = F.concat_ws("-", F.col("user_id"), F.col("event_type"))
    events = b.table(s, f, "events").select(key.alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    # Two batches of files, and a task for each core to read one.
    half = max(FILES // 2, s.sparkContext.defaultParallelism)
    events.repartition(2 * half, F.xxhash64("event_id")).write.parquet(f"{path}/in")
    ahead = (F.max("ts") + F.make_dt_interval(F.lit(LATE + 1))).alias("ts")
    last = events.agg(ahead).select(F.lit(None).cast("string").alias("id"), "ts", F.lit(-1).cast("long").alias("event_id"))
    last.write.mode("append").parquet(f"{path}/in")
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", half).parquet(f"{path}/in")
    first = first_by_time_stream(stream, "id", "ts", "event_id", f"{LATE} days", 86_400 * LATE)
    writer = first.writeStream.format("parquet").option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return s.read.parquet(f"{path}/out").filter("id IS NOT NULL").select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


QUERIES = {"stream_crawl_prefix": _crawl_prefix, "stream_first_by_time": _first_by_time}

ORACLE = {
    "stream_crawl_prefix": ingest.ORACLE["crawl_prefix"],
    "stream_first_by_time": """SELECT user_id || '-' || event_type AS id, ts, event_id FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
}
