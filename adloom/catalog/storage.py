"""Scans and sinks, and streams that end in a stored table."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.catalog import bindings as b
from adloom.schema import ADS_COLUMNS
from adloom.session import staging_path
from adloom.sources import ads as src
from adloom.streaming.dedup import append_unseen, first_seen_stream


def _scan(s, f):
    path = staging_path(s, "ads")
    src.write_csv(b.ads(s, f), path)
    return src.read_csv(s, path)


def _mixed(s, f):
    path = staging_path(s, "mixed")
    src.write_csv(b.stored(s, f), path)
    src.write_csv(b.ads(s, f).filter((F.col("pos") - 2) % 3 != 0), path, "append", header=False)
    return src.read_mixed_headers(s, path)


def _positions(s, f):
    """Records of files that are in position order, numbered by the scan."""
    path = staging_path(s, "positions")
    narrow = b.ads(s, f).select("pos", "id", "title")
    src.write_csv(narrow.repartitionByRange("pos").sortWithinPartitions("pos"), path)
    return src.read_csv(s, path, positions=True).select("pos", "id", "title")


def _roundtrip(s, f):
    """What comes back from a second writing of what came back from the first."""
    first, second = staging_path(s, "first"), staging_path(s, "second")
    src.write_csv(b.ads(s, f).drop("pos"), first)
    src.write_csv(src.read_csv_columns(s, first), second)
    return src.read_csv(s, second, quarantine=True).filter("_bad IS NULL").select(*ADS_COLUMNS)


def _missing(s, f):
    """What arrives where nothing is stored yet: a missing table reads as an empty one."""
    nothing = src.read_csv(s, staging_path(s, "missing"))
    fresh = b.ads(s, f).select("pos", "id").join(nothing.select("id"), "id", "left_anti")
    return fresh.select("pos", "id")


def _event_stream(s, f):
    events = b.table(s, f, "events")
    stream = src.stream_parquet(s, f"{f}/events.parquet", events.schema)
    key = F.concat_ws("-", F.col("user_id"), F.col("event_type"))
    return stream.select(key.alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def _stream_dedup(s, f):
    path = staging_path(s, "stream")
    seen = first_seen_stream(_event_stream(s, f), ["id"], "ts", "30 days")
    writer = seen.select("id").writeStream.format("parquet").option("checkpointLocation", f"{path}.state")
    writer.trigger(availableNow=True).start(path).awaitTermination()
    return s.read.parquet(path)


def _stream_incremental(s, f):
    path = staging_path(s, "stored")
    append_unseen(_event_stream(s, f), path, "id", "event_id", f"{path}.state").awaitTermination()
    return s.read.parquet(path).select("id")


QUERIES = {
    "scan_ads": _scan,
    "mixed_header_scan": _mixed,
    "missing_input": _missing,
    "record_positions": _positions,
    "sink_roundtrip": _roundtrip,
    "stream_dedup": _stream_dedup,
    "stream_incremental": _stream_incremental,
}

_ALL = f"WITH {b.ADS} SELECT {b.ADS_LIST} FROM ads"
_KEYS = "SELECT DISTINCT user_id || '-' || event_type AS id FROM events"

ORACLE = {
    "scan_ads": _ALL,
    "mixed_header_scan": _ALL,
    "missing_input": f"WITH {b.ADS} SELECT pos, id FROM ads",
    "record_positions": f"WITH {b.ADS} SELECT pos, id, title FROM ads",
    "sink_roundtrip": _ALL,
    "stream_dedup": _KEYS,
    "stream_incremental": _KEYS,
}
