"""Streams with a state machine for each key: crawls whose pages arrive in any order, and the earliest ad of each key.

State lives in RocksDB on the executors and in the checkpoint, so a restart goes on where the last batch ended. A key's
state is let go by a timer in event time, once the watermark says that nothing of it can come any more.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PAGES = "crawl_id long, page_num long, n_links long, fp string"


def use_rocksdb(spark: SparkSession) -> None:
    """Let queries that start from now on keep their state in RocksDB, which state machines need."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


class CrawlPrefix(StatefulProcessor):
    """Follows one crawl: which page is expected next, the digest of the last one, and pages that came early."""

    def __init__(self, quiet_millis: int):
        self.quiet = quiet_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, last string, ended boolean, latest long")
        self.early = handle.getMapState("early", "page_num long", "n_links long, fp string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        expected, last, ended, latest = self.at.get() if self.at.exists() else (1, None, False, None)
        out: list[tuple] = []
        newest = latest
        for frame in rows:
            for number, n, fp, time in frame[["page_num", "n_links", "fp", "millis"]].itertuples(index=False):
                newest = int(time) if newest is None else max(int(time), newest)
                # A page that came twice counts once.
                if not ended and number >= expected and not self.early.containsKey((int(number),)):
                    self.early.updateValue((int(number),), (int(n), fp if isinstance(fp, str) else None))
            while not ended and self.early.containsKey((expected,)):
                page = self.early.getValue((expected,))
                self.early.removeKey((expected,))
                last, ended = self._take(key, expected, page, last, out)
                expected += 1
        if ended:
            self.early.clear()
        if newest != latest:
            if latest is not None:
                self.handle.deleteTimer(latest + self.quiet)
            self.handle.registerTimer(newest + self.quiet)
        self.at.update((expected, last, ended, newest))
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """No page for so long: those that wait for a missing one are taken as they are, and the crawl is forgotten."""
        _, last, ended, _ = self.at.get()
        waiting = sorted((k[0], tuple(v)) for k, v in self.early.iterator())
        out: list[tuple] = []
        for number, page in waiting:
            if ended:
                break
            last, ended = self._take(key, number, page, last, out)
        self.early.clear()
        self.at.clear()
        yield self._frame(out)

    @staticmethod
    def _take(key: Any, number: int, page: tuple, last: str | None, out: list[tuple]) -> tuple[str | None, bool]:
        n, fp = page
        if n == 0 or (number > 1 and fp is not None and fp == last):
            return last, True
        out.append((key[0], number, n, fp))
        return fp, False

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["crawl_id", "page_num", "n_links", "fp"])
        return frame.astype({"crawl_id": "int64", "page_num": "int64", "n_links": "int64"})

    def close(self) -> None:
        pass


def crawl_prefix_stream(pages: DataFrame, delay: str, quiet_seconds: int) -> DataFrame:
    """The pages that crawls get to, each given out once all pages before it have come.

    `pages` is a stream of crawl_id, page_num (from 1), n_links, fp and ts, in any order; pages that come later than
    `delay` behind the newest are dropped by the watermark, a page that comes twice counts once. A crawl ends before its first empty
    page and before the first that repeats the one before it. One of which no page comes for `quiet_seconds` of event time
    is closed: pages behind a gap are then taken as if there were none. Early pages are held in the state store, those
    of a crawl one by one, so a crawl with very many pages takes no more memory than others.
    """
    use_rocksdb(pages.sparkSession)
    rows = pages.select(
        F.col("crawl_id").cast("long"), F.col("page_num").cast("long"), F.col("n_links").cast("long"), "fp",
        F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"),
    ).withWatermark("ts", delay)
    return rows.groupBy("crawl_id").transformWithStateInPandas(
        CrawlPrefix(quiet_seconds * 1000), T._parse_datatype_string(PAGES), "Append", "EventTime"
    )


class Earliest(StatefulProcessor):
    """Holds the earliest row of each key of a bucket until the watermark has passed it, and remembers the key a while after.

    The keys of a bucket are one value of the state store, which is read and written once in a batch, and share a timer,
    set to the first of them that is due: a call to the store costs far more than a key.
    """

    def __init__(self, schema: T.StructType, key: str, time: str, order: str, horizon_millis: int):
        self.horizon = horizon_millis
        self.row = Row(*schema.names)
        self.key, self.time, self.order, self.at = (schema.names.index(c) for c in (key, time, order, "_at"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "timer long, keys binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        timer, keys = self._read()
        for row in rows:
            name = row[self.key]
            known = keys.get(name)
            if known is None or (known[1] is not None and self._before(row, known[1])):
                keys[name] = (row[self.at], tuple(row[: len(self.row)]))
        if any(at is None for at, _ in keys.values()):
            raise ValueError("no row of a key has a time")
        self._write(timer, keys)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        _, keys = self._read()
        out: list[tuple] = []
        for name, (at, best) in list(keys.items()):
            due = self._due(at, best)
            if due > fired and due >= now:
                continue
            if best is not None:
                out.append(best)
            if best is None or self.horizon <= 0:
                del keys[name]
            else:
                keys[name] = (at, None)
        # The timer that fired goes by itself.
        self._write(None, keys)
        return (self.row(*best) for best in out)

    def close(self) -> None:
        pass

    def _before(self, row: tuple, other: tuple) -> bool:
        """Whether a row comes before another of its key; nulls come last."""
        at, then = row[self.at], other[self.at]
        if at is not None and then is not None and at != then:
            return at < then
        return [(row[c] is None, row[c]) for c in (self.time, self.order)] < [(other[c] is None, other[c]) for c in (self.time, self.order)]

    def _due(self, at: int, best: tuple | None) -> int:
        return at if best is not None else at + self.horizon

    def _read(self) -> tuple[int | None, dict[Any, tuple]]:
        """The bucket's timer, and of each key its earliest time and, until that is given out, its earliest row."""
        if not self.held.exists():
            return None, {}
        timer, keys = self.held.get()
        return timer, pickle.loads(keys)

    def _write(self, timer: int | None, keys: dict[Any, tuple]) -> None:
        if not keys:
            self.held.clear()
            return
        first = min(self._due(at, best) for at, best in keys.values())
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.held.update((first, pickle.dumps(keys, pickle.HIGHEST_PROTOCOL)))


#: Buckets that the keys of a stream are dealt into; the state of one is held by a task as objects, so it should fit there.
BUCKETS = 1024


def first_by_time_stream(
    stream: DataFrame, key: str, time: str, order: str, delay: str, horizon_seconds: int, buckets: int = BUCKETS
) -> DataFrame:
    """The earliest row of each key by event time (ties by `order`), given out once the watermark has passed it.

    `dedup.first_seen_stream` keeps the first row to arrive instead. Rows later than `delay` behind the newest are
    dropped; a key is remembered for `horizon_seconds` behind its earliest row, one that comes back after that is new. A first pass keeps the
    earliest row of a key in each task of a batch, so a hot key reaches its state as a few rows. Rows without key share
    the null key. `buckets` is fixed with the first start of a query; a batch rewrites the buckets that its keys fall into.
    """
    use_rocksdb(stream.sparkSession)
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("_at", F.unix_millis(time)).withWatermark(time, delay)
    machine = Earliest(timed.schema, key, time, order, horizon_seconds * 1000)
    thinned = _thinned(timed, key, time, order).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    return thinned.groupBy("_bucket").transformWithState(machine, timed.schema, "Append", "EventTime").drop("_at")


def _thinned(timed: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """The earliest row of each key in each Arrow batch of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = pc.sort_indices(batch, sort_keys=[(time, "ascending"), (order, "ascending")])
            ranked = pa.table({"key": batch.column(key).take(rank), "at": pa.array(range(batch.num_rows), pa.int64())})
            first = ranked.group_by("key", use_threads=False).aggregate([("at", "min")])["at_min"].combine_chunks()
            yield batch.take(rank.take(first))

    return timed.mapInArrow(run, timed.schema)
