"""Web archives: pages written as WARC files with revisits, read back, and their indexes merged in URL order."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adloom.llm.texts import ROWS
from adloom.operators.ordering import ranges_of
from adloom.session import materialize, staging_path

# Payloads from this size on are stored once, and the profile of records that stand for others.
SHARED_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

#: Records in a file, which one task reads.
RECORDS = 5000

#: Captures that a merging task holds, about; ranges are as many as that takes.
RANGE_ROWS = 250_000

#: Captures of a run that a merging task has as objects at once.
HEAD_ROWS = 32

#: `start` and `length` tell where a record lies in its archive once that is unpacked.
INDEX = (
    "url_key string, captured_at string, page_id long, url string, record_type string, payload_digest string, "
    "payload_bytes long, refers_to long, file string, record int, start long, length long"
)


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value. Line ends inside a value would end the header, so they are escaped."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """A WARC record for each page as the text `value`, without the blank lines that close it.

    Of pages with equal payloads of `SHARED_BYTES` or more, the one with the largest page_id is a response and the others
    are revisits that name it; rows that repeat it are responses, too. A page without page_id is never named. The table
    has no capture times, so that of a page is counted from its page_id unless `captured` gives one.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    when = captured if captured is not None else F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + 1_700_000_000)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).alias("bytes"),
        F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    )
    large = rows.filter(F.col("bytes") >= SHARED_BYTES)
    first = large.groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    rows = rows.join(first.filter("n > 1").drop("n"), ["digest", "bytes"], "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "bytes", F.lit("\r\n\r\n")
    )
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name(F.col("page_id"))),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("WARC-Refers-To", F.when(revisit, name(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    body = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    return rows.select(F.concat(head, F.lit("Content-Length: "), F.octet_length(body), F.lit("\r\n\r\n"), body).alias("value"))


def write_archives(pages: DataFrame, path: str, captured: Column | None = None) -> None:
    """Write pages as gzipped WARC files into a folder of any file system Spark knows."""
    out = records(pages, captured).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    out.option("maxRecordsPerFile", RECORDS).text(path)


def url_key(url: str) -> str:
    """The key captures of one address share: host from its last label on, then path and query, without the fragment."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)", url)
    if not m:
        return url.split("#")[0]
    host, _, port = m[1].lower().partition(":")
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    return labels + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (m[2] or "/")


def _headers(stream: BinaryIO) -> tuple[dict[str, str], int]:
    """The header lines up to the blank one, by small name, and their bytes with the blank line."""
    found, size = {}, 0
    while line := stream.readline():
        size += len(line)
        if line == b"\r\n":
            break
        name, _, value = line.decode().rstrip("\r\n").partition(": ")
        found[name.lower()] = value
    return found, size


def read_archive(stream: BinaryIO, file: str) -> Iterator[tuple]:
    """The index rows of an archive in its own order; every payload is held alone and checked against its digest."""
    number = start = 0
    while line := stream.readline():
        if line != b"WARC/1.0\r\n":
            raise ValueError(f"{file}: no record where one should begin")
        head, head_bytes = _headers(stream)
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{file}: record {number} does not end where it should")
        http, _, payload = block.partition(b"\r\n\r\n")
        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{file}: record {number} is damaged")
        page, refers = (_page(head.get(name)) for name in ("warc-record-id", "warc-refers-to"))
        url = head.get("warc-target-uri")
        length = len(line) + head_bytes + len(block) + 4
        yield url_key(url or ""), head["warc-date"], page, url, kind, digest, size, refers, file, number, start, length
        number, start = number + 1, start + length


def _page(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def _order(row: tuple) -> tuple:
    """Index order: URL key, time, page (none first), then where the record lies."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each archive as a run sorted by URL key and time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = T._parse_datatype_string(INDEX)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream = gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))
                rows = sorted(read_archive(io.BufferedReader(stream), path.rpartition("/")[2]), key=_order)
                columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return files.mapInArrow(run, out)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so one path is replayed for each row."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(run) for run in runs]
        self.k = len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _next(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (_order(row), row)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) <= (y[0], b))

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head[1]
            i = self.winner
            self.heads[i] = self._next(i)
            node = (i + self.k) // 2
            while node:
                if self._before(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def _rows(run: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a run, a few as objects at a time."""
    for batch in run:
        for start in range(0, batch.num_rows, HEAD_ROWS):
            part = batch.slice(start, HEAD_ROWS)
            yield from zip(*[c.to_pylist() for c in part.columns], strict=True)


def _runs(batches: Iterator[pa.RecordBatch]) -> list[list[pa.RecordBatch]]:
    """Batches in order of their file, cut where it changes."""
    runs: list[list[pa.RecordBatch]] = []
    last = None
    for batch in batches:
        files = batch.column(batch.schema.get_field_index("file")).to_pylist()
        start = 0
        for k in range(1, len(files) + 1):
            if k == len(files) or files[k] != files[start]:
                if files[start] != last:
                    runs.append([])
                    last = files[start]
                runs[-1].append(batch.slice(start, k - start))
                start = k
    return runs


def merge_index(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in order of URL key and time: partition after partition, and within each; `part` and `nth` say where.

    Captures are dealt out by ranges of the whole order, so that a URL captured very often spreads over several
    partitions. Ranges are as many as the captures take, so a task holds about `range_rows` of them, packed as Arrow
    columns; the stretches of the runs that fall into its range come in sorted by Spark, and the tree reads a few rows of
    each at a time. `index` should be stored: it is read for its count, for the sample and for its rows.
    """
    order = ["url_key", "captured_at", "page_id", "file", "record"]
    names = [f.split()[0] for f in INDEX.split(", ")]
    dealt = index.select(*names).repartitionByRange(ranges_of(index, index.count(), range_rows), *order)
    out = T._parse_datatype_string(f"{INDEX}, part int, nth long")
    arrow = to_arrow_schema(out)

    def packed(rows: list[tuple], part: int, nth: int) -> pa.RecordBatch:
        columns = [*zip(*rows, strict=True), [part] * len(rows), range(nth, nth + len(rows))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held = TaskContext.get().partitionId(), 0, []
        for row in LoserTree([_rows(run) for run in _runs(batches)]):
            held.append(row)
            if len(held) == ROWS:
                yield packed(held, part, nth)
                held, nth = [], nth + ROWS
        if held:
            yield packed(held, part, nth)

    return dealt.sortWithinPartitions("file", *order).mapInArrow(merged, out)


def with_places(merged: DataFrame) -> DataFrame:
    """A merged index with the place of each capture in the whole order, `place` from 1; it is stored on the way.

    Captures are counted for each range, and a range starts where those before it end: one row for each range is summed.
    """
    stored = materialize(merged, "warc-merged")
    before = F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = stored.groupBy("part").agg(F.count("*").alias("_n"))
    starts = starts.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("nth") + 1).alias("place")
    return stored.join(starts, "part").select(*[F.col(c) for c in merged.columns if c not in ("part", "nth")], place)


def archived(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """Write pages to archives in the shared folder, read them back, and return their merged index.

    Null html is an empty payload, a null url an empty key, a null page_id stays null and comes first among captures of
    one time. Repeated rows have a record each, next to each other; no rows give none, other columns are left out.
    """
    spark = pages.sparkSession
    path = staging_path(spark, "warc")
    write_archives(pages, path, captured)
    return merge_index(materialize(archive_index(spark, path), "warc-index"))


def archive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its archive record tells, with its place in the capture history of all archives."""
    index = with_places(archived(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return index.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "place"
    )


SQL = f"""
WITH p AS (
    SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes,
        regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)', ['host', 'rest']) AS u,
        regexp_matches(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//') AS has_host,
        split_part(coalesce(url, ''), '#', 1) AS bare,
        strftime(make_timestamp((coalesce(page_id, 0) + 1700000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
    FROM pages
), h AS (
    SELECT *, regexp_replace(split_part(lower(u.host), ':', 1), '^www[.]', '') AS host,
        regexp_extract(lower(u.host), '^[^:]*:(.*)$', 1) AS port
    FROM p
), k AS (
    SELECT *, CASE WHEN has_host THEN array_to_string(list_reverse(string_split(host, '.')), ',')
        || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END
        || ')' || CASE WHEN u.rest = '' THEN '/' ELSE u.rest END ELSE bare END AS url_key
    FROM h
), f AS (
    SELECT payload_digest, payload_bytes, max(page_id) AS first FROM p
    WHERE payload_bytes >= {SHARED_BYTES} GROUP BY ALL HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to,
    url_key, captured_at, row_number() OVER (ORDER BY url_key, captured_at, page_id NULLS FIRST) AS place
FROM k LEFT JOIN f USING (payload_digest, payload_bytes)
"""

QUERIES = {"op8_warc_index_merge": archive_query}
ORACLE = {"op8_warc_index_merge": SQL}
