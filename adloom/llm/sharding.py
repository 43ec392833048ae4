"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `nodes` points on a ring of 64-bit hashes, and a row belongs to the first point clockwise from the hash
of its doc_id. A shard that is full passes rows on: they continue clockwise to the next point whose shard has room.
Which rows go on is decided arc by arc (the rows between two points), from the number of rows of each arc alone: a table
of at most shards times nodes rows, whatever the input. Within its arc a row has a rank, worked out in ranges of the ring,
and its rank says how far it goes.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.operators import ordering
from adloom.session import materialize

#: Points of each shard on the ring.
NODES = 128

#: The ring is cut into this many equal parts to look up arcs.
PARTS = 1024

LAWS = ("rows", "bytes", "key")

# The order of rows on the ring; rows alike in the first four are alike altogether, the last one tells them apart.
_ORDER = ["_point", "doc_id", "size", "text_crc32", "_row"]


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """The points of all shards in ring order: (hash as a signed number, shard).

    A shard's points are its own, so one more shard adds points and moves none.
    """
    points = sorted({xxhash.xxh64_intdigest(f"shard {s}, node {k}") - (1 << 63): s
                     for s in reversed(range(shards)) for k in range(nodes)}.items())
    return points


def segments(points: list[tuple[int, int]], parts: int = PARTS) -> list[tuple[int, int, int, int]]:
    """The ring as (part, first hash, last hash, arc); an arc ends at its point, those behind the last one are of the first."""
    ends, width, out = [p for p, _ in points], (1 << 64) // parts, []
    for part in range(parts):
        low = part * width - (1 << 63)
        high = low + width - 1
        while low <= high:
            arc = bisect_left(ends, low)
            end = min(high, ends[arc]) if arc < len(ends) else high
            out.append((part, low, end, arc % len(ends)))
            low = end + 1
    return out


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """The load each shard may take. Without slack they add up to the total and differ by one at most."""
    if slack:
        return [math.ceil(total * (1 + slack) / shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def passed_on(loads: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Where the load of each arc goes: (arc, from, to, shard), positions within the arc, `to` excluded.

    All arcs first offer their load to the shard of their own point, in ring order. What it has no room for goes on to
    the next point, again in ring order, and so on, at most once around.
    """
    room, out = list(room), []
    waiting = [(arc, arc, 0, loads[arc]) for arc in sorted(loads) if loads[arc]]
    while waiting:
        onward = []
        for arc, at, start, left in waiting:
            shard = points[at][1]
            taken = min(left, room[shard])
            if taken:
                room[shard] -= taken
                out.append((arc, start, start + taken, shard))
            if left > taken:
                onward.append((arc, (at + 1) % len(points), start + taken, left - taken))
        waiting = onward
    return out


def _with_arc(rows: DataFrame, points: list[tuple[int, int]], name: str) -> DataFrame:
    spark = rows.sparkSession
    cut = spark.createDataFrame(segments(points), f"_part int, _low long, _high long, {name} int")
    part = F.shiftright(F.col("_point"), 64 - int(math.log2(PARTS))).cast("int") + PARTS // 2
    # At most PARTS rows and one for each point.
    found = rows.withColumn("_part", part).join(F.broadcast(cut), "_part")
    return found.filter(F.col("_point").between(F.col("_low"), F.col("_high"))).drop("_part", "_low", "_high")


def _owner(points: list[tuple[int, int]], arc: str) -> Column:
    return F.element_at(F.array(*[F.lit(s) for _, s in points]), F.col(arc) + 1)


def sharded(
    docs: DataFrame, shards: int = 8, law: str = "rows", slack: float = 0.0, nodes: int = NODES, text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    `size` is the UTF-8 bytes of the text plus 1. By `rows`, a shard takes no more rows than its share times 1 + slack,
    and without slack counts differ by one at most. By `bytes`, the same holds for the sum of sizes, but for the one
    document that reaches the bound on each arc. With slack, a further shard moves few rows besides those it takes; without it, full shards
    pass on more. By `key` no shard is ever full: doc_id and the number of shards decide, and `grown_shard`, null by
    the other laws, is the shard if there were one more. `slot` numbers the rows of a shard from 0 without gaps.

    A null text is empty, so its size is 1; rows without doc_id share one place on the ring and are passed on like others; repeated
    rows are told apart and each gets a slot of its own; equal texts are not kept together, as a group of copies may be
    a third of all rows; no rows give none; other columns are left out. Narrow rows are written to the shared folder.
    """
    if law not in LAWS or shards < 1 or slack < 0:
        raise ValueError(f"a law is one of {LAWS}, shards are at least 1, slack at least 0")
    points = ring(shards, nodes)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id").alias("_point"),
    )
    rows = materialize(_with_arc(rows, points, "_arc").withColumn("_row", F.monotonically_increasing_id()), "keys")
    weight = F.lit(1).cast("long") if law != "bytes" else F.col("size")
    grown = F.lit(None).cast("int")
    if law == "key":
        rows = _with_arc(rows, ring(shards + 1, nodes), "_grown")
        grown = _owner(ring(shards + 1, nodes), "_grown")
    loads = {r[0]: r[1] for r in rows.groupBy("_arc").agg(F.sum(weight)).collect()}  # one number for each point
    total = sum(loads.values())
    room = [total] * shards if law == "key" else capacities(total, shards, slack)
    plan = [(k, *cell) for k, cell in enumerate(passed_on(loads, points, room))]
    cells = rows.sparkSession.createDataFrame(plan, "_cell int, _arc int, _from long, _to long, shard int")

    run = ordering.running_totals(
        rows, _ORDER, {"_rank": F.lit(1).cast("long"), "_load": weight}, ["_arc"], range_rows=100_000
    )
    start = F.col("_load") - weight
    # A few cells for each arc: bounded by shards times nodes.
    placed = run.join(F.broadcast(cells), "_arc").filter((F.col("_from") <= start) & (start < F.col("_to")))
    placed = materialize(placed.select(*rows.columns, "_rank", "_cell", "shard"), "placed")
    sizes = placed.groupBy("_cell", "shard").agg(F.count("*").alias("n"), F.min("_rank").alias("first")).collect()
    bases, filled = [], [0] * shards
    for cell, shard, n, first in sorted(sizes):
        bases.append((cell, filled[shard] - first))
        filled[shard] += n
    offsets = rows.sparkSession.createDataFrame(bases, "_cell int, _base long")
    return placed.join(F.broadcast(offsets), "_cell").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(law).alias("law"),
        "shard",
        (F.col("_rank") + F.col("_base")).alias("slot"),
        grown.alias("grown_shard"),
    )


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal numbers of rows."""
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_bounded_load_ring": sharding_query}
ORACLE: dict[str, str] = {}
