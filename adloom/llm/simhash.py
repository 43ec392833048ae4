"""Near copies by SimHash fingerprints, with pigeonring filtering of the pairs that are compared."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.llm.components import components
from adloom.llm.texts import map_rows
from adloom.session import materialize, spread

BITS, SEGMENTS, DISTANCE = 64, 8, 4

#: Segments of the part of a chain that makes the key: 5 give 40 keys of 24 equal bits, 8 give more of 32 bits.
CHAIN = 5

#: Fingerprints with one key that one task compares; larger sets are dealt out by pairs of their parts.
BLOCK = 20_000


def fingerprint(text: str | None, size: int = 4) -> int:
    """The SimHash of the shingles of a text: a bit is set if it is in over half their XXH64, seed 42."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z, space and the controls 9 to 13 count
    if not words:
        return 0
    shingles = [words] if len(words) < size else zip(*(words[k:] for k in range(size)), strict=False)
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, `print` (a hash of the text, null for null) and `fp`, the fingerprint as a signed long. No words give zero."""

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in slices:
            made = np.array([fingerprint(x, size) for x in part["text"]], np.uint64)
            yield {"doc_id": part["doc_id"], "print": part["print"], "fp": made.view(np.int64).tolist()}

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_print("text").alias("print"), "text")
    return map_rows(named, "doc_id long, print long, fp long", rows)


def text_print(text: str) -> Column:
    """A hash that tells texts apart; null is its own."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))


def budgets(segments: int = SEGMENTS, distance: int = DISTANCE) -> list[int]:
    """How many bits may differ in the first 1, 2, ... segments of a chain."""
    return [length * distance // segments for length in range(1, segments + 1)]


def prefixes(segments: int = SEGMENTS) -> list[list[int]]:
    """For each start, the masks of the first 1, 2, ... consecutive segments, going round."""
    width = BITS // segments
    single = [((1 << width) - 1) << (width * k) for k in range(segments)]
    return [
        [sum(single[(start + k) % segments] for k in range(length)) for length in range(1, segments + 1)]
        for start in range(segments)
    ]


def key_masks(segments: int = SEGMENTS, distance: int = DISTANCE, chain: int = CHAIN) -> list[tuple[int, int]]:
    """Start of a chain and mask of the bits that must be equal, for all ways a chain can keep within its budgets.

    If fingerprints differ in at most `distance` bits, then from some segment on, going round, the differences of
    the first 1, 2, ... segments add up to no more than their share of it. Those budgets leave so few differing segments
    among the first `chain` that some of these sets of segments are equal throughout.
    """
    limits, width = budgets(segments, distance), BITS // segments
    allowed = [
        frozenset(k for k in range(chain) if not d[k])
        for d in product((0, 1), repeat=chain)
        if all(sum(d[: k + 1]) <= limits[k] for k in range(chain))
    ]
    least = [zeros for zeros in allowed if not any(other < zeros for other in allowed)]
    segment = ((1 << width) - 1).__lshift__
    return [
        (start, sum(segment(width * ((start + k) % segments)) for k in zeros))
        for start in range(segments)
        for zeros in sorted(least, key=sorted)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _within(x: np.ndarray, start: int, chains: list[np.ndarray], limits: list[int]) -> np.ndarray:
    """Which of the differences `x` keep within all budgets of the chain; its last prefix is the whole fingerprint."""
    left = np.arange(len(x))
    for mask, limit in zip(chains[start], limits, strict=True):
        left = left[np.bitwise_count(x[left] & mask) <= limit]
    return left


def _linked(block: np.ndarray, start: int, chains: list[np.ndarray], limits: list[int]) -> Iterator[tuple]:
    """Links that connect what is linked in a block: from each node found to those that no other has found yet."""
    apart = np.arange(len(block))
    while len(apart):
        reached, apart = [apart[0]], apart[1:]
        while reached and len(apart):
            node = reached.pop()
            found = _within(block[apart] ^ block[node], start, chains, limits)
            if len(found):
                reached.extend(apart[found])
                yield np.full(len(found), block[node]), block[apart[found]]
                apart = np.delete(apart, found)


def links(prints: DataFrame, chain: int = CHAIN, block: int = BLOCK) -> DataFrame:
    """Links between distinct fingerprints that connect all which differ in at most `DISTANCE` bits: a, b.

    A fingerprint goes to one block for each key. In a block no pairs are written: a search from fingerprint to
    fingerprint gives a spanning forest of its links. Sets of over `block` fingerprints with one key are cut into parts,
    and each pair of parts is a block of its own.
    """
    masks = key_masks(chain=chain)
    limits, chains = budgets(), [np.array(x, np.uint64) for x in prefixes()]
    keys = prints.select(
        "fp",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("pattern"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
                    for k, (_, mask) in enumerate(masks)
                ]
            )
        ),
    )
    large = keys.groupBy("pattern", "key").count().filter(F.col("count") > block)
    large = large.select("pattern", "key", F.ceil(2 * F.col("count") / block).cast("int").alias("parts"))
    rows = keys.join(large, ["pattern", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(own, k) * F.col("parts") + F.greatest(own, k)
    )
    rows = rows.select("pattern", "key", F.explode(cells).alias("cell"), "fp")
    dealt = rows.repartition("pattern", "key", "cell").sortWithinPartitions("pattern", "key", "cell")
    out = T._parse_datatype_string("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def made(part: list[np.ndarray], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            """The links of whole blocks; those of two are compared all at once."""
            pattern, fp = part[0], part[3].view(np.uint64)
            begins = np.concatenate(([0], ends[:-1]))
            sizes = ends - begins
            pairs = begins[sizes == 2]
            found = []
            for start in range(SEGMENTS):
                own = pairs[pattern[pairs] // (len(masks) // SEGMENTS) == start]
                ok = own[_within(fp[own] ^ fp[own + 1], start, chains, limits)]
                found.append((fp[ok], fp[ok + 1]))
            for a, b in zip(begins[sizes > 2], ends[sizes > 2], strict=True):
                found.extend(_linked(fp[a:b], masks[pattern[a]][0], chains, limits))
            ab = [np.concatenate(x).view(np.int64) for x in zip(*found, strict=True)]
            if len(ab[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ab], names=["a", "b"])

        for batch in batches:
            part = [batch.column(k).to_numpy() for k in range(4)]
            if held:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            changes = np.flatnonzero(np.any([x[1:] != x[:-1] for x in part[:3]], axis=0)) + 1
            if len(changes):
                yield from made([x[: changes[-1]] for x in part], changes)
                part = [x[changes[-1] :] for x in part]
            held = part
        if held and len(held[0]):
            yield from made(held, np.array([len(held[0])]))

    return dealt.mapInArrow(run, out)


def reached(docs: DataFrame, chain: int = CHAIN, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of documents and, for each different one, its component: stored tables."""
    prints = materialize(fingerprints(spread(docs.select("doc_id", "text"))), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = components(links(classes.select("fp"), chain, block)).withColumnRenamed("node", "fp")
    classes = classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return prints, materialize(classes, "reached")


def near_copies(docs: DataFrame, chain: int = CHAIN, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach, of every row.

    Equal fingerprints are one node of the search, so exact copies are never compared. Null and empty texts have the
    fingerprint zero and link like others; repeated rows stay; a null doc_id is never a component_id unless the whole
    component has none; no rows give none; other columns are left out.
    """
    prints, classes = reached(docs, chain, block)
    first = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = classes.select("fp", "component").join(first, "component").select("fp", "component_id")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", shown, "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns: the smallest doc_id (null comes last), then the smallest hash of the text.

    Rows are judged by doc_id and text, so a copy under the doc_id of another text goes, and so do copies without doc_id. Of rows equal in
    both any one stays. Only kept rows that come more than once are compared by their texts, all others are matched by doc_id and hash.
    """
    prints, classes = reached(docs)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    first = prints.groupBy("fp").agg(F.min(row).alias("row")).join(classes.select("fp", "component"), "fp")
    kept = first.groupBy("component").agg(F.min("row").alias("row")).select("row.doc_id", "row.print")
    times = prints.groupBy("doc_id", "print").agg(F.count("*").alias("_times"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("print").eqNullSafe(F.col("_print"))
    kept = kept.withColumnsRenamed({"doc_id": "_doc", "print": "_print"}).join(times, same).select("_doc", "_print", "_times")
    kept = materialize(kept, "kept")
    named = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("_doc")) & text_print("text").eqNullSafe(F.col("_print")))
    once = named.filter("_times = 1").select(*docs.columns)
    return once.unionByName(named.filter("_times > 1").dropDuplicates(["_doc", "_print", "text"]).select(*docs.columns))


def near_copies_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_simhash_pigeonring": near_copies_query}
ORACLE: dict[str, str] = {}
