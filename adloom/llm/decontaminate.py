"""Passages of a benchmark in documents, found by spaced seeds that skip fixed word positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.llm.texts import map_rows
from adloom.session import materialize

#: A passage counts where `LEAST` of `WINDOW` successive words agree, place by place.
WINDOW, LEAST = 13, 11

#: Shorter items count as a whole: from `LOOSE` words on one word may differ, below that none. Items of fewer than `SHORTEST`
#: words are common phrases, so they count only where they are all the words of a text.
LOOSE, SHORTEST = 8, 5

#: Places a seed looks at (1) and skips (0). Wherever at most two of 13 words differ, one of the first three seeds fits
#: somewhere among the words that agree. The last one finds items shorter than a window: of `LOOSE` words or more of which one
#: differs, four in a row agree.
SEEDS = ["111011101", "1110100111", "1001110111", "1111"]

#: The number that stands for the whole of a text of fewer than `SHORTEST` words in place of a seed.
WHOLE = len(SEEDS)

#: Bits of the filter that keeps positions which no item has a seed for from being written at all.
FILTER_BITS = 24

# Marks that are no part of the word they stand next to.
MARKS = ".,;:!?\"'()[]{}"

_FACTORS = [
    [xxhash.xxh64_intdigest(f"{seed} {k}") | 1 for k, place in enumerate(seed) if place == "1"] for seed in SEEDS
]
_PLACES = [[k for k, place in enumerate(seed) if place == "1"] for seed in SEEDS]

_ROWS = "id long, words long, pos long, seed int, hash long, around array<long>"


def plain_words(text: str | None) -> list[str]:
    """Words in small letters without the marks around them; marks alone are no words."""
    return [w for x in (text or "").lower().split() if (w := x.strip(MARKS))]


def word_hashes(text: str | None) -> np.ndarray:
    found = plain_words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def seed_hashes(hashes: np.ndarray, seed: int) -> np.ndarray:
    """The hash of the words a seed looks at, for each position it fits at."""
    n = len(hashes) - len(SEEDS[seed]) + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for place, factor in zip(_PLACES[seed], _FACTORS[seed], strict=True):
            out += hashes[place : place + n] * np.uint64(factor)
    return out


def whole_hash(hashes: np.ndarray) -> np.ndarray:
    """The hash of a text of fewer than `SHORTEST` words, of no word a hash that stands for nothing."""
    out = np.full(1, len(hashes), np.uint64)
    for word in hashes:
        out = (out ^ word) * np.uint64(_FACTORS[0][0])
    return out


def least_equal(words: int) -> int:
    """Words of the window of an item with so many words that have to agree."""
    return LEAST if words >= WINDOW else words - 1 if words >= LOOSE else words


def _around(hashes: np.ndarray, pos: int) -> list[int]:
    """The words a window with a seed at `pos` can hold: 12 before, itself, 12 after; zero outside the text."""
    out = np.zeros(2 * WINDOW - 1, np.uint64)
    low, high = max(0, pos - WINDOW + 1), min(len(hashes), pos + WINDOW)
    out[low - pos + WINDOW - 1 : high - pos + WINDOW - 1] = hashes[low:high]
    return out.view(np.int64).tolist()


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a hash in the filter."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(FILTER_BITS) & mask).astype(np.int64)


def seed_filter(items: DataFrame) -> bytes:
    """A bit map of the seeds of all items, 2 MB whatever their number; with more of them it lets more through."""
    out = T.StructType([T.StructField("bits", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            for slots in _slots(hashes):
                bits[slots] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()])], names=["bits"])

    whole = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in items.select("hash").coalesce(16).mapInArrow(run, out).toLocalIterator():
        whole |= np.frombuffer(row[0], np.uint8)
    return whole.tobytes()


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """All seeds of all items: id, words, pos, seed, hash, around."""

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        names = [f.split()[0] for f in _ROWS.split(", ")]
        for part in slices:
            out = []
            for item, text in zip(part["item_id"], part["text"], strict=True):
                hashes = word_hashes(text)
                n = len(hashes)
                if n == 0:
                    continue
                for seed in range(WHOLE - 1) if n >= WINDOW else [WHOLE - 1] if n >= SHORTEST else [WHOLE]:
                    made = (seed_hashes(hashes, seed) if seed < WHOLE else whole_hash(hashes)).view(np.int64)
                    for pos in range(len(made)) if n >= LOOSE else [0]:
                        out.append((item, n, pos, seed, int(made[pos]), _around(hashes, pos)))
            yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in names}

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return map_rows(items, _ROWS, rows)


def document_seeds(docs: DataFrame, bits: bytes) -> DataFrame:
    """The seeds of documents that the filter lets through: id, words, pos, seed, hash, around, print (a hash of the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        names = [f.split()[0] for f in schema.split(", ")]
        known = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        for part in slices:
            out = []
            for doc, made_of, text in zip(part["doc_id"], part["print"], part["text"], strict=True):
                hashes = word_hashes(text)
                for seed in range(WHOLE) if len(hashes) >= SHORTEST else [WHOLE] if len(hashes) else []:
                    made = seed_hashes(hashes, seed) if seed < WHOLE else whole_hash(hashes)
                    first, second = _slots(made)
                    some = np.flatnonzero(known[first])
                    for pos in some[known[second[some]]].tolist():
                        made_here = int(made[pos : pos + 1].view(np.int64)[0])
                        out.append((doc, len(hashes), pos, seed, made_here, _around(hashes, pos), made_of))
            yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in names}

    schema = f"{_ROWS}, print long"
    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text")
    return map_rows(rows_of, schema, rows)


OVERLAPS = "doc_id long, print long, item_id long, start long, length int"


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Windows of documents that agree with a window of an item: doc_id, print (of the text), item_id, start (in words), length.

    Only seeds that the filter lets through are written and dealt out to meet those of the items, so what moves follows
    the passages there are. A seed carries the words around it, and the windows it lies in are verified from those.
    """
    known = materialize(item_seeds(benchmark), "seeds")
    met = document_seeds(docs, seed_filter(known)).alias("d").join(known.alias("i"), ["seed", "hash"])
    met = met.select(
        "seed",
        F.col("d.id").alias("doc_id"),
        F.col("d.print").alias("print"),
        F.col("d.pos").alias("pos"),
        F.col("d.words").alias("long"),
        F.col("d.around").alias("here"),
        F.col("i.id").alias("item_id"),
        F.col("i.pos").alias("at"),
        F.col("i.words").alias("words"),
        F.col("i.around").alias("there"),
    )

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        names = [f.split()[0] for f in OVERLAPS.split(", ")]
        for part in slices:
            out = []
            for seed, doc, made_of, pos, long, here, item, at, words, there in zip(*part.values(), strict=True):
                size = min(WINDOW, words)
                least = least_equal(words)
                equal = np.concatenate(([0], np.cumsum(np.equal(here, there))))
                if seed == WHOLE and words != long:
                    continue
                for back in range(size - (len(SEEDS[seed]) if seed < WHOLE else size), -1, -1):
                    low = WINDOW - 1 - back
                    whole = 0 <= at - back <= words - size and 0 <= pos - back <= long - size
                    if whole and equal[low + size] - equal[low] >= least:
                        out.append((doc, made_of, item, pos - back, size))
            yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in names}

    return map_rows(met, OVERLAPS, rows).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold benchmark passages: doc_id, items (array of item_id), covered_words.

    Null and empty texts or items hold nothing; items of fewer than `SHORTEST` words are held by texts of just those words. Rows with one
    doc_id, null being one as well, are judged together; repeated items are one. No rows give none; other columns are
    left out.
    """
    found = materialize(overlaps(docs, benchmark), "overlaps")
    items = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    word = F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("word")
    covered = found.select("doc_id", word).distinct().groupBy("doc_id").agg(F.count("*").alias("covered_words"))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    return items.join(covered.withColumnRenamed("doc_id", "_id"), same).select("doc_id", "items", "covered_words")


def clean_documents(docs: DataFrame, benchmark: DataFrame, by_text: bool = False) -> DataFrame:
    """The documents without those that hold benchmark passages; all columns stay.

    Rows without a doc_id are judged by their own text each. Rows that share one are judged together, but `by_text` each
    by its own text, too.
    """
    found = materialize(overlaps(docs, benchmark), "overlaps")
    bad = found.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_print"))
    left = docs.join(bad, same, "left_anti")
    if by_text:
        return left
    named = bad.select("_id").distinct()
    return left.join(named, docs["doc_id"] == F.col("_id"), "left_anti")


def contamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it holds passages of."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("doc_id", "_id")
    joined = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"),
        F.coalesce("covered_words", F.lit(0)).alias("covered_words"),
    )


_WORDS = (
    r"list_filter(list_transform(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'), lambda w: trim(w, '"
    + MARKS.replace("'", "''")
    + "')), lambda w: w <> '')"
)
_FOUR = "ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] || ' ' || ws[k + 3]"

#: 11 of 13 words that agree hold four in a row, and so do all but one of 8 or more, which finds the candidates here.
SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL
), i AS (
    SELECT item_id, ws, least({WINDOW}, len(ws)) AS size,
        CASE WHEN len(ws) >= {WINDOW} THEN {LEAST} WHEN len(ws) >= {LOOSE} THEN len(ws) - 1 ELSE len(ws) END AS need
    FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL) WHERE len(ws) > 0
), di AS (
    SELECT r, k, {_FOUR} AS four FROM (SELECT r, ws, unnest(range(1, len(ws) - 2)) AS k FROM d)
), ii AS (
    SELECT item_id, k, {_FOUR} AS four FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 2)) AS k FROM i WHERE len(ws) >= {SHORTEST})
), diagonals AS (
    SELECT DISTINCT r, item_id, di.k - ii.k AS shift FROM di JOIN ii USING (four)
), windows AS (
    SELECT r, item_id, shift, size, need, i.ws AS iw, d.ws AS dw, unnest(range(1, len(i.ws) - size + 2)) AS s
    FROM diagonals JOIN i USING (item_id) JOIN d USING (r)
), hits AS (
    SELECT doc_id, item_id, s + shift AS pos, size FROM windows JOIN d USING (r)
    WHERE s + shift >= 1 AND s + shift + size - 1 <= len(dw)
        AND len(list_filter(range(0, size), lambda j: iw[s + j] = dw[s + shift + j])) >= need
    UNION ALL SELECT doc_id, item_id, 1, size FROM i JOIN d USING (ws) WHERE size < {SHORTEST}
), items AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS items
    FROM hits GROUP BY doc_id
), covered AS (
    SELECT doc_id, count(DISTINCT w) AS covered_words
    FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS w FROM hits) GROUP BY doc_id
)
SELECT documents.doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items,
    coalesce(covered_words, 0) AS covered_words
FROM documents LEFT JOIN items ON documents.doc_id IS NOT DISTINCT FROM items.doc_id
LEFT JOIN covered ON documents.doc_id IS NOT DISTINCT FROM covered.doc_id
"""

QUERIES = {"op4_spaced_seed_decontamination": contamination_query}
ORACLE = {"op4_spaced_seed_decontamination": SQL}
