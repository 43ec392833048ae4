"""Best-fit packing of tokenised documents into sequences of a fixed length (best-two-fit)."""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.llm.texts import map_rows
from adloom.session import materialize, spread

#: Shards of every piece length in which pieces are numbered; a length may be that of most pieces.
SHARDS = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_two_fit(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Fill bins of `limit` from `counts` of each length: (lengths in a bin, number of such bins).

    A bin takes the longest piece that fits until none does. Then its shortest piece gives way to the two
    unpacked pieces that fill the gap it leaves best, if they fill it better than it did. What goes into a bin depends
    only on which lengths are left, so equal bins are made at once: the work follows the number of lengths,
    which `limit` bounds, and not the number of pieces.
    """
    left = {size: n for size, n in counts.items() if n > 0}
    if any(not 0 < size <= limit for size in left):
        raise ValueError("piece lengths must lie between 1 and the limit")
    bins = []
    while left:
        sizes = sorted(left)
        taken: Counter[int] = Counter()

        def fitting(room: int) -> int:
            k = bisect_right(sizes, room) - 1
            while k >= 0 and taken[sizes[k]] >= left[sizes[k]]:
                k -= 1
            return sizes[k] if k >= 0 else 0

        bin_, gap = [], limit
        while size := fitting(gap):
            bin_.append(size)
            taken[size] += 1
            gap -= size
        if gap and len(bin_) > 1:
            shortest, best = bin_[-1], (bin_[-1], 0, 0)
            free = [s for s in sizes if s < gap + shortest and left[s] > taken[s]]
            low, high = 0, len(free) - 1
            while low <= high:
                both = free[low] + free[high]
                if both > gap + shortest:
                    high -= 1
                    continue
                if both > best[0] and (low < high or left[free[low]] - taken[free[low]] > 1):
                    best = (both, free[high], free[low])
                low += 1
            if best[1]:
                taken[shortest] -= 1
                bin_[-1:] = best[1:]
                taken.update(best[1:])
        times = min(left[size] // n for size, n in taken.items() if n)
        bins.append((tuple(bin_), times))
        for size, n in taken.items():
            left[size] -= n * times
            if not left[size]:
                del left[size]
    return bins


def slots(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first number, last number, in a bin, first sequence, offset).

    Pieces of a length are numbered from 0. Those from first to last fill sequences from the first one on, so many to each.
    """
    seen: Counter[int] = Counter()
    rows, sequence = [], 0
    for bin_, times in bins:
        offset = 0
        for size, n in Counter(bin_).items():
            rows.append((size, seen[size], seen[size] + n * times - 1, n, sequence, offset))
            seen[size] += n * times
            offset += n * size
        sequence += times
    return rows


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, the ids being those of the `tokenizers` library.

    A byte-level vocabulary whose merges are numbered in their order says by the number of a token which merge comes
    first, so `tiktoken` gives the same ids in a quarter of the time; tests compare the two over all code points. Texts
    with a control token of the vocabulary, and vocabularies of another kind, go through `tokenizers` itself. Nothing is
    remembered from text to text.
    """

    # Fixed value: how a byte-level vocabulary cuts a text before it merges.
    CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        special = [x["content"] for x in found.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.fast = None
        if _in_merge_order(found):
            ranks = {_bytes_of(x): k for x, k in found["model"]["vocab"].items() if x not in special}
            self.fast = tiktoken.Encoding(path, pat_str=self.CUT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        fast, special = self.fast, self.special
        if fast is None:
            return [_packed(x.ids) for x in self.plain.encode_batch(texts, add_special_tokens=False)]
        return [
            _packed(
                self.plain.encode(x, add_special_tokens=False).ids if special.search(x) else fast.encode_ordinary(x)
            )
            for x in texts
        ]


def _in_merge_order(found: dict) -> bool:
    """Whether a vocabulary file is byte-level and no more, with tokens numbered as their merges come."""
    model, before = found["model"], found.get("pre_tokenizer") or {}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if model.get("type", "BPE") != "BPE" or not byte_level or found.get("normalizer") or any(map(model.get, options)):
        return False
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    return all(a < b for a, b in pairwise(made))


def _bytes_of(token: str) -> bytes:
    """A token of a byte-level vocabulary as bytes: visible letters stay, all others follow from 256 on."""
    return bytes(map(_LETTERS.__getitem__, token))


_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = {chr(b): b for b in _VISIBLE}
_LETTERS |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)).difference(_VISIBLE)))}


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, read once by each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, end_id: int = 2) -> DataFrame:
    """Documents as token pieces of at most `limit`, each document closed by `end_id`.

    A longer document is cut into pieces of `limit` tokens; what is over comes first. `ids_crc32` is that of the ids
    as little-endian unsigned 32-bit numbers. A null text is empty, so the piece holds `end_id` alone.
    """

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        encode, end = encoder(public_tokenizers.path(vocabulary)).encode, end_id.to_bytes(4, "little")
        for part in slices:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc_id, ids in zip(part["doc_id"], encode([x or "" for x in part["text"]]), strict=True):
                ids += end
                total = len(ids) // 4
                starts = [0, *range((total - 1) % limit + 1, total, limit)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], total], strict=True)):
                    for name, v in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        out[name].append(v)
            yield out

    return map_rows(docs.select("doc_id", "text"), PIECES, rows)


def pack(cut: DataFrame, limit: int = 1024, shards: int = SHARDS) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces with a `length`; sequences hold at most `limit` tokens without gaps.

    Only the count of each length reaches the driver, at most `limit` numbers. Pieces of a length are numbered in shards,
    so no task gets a length whole, and find their place in the small table of `slots`. `cut` is read three times.
    """
    spark = cut.sparkSession
    keys = [c for c in ("doc_id", "piece") if c in cut.columns]
    rows = cut.withColumn("_shard", F.pmod(F.xxhash64(*keys), F.lit(shards)))
    counts = rows.groupBy("length", "_shard").agg(F.count("*").alias("_n"))
    total = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    places = spark.createDataFrame(
        slots(best_two_fit(total, limit)),
        "length long, _first long, _last long, _each long, _sequence long, _offset long",
    )
    before = W.partitionBy("length").orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("length", "_shard").orderBy(*keys)
    numbered = rows.withColumn("_rank", F.row_number().over(inside))
    # Both sides are bounded: limit * shards counts, and a few slots for each of at most limit lengths.
    numbered = numbered.join(F.broadcast(bases), ["length", "_shard"])
    numbered = numbered.withColumn("_rank", F.col("_rank") - 1 + F.col("_base"))
    found = numbered.join(
        F.broadcast(places.withColumnRenamed("length", "_length")),
        (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last")),
    )
    at = F.col("_rank") - F.col("_first")
    return found.select(
        *cut.columns,
        (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty; repeated rows are packed as often as they come; a null doc_id stays null; no rows give
    none. Other columns are left out. The pieces are written to the shared folder, so texts are encoded once.
    """
    cut = materialize(pieces(spread(docs.select("doc_id", "text")), vocabulary, limit), "pieces")
    return pack(cut, limit)


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_best_fit_packing": packing_query}
ORACLE: dict[str, str] = {}
