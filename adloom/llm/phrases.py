"""Phrase collocations counted in HAT-tries: burstable hash containers under a shallow trie of word ids.

Each task counts the phrases of its texts in a trie. Its containers are hash tables; one that holds too many phrases bursts:
words that begin many of them get containers of their own, one level down. When all containers together are full, the
largest subtrees are written out whole, as runs sorted by their words, and counting goes on. The runs of a prefix meet
in partitions by lang and first word (a common first word has several), where Spark's aggregation merges them.

Phrases are counted level by level: one can only be as frequent as its parts. A filter of bounded size tells each task
which shorter phrases reached the least count; it may let others through, which the counts then drop, but never drops one.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adloom.llm.texts import small_batches
from adloom.session import materialize, spread

# What ends a piece, and what stands between words besides a space.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b"\t"

#: Ends of pieces while texts are split; no byte of UTF-8 has this value.
END = b"\xff"

_TABLE = bytes.maketrans(
    string.ascii_uppercase.encode() + BLANKS + ENDS, string.ascii_lowercase.encode() + b" " + END * len(ENDS)
)

#: Bits of a word id in the key of a phrase; three of them fit into 63 bits.
ID_BITS = 21
_ID = (1 << ID_BITS) - 1

#: Phrases in all containers of a task, words and bytes of words it has ids for, and phrases in a container before it bursts.
CAPACITY, WORDS, WORD_BYTES, BURST = 1_000_000, 600_000, 32 << 20, 32_768

#: Words counted at once, and bytes of a long text split at once.
WORDS_AT_ONCE, BYTES_AT_ONCE = 200_000, 1 << 20

#: Partitions over which the phrases of one first word are dealt.
SLOTS = 64

#: Most bits of a filter: 16 MB.
FILTER_BITS = 27

#: Runs travel as narrow rows: the words of a phrase and, behind the last space that is not its own, its lang.
COUNTED = "key string, n long"


class Node:
    """A container of phrases (key to count) and, below it, nodes of the words that burst out of it."""

    def __init__(self) -> None:
        self.counts: dict[int, int] = {}
        self.children: dict[int, Node] = {}
        self.limit = BURST

    def add(self, keys: np.ndarray, counts: np.ndarray, shift: int) -> int:
        """Count sorted different keys, which go on at `shift` below this node; returns how many are new."""
        new = 0
        if self.children:
            words = (keys >> shift) & _ID
            own = np.fromiter(self.children, np.int64, len(self.children))
            rest = np.ones(len(keys), bool)
            starts, ends = np.searchsorted(words, own, "left"), np.searchsorted(words, own, "right")
            for word, a, b in zip(own.tolist(), starts.tolist(), ends.tolist(), strict=True):
                if a < b:
                    new += self.children[word].add(keys[a:b], counts[a:b], shift - ID_BITS)
                    rest[a:b] = False
            keys, counts = keys[rest], counts[rest]
        mine, before = self.counts, len(self.counts)
        for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
            mine[key] = mine.get(key, 0) + n
        new += len(mine) - before
        if len(mine) > self.limit and shift > 0:
            self.burst(shift)
        return new

    def burst(self, shift: int) -> None:
        """Give words that begin many of the phrases nodes of their own; the others stay."""
        keys = np.fromiter(self.counts, np.int64, len(self.counts))
        words, sizes = np.unique((keys >> shift) & _ID, return_counts=True)
        heavy = words[sizes >= min(max(BURST >> 4, 2), sizes.max())]
        for word in heavy.tolist():
            self.children.setdefault(word, Node())
        out = np.isin((keys >> shift) & _ID, heavy)
        for key in keys[out].tolist():
            self.children[key >> shift & _ID].counts[key] = self.counts.pop(key)
        self.limit = max(BURST, 2 * len(self.counts))

    def size(self) -> int:
        return len(self.counts) + sum(child.size() for child in self.children.values())

    def everything(self) -> Iterator[dict[int, int]]:
        yield self.counts
        for child in self.children.values():
            yield from child.everything()


class HatTrie:
    """Counts of phrases of up to `depth` words, given as keys of word ids."""

    def __init__(self, depth: int):
        self.depth, self.root, self.size = depth, Node(), 0

    def add(self, keys: np.ndarray) -> None:
        different, counts = np.unique(keys, return_counts=True)
        self.size += self.root.add(different, counts, ID_BITS * (self.depth - 1))

    def spill(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take out the largest subtrees until `least` phrases are left: the keys and counts of each."""
        root = self.root
        sizes = sorted(((child.size(), word) for word, child in root.children.items()), reverse=True)
        subtrees = [(n, root.children, word) for n, word in sizes]
        subtrees.append((len(root.counts), None, 0))
        for n, siblings, word in sorted(subtrees, key=lambda x: -x[0]):
            if self.size <= least:
                return
            self.size -= n
            node = siblings.pop(word) if siblings is not None else Node()
            if siblings is None:
                node.counts, root.counts, root.limit = root.counts, {}, BURST
            parts = list(node.everything())
            yield (
                np.concatenate([np.fromiter(p, np.int64, len(p)) for p in parts]),
                np.concatenate([np.fromiter(p.values(), np.int64, len(p)) for p in parts]),
            )


class _Ids(dict):
    """Ids of words; a new word gets the next one."""

    def __init__(self) -> None:
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


class Words:
    """Ids and hashes of words; id 0 is the end of a piece."""

    def __init__(self) -> None:
        self.ids = _Ids()
        self.words, self.hashes, self.bytes = self.ids.words, np.zeros(0, np.uint64), 0
        self([END])

    def __call__(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        fresh = self.words[len(self.hashes) :]
        if fresh:
            self.bytes += sum(map(len, fresh))
            hashes = [xxhash.xxh64_intdigest(w, 42) for w in fresh]
            self.hashes = np.concatenate([self.hashes, np.array(hashes, np.uint64)])
        return out

    def full(self) -> bool:
        return len(self.words) > WORDS or self.bytes > WORD_BYTES


def _rotated(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def _place(lang: str | None, *hashes: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its words; `_place_column` gives the same."""
    out = _rotated(np.array([xxhash.xxh64_intdigest((lang or "").encode(), 42)], np.uint64), 42)
    for k, h in enumerate(hashes):
        out = out ^ _rotated(h, 21 * k) if k else out ^ h
    return out


def _place_column(words: list[str]) -> Column:
    def rotated(h: Column, by: int) -> Column:
        return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))

    out = rotated(F.xxhash64("lang"), 42)
    for k, w in enumerate(words):
        out = out.bitwiseXOR(rotated(F.xxhash64(w), 21 * k) if k else F.xxhash64(w))
    return out


class Filter:
    """Bits of the hashes of phrases; says of every phrase put in, and of few others, that it is there."""

    def __init__(self, bits: int, maps: Iterable[tuple[int, bytes]]):
        self.mask = np.uint64((1 << bits) - 1)
        self.bytes = np.zeros((1 << bits) // 8, np.uint8)
        for number, data in maps:
            self.bytes[number * 4096 : (number + 1) * 4096] = np.frombuffer(data, np.uint8)

    def __call__(self, places: np.ndarray) -> np.ndarray:
        at = (places & self.mask).astype(np.int64)
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def filter_of(phrases: DataFrame, words: list[str]) -> Filter:
    """The filter of a table of phrases, 32 bits or more for each, within the bound."""
    bits = min(max((32 * phrases.count()).bit_length(), 15), FILTER_BITS)
    at = _place_column(words).bitwiseAND(F.lit((1 << bits) - 1))
    maps = phrases.select(F.shiftright(at, 15).alias("number"), at.bitwiseAND(F.lit(32767)).alias("bit"))
    return Filter(bits, maps.groupBy("number").agg(F.bitmap_construct_agg("bit")).collect())


def split(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-case, with an end behind each piece; a long text in several lists of whole pieces."""
    text = text.translate(_TABLE)
    start = 0
    while start < len(text):
        end = len(text) if len(text) - start <= BYTES_AT_ONCE else text.rfind(END, start, start + BYTES_AT_ONCE)
        if end < 0:
            end = text.find(END, start + BYTES_AT_ONCE)
        end = len(text) if end < 0 else end
        yield [*text[start:end].replace(END, b" \xff ").split(), END]
        start = end + 1


def _keys(ids: np.ndarray, hashes: np.ndarray, lang: str, depth: int, words: Filter | None, pairs: Filter | None) -> np.ndarray:
    """Keys of the phrases of `depth` words within pieces whose parts pass the filters."""
    if depth == 1:
        return ids[ids > 0]
    sound = ids > 0
    if words is not None:
        sound[sound] = words(_place(lang, hashes[ids[sound]]))
    both = sound[:-1] & sound[1:]
    if depth == 2:
        at = np.flatnonzero(both)
        return ids[at] << ID_BITS | ids[at + 1]
    if pairs is not None:
        at = np.flatnonzero(both)
        both[at] = pairs(_place(lang, hashes[ids[at]], hashes[ids[at + 1]]))
    at = np.flatnonzero(both[:-1] & both[1:])
    return ids[at] << 2 * ID_BITS | ids[at + 1] << ID_BITS | ids[at + 2]


def _run(lang: str, depth: int, words: list[bytes], keys: np.ndarray, counts: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """A sorted run: phrases in the order of their words with their counts."""
    columns = [(keys >> ID_BITS * (depth - 1 - k)) & _ID for k in range(depth)]
    used, places = np.unique(np.concatenate(columns), return_inverse=True)
    named = [words[i] for i in used.tolist()]
    order = sorted(range(len(named)), key=named.__getitem__)
    ranks = np.empty(len(named), np.int64)
    ranks[order] = np.arange(len(named))
    ranked = ranks[places].reshape(depth, -1)
    whole = ranked[0]
    for r in ranked[1:]:
        whole = whole << ID_BITS | r
    by = np.argsort(whole)
    texts = pa.array([named[i] for i in order], pa.string())
    key = pc.binary_join_element_wise(*[texts.take(pa.array(r[by])) for r in ranked], lang, " ")
    return pa.RecordBatch.from_arrays([key, pa.array(counts[by])], schema=schema)


def counted(docs: DataFrame, depth: int, words: Filter | None = None, pairs: Filter | None = None) -> DataFrame:
    """Phrases of `depth` words of documents (lang, text as bytes) with partial counts.

    Among words there is, with nothing as word, how many of them each lang has.
    """
    small_batches()
    out = T._parse_datatype_string(COUNTED)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}
        waiting: dict[str, list[bytes]] = {}
        totals: dict[str, int] = {}
        known = Words()

        def count(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal known
            ids = known(waiting.pop(lang))
            trie = tries.setdefault(lang, HatTrie(depth))
            totals[lang] = totals.get(lang, 0) + int((ids > 0).sum())
            trie.add(_keys(ids, known.hashes, lang, depth, words, pairs))
            if known.full():
                yield from spilled(0)
                known = Words()
            elif sum(t.size for t in tries.values()) > CAPACITY:
                yield from spilled(CAPACITY // 2)

        def spilled(least: int) -> Iterator[pa.RecordBatch]:
            whole = sum(t.size for t in tries.values())
            for lang, trie in sorted(tries.items(), key=lambda x: -x[1].size):
                # Each lang keeps its share of what may stay.
                for keys, counts in trie.spill(least * trie.size // max(whole, 1)):
                    one = _run(lang, depth, known.words, keys, counts, schema)
                    for at in range(0, one.num_rows, 65_536):
                        yield one.slice(at, 65_536)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for some in split(text.as_py()):
                    waiting.setdefault(lang, []).extend(some)
                    if len(waiting[lang]) > WORDS_AT_ONCE:
                        yield from count(lang)
        for lang in list(waiting):
            yield from count(lang)
        yield from spilled(0)
        if depth == 1 and totals:
            keys = pa.array([" " + lang for lang in totals], pa.string())
            yield pa.RecordBatch.from_arrays([keys, pa.array(list(totals.values()), pa.int64())], schema=schema)

    return docs.mapInArrow(run, out)


def merged(runs: DataFrame, depth: int, least: int) -> DataFrame:
    """Whole counts of phrases of `depth` words from their runs, those of at least `least`: lang, w1 and so on, n.

    The number of words of each lang is there with `w1` null.
    """
    runs = runs.repartition(F.substring_index("key", " ", 1), F.pmod(F.xxhash64("key"), F.lit(SLOTS)))
    prefix, slot = F.substring_index("key", " ", 1).alias("_prefix"), F.pmod(F.xxhash64("key"), F.lit(SLOTS)).alias("_slot")
    whole = runs.select("key", "n", prefix, slot).groupBy("_prefix", "_slot", "key").agg(F.sum("n").alias("n"))
    whole = whole.filter((F.col("n") >= least) | F.col("key").startswith(" "))
    parts = F.split("key", " ", depth + 1)
    words = [F.nullif(parts[k], F.lit("")).alias(f"w{k + 1}") for k in range(depth)]
    return whole.select(parts[depth].alias("lang"), *words, "n")


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, text: str = "text") -> list[DataFrame]:
    """Tables of words, pairs and triples with their counts by lang, stored; the first one has each lang's total as well.

    Only phrases that occur at least `least` times are in them. Documents without lang are `und`.
    """
    whole = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    whole = spread(whole)
    tables = [materialize(merged(counted(whole, 1), 1, least), "words")]
    words = filter_of(tables[0].filter("w1 IS NOT NULL"), ["w1"])
    tables.append(materialize(merged(counted(whole, 2, words), 2, least), "pairs"))
    if longest > 2:
        pairs = filter_of(tables[1], ["w1", "w2"])
        tables.append(materialize(merged(counted(whole, 3, words, pairs), 3, least), "triples"))
    return tables


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, inside_percent: int = 50, best: int = 2000, text: str = "text"
) -> DataFrame:
    """The best phrases of two to `longest` words (three at most) of each lang: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A to Z) and split into pieces at stops and line ends, pieces into words. `a` counts a phrase within pieces,
    overlaps included, `n` all words of the lang. A phrase is cut in two at its weakest place, into parts that occur
    `l` and `r` times: score is 1,000,000 * a * a / (l * r), rounded down, the least over all cuts; ties go to the shorter first part. Phrases
    of fewer than `least` occurrences are left out, and those inside a longer candidate that occurs at least `inside_percent` as
    often. Ties in rank go by `a`, then by the bytes of the phrase.

    A null text is empty, a null lang `und`; repeated rows count as often as they come; no rows give none; other
    columns are left out. Counts and products are exact: up to 38 digits, beyond which the job stops. Counts of words, pairs
    and triples are written to the shared folder.
    """
    if longest not in (2, 3):
        raise ValueError("phrases have two or three words")
    tables = phrase_counts(docs, longest, least, text)
    total = tables[0].filter("w1 IS NULL").select("lang", F.col("n").alias("words"))
    word = tables[0].filter("w1 IS NOT NULL").select("lang", "w1", "n")
    pair = tables[1].select("lang", "w1", "w2", F.col("n").alias("a"))

    def part(table: DataFrame, names: dict[str, str], count: str) -> DataFrame:
        return table.select("lang", *[F.col(a).alias(b) for a, b in names.items()], F.col(table.columns[-1]).alias(count))

    cut = pair.join(part(word, {"w1": "w1"}, "l"), ["lang", "w1"]).join(part(word, {"w1": "w2"}, "r"), ["lang", "w2"])
    found = cut.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "w1", "w2", "a", "l", "r", _score("a", "l", "r").alias("score"))
    if longest > 2:
        triple = tables[2].select("lang", "w1", "w2", "w3", F.col("n").alias("a"))
        ends = triple.select("lang", "w1", "w2", "a").union(triple.select("lang", "w2", "w3", "a"))
        inside = ends.groupBy("lang", "w1", "w2").agg(F.max("a").alias("_longer"))
        found = found.join(inside, ["lang", "w1", "w2"], "left")
        longer = F.coalesce(F.col("_longer"), F.lit(0)).cast("decimal(22,0)") * 100
        found = found.filter((F.col("_longer").isNull()) | (longer < F.col("a").cast("decimal(22,0)") * inside_percent))
        cut = triple.join(part(word, {"w1": "w1"}, "l1"), ["lang", "w1"]).join(part(word, {"w1": "w3"}, "r2"), ["lang", "w3"])
        cut = cut.join(part(pair, {"w1": "w2", "w2": "w3"}, "r1"), ["lang", "w2", "w3"])
        cut = cut.join(part(pair, {"w1": "w1", "w2": "w2"}, "l2"), ["lang", "w1", "w2"])
        first = F.struct(_score("a", "l1", "r1").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r"))
        second = F.struct(_score("a", "l2", "r2").alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("r2").alias("r"))
        triples = cut.withColumn("_cut", F.least(first, second))
        triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "_cut.l", "_cut.r", "_cut.score")
        found = found.select(*triples.columns).union(triples)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # The best of each part of a lang first, so that no task is sent a whole lang.
    parts = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SLOTS)))
    parts = parts.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score"
    )


def _score(a: str, left: str, right: str) -> Column:
    """1,000,000 * a * a / (l * r), rounded down, in whole numbers of up to 38 digits."""
    x, y, z = (f"CAST({c} AS DECIMAL(38,0))" for c in (a, left, right))
    return F.expr(f"(CAST({x} * {x} * 1000000 AS DECIMAL(38,0))) DIV (CAST({y} * {z} AS DECIMAL(38,0)))")


def phrases_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words in each lang of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_hat_trie_phrases": phrases_query}

ORACLE = {
    "op12_hat_trie_phrases": rf"""WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    cut AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
    words AS (SELECT id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM cut),
    starts AS (SELECT lang, w AS one, w || ' ' || lead(w) OVER piece AS two,
            w || ' ' || lead(w) OVER piece || ' ' || lead(w, 2) OVER piece AS three
        FROM words WINDOW piece AS (PARTITION BY id ORDER BY i)),
    f AS (SELECT lang, 1 AS k, one AS phrase, count(*) AS n FROM starts GROUP BY ALL
        UNION ALL SELECT lang, 2, two, count(*) FROM starts WHERE two IS NOT NULL GROUP BY ALL
        UNION ALL SELECT lang, 3, three, count(*) FROM starts WHERE three IS NOT NULL GROUP BY ALL),
    total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
    cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 10),
    cuts AS (SELECT c.lang, c.phrase, c.a, c.k, j, x.n AS l, y.n AS r,
            CAST((1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n) AS BIGINT) AS score
        FROM cand c, (VALUES (1), (2)) AS t(j)
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ')
        WHERE j < c.k),
    scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    inside AS (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM cand WHERE k = 3
        UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM cand WHERE k = 3),
    kept AS (SELECT * FROM scored s WHERE NOT EXISTS (
        SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.a >= 50 * s.a)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}
