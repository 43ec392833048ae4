"""Word-piece counts by a linear longest-match automaton: trie, failure links, and counts of popped pieces."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm.texts import text_struct

#: Words whose counts a worker remembers; past that it starts anew.
KEPT = 500_000


class LongestMatch:
    """Counts the pieces greedy longest-match-first cuts a word into, in time linear in the word.

    Pieces are bytes; those that begin a word start with `begin`. Each node of their trie has a failure link: when the
    next byte does not go on from it, the pieces that surely end before the link's text are popped, and matching goes
    on from the link. Only the number of popped pieces is kept for each node, so no piece is ever built.
    """

    def __init__(self, pieces: Iterable[bytes], begin: bytes = b" "):
        self.begin = begin
        self.next: dict[int, int] = {}  # node * 256 + byte -> node
        ends, parents = [False], [(0, 0)]
        for piece in pieces:
            node = 0
            for byte in piece:
                at = node << 8 | byte
                node = self.next.get(at, 0)
                if not node:
                    node = self.next[at] = len(ends)
                    ends.append(False)
                    parents.append((at >> 8, byte))
            if node:
                ends[node] = True
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        children: dict[int, list[int]] = {}
        for node in range(1, len(ends)):
            children.setdefault(parents[node][0], []).append(node)
        todo = deque(children.get(0, []))
        while todo:
            node = todo.popleft()
            todo.extend(children.get(node, []))
            if ends[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            parent, byte = parents[node]
            link, popped = self.fail[parent], self.popped[parent]
            while link >= 0 and (link << 8 | byte) not in self.next:
                popped += self.popped[link]
                link = self.fail[link]
            if link >= 0:
                self.fail[node], self.popped[node] = self.next[link << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """The number of pieces of a word, 1 (an unknown piece) if it cannot be cut into pieces, 0 if it is empty."""
        if not word:
            return 0
        step, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for byte in self.begin + word:
            while (to := step.get(node << 8 | byte)) is None:
                if fail[node] < 0:
                    return 1
                total += popped[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return 1
            total += popped[node]
            node = fail[node]
        return total


def byte_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file, of which those with a leading space begin words."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    special = {x["content"] for x in found.get("added_tokens", [])}
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return [bytes(letters[c] for c in piece) for piece in found["model"]["vocab"] if piece not in special]


_COUNTERS: dict[str, tuple[LongestMatch, dict[bytes, int]]] = {}


def _counter(vocabulary: str) -> tuple[LongestMatch, dict[bytes, int]]:
    """The automaton of a vocabulary and the counts it has made, one of each in every Python worker."""
    if vocabulary not in _COUNTERS:
        _COUNTERS[vocabulary] = LongestMatch(byte_pieces(public_tokenizers.path(vocabulary))), {}
    return _COUNTERS[vocabulary]


def counts(text: str | None, vocabulary: str) -> tuple[int, int, int, int]:
    """Words, pieces, pieces of the word with most of them, and UTF-8 bytes."""
    automaton, known = _counter(vocabulary)
    whole = (text or "").encode()
    found = whole.split()
    if len(known) > KEPT:
        known.clear()
    for word in set(found).difference(known):
        known[word] = automaton.count(word)
    each = [known[word] for word in found]
    return len(found), sum(each), max(each, default=0), len(whole)


def token_counts(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", text: str = "text", name: str = "tokens"
) -> DataFrame:
    """Add the struct `name`: n_words, n_tokens, most_in_a_word, n_bytes.

    Words are separated by spaces and the controls 9 to 13. Null and empty texts count zero throughout, repeated rows are
    counted alike, no rows give none, other columns stay, save one called `name`, which is replaced.
    """
    schema = "n_words long, n_tokens long, most_in_a_word long, n_bytes long"
    return docs.withColumn(name, text_struct(docs[text], schema, lambda x: counts(x, vocabulary)))


def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "tokens.*", F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"))


QUERIES = {"op1_linear_longest_match": token_counts_query}
ORACLE: dict[str, str] = {}
