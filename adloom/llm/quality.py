"""Line-first cleaning: rules on every line, failing lines go, documents that lose too much of their text go."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from adloom.llm.texts import text_struct, words

# Characters counted as symbols, and measures below or above which a document fails outright.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

# Marks a line of prose ends with, and phrases of lines that belong to the site and not to the text.
ENDS = ".!?…:;。！？।؟\"'”’»›)]"
PHRASES = (
    "lorem ipsum|enable javascript|accept cookies|cookie policy|privacy policy|terms of use|terms of service"
    "|all rights reserved|skip to content|read more|sign in|log in|subscribe to|share this"
)
_PHRASES = re.compile(PHRASES)


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules; shares are in percent so that whole numbers decide.

    A line fails if it is boilerplate (a phrase of `PHRASES` in at most `phrase_words` words), navigation (`|` or `>`
    between at least a quarter of its words), noise (more than `symbols` symbols per 100 words), shouting (at least
    `capital_words` words, over half of them capitals only), a repetition of an earlier line, or a fragment (under
    `prose_words` words and no end of a sentence). A document fails if the lines that fail hold over `lost` percent of the characters of its words.
    """

    phrase_words: int = 25
    symbols: int = 30
    capital_words: int = 5
    prose_words: int = 15
    lost: int = 30


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines_removed long, chars_removed long, clean_text string"
)


def line_fails(line: str, found: list[str], rules: Rules) -> bool:
    """Whether a line, not seen before and with the given words, fails a rule."""
    n = len(found)
    if n <= rules.phrase_words and _PHRASES.search(line.lower()):
        return True
    if 4 * (line.count("|") + line.count(">")) >= n > 1:
        return True
    if 100 * sum(map(line.count, SYMBOLS)) > rules.symbols * n:
        return True
    if n >= rules.capital_words and 2 * sum(w.upper() == w != w.lower() for w in found) > n:
        return True
    return n < rules.prose_words and found[-1][-1] not in ENDS


def repeated_words(found: list[str]) -> int:
    """How many words lie in windows of three words that occur twice or more."""
    windows = list(zip(found, found[1:], found[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0  # covered: words before this position are counted
    for k, window in enumerate(windows):
        if counts[window] > 1:
            total += k + 3 - max(k, covered)
            covered = k + 3
    return total


def measure(text: str | None, rules: Rules = Rules()) -> tuple:
    """The fields of `SCHEMA` for one text."""
    text = text or ""
    n_words = chars = removed = lost = duplicates = 0
    every: list[str] = []
    seen: set[str] = set()
    keep: list[str] = []
    for line in text.split("\n"):
        found = words(line)
        if not found:
            keep.append(line)
            continue
        every += found
        size = sum(map(len, found))
        chars += size
        again = line in seen
        duplicates += again
        seen.add(line)
        if again or line_fails(line, found, rules):
            removed += 1
            lost += size
        else:
            keep.append(line)
    n_words, repeated = len(every), repeated_words(every)
    failed = n_words < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n_words
    kept = not failed and 100 * lost <= rules.lost * chars
    symbols = sum(map(text.count, SYMBOLS))
    return n_words, chars, symbols, duplicates, repeated, failed, kept, removed, lost, "\n".join(keep)


def line_quality(docs: DataFrame, rules: Rules = Rules(), text: str = "text", name: str = "quality") -> DataFrame:
    """Add the struct `name` with the fields of `SCHEMA`, among them the verdict and the text without failing lines.

    A null or empty text has no words and fails. Rows are judged one by one, so repeated rows get the same verdict,
    no rows give none, and other columns stay as they are, save one called `name`, which is replaced.
    """
    return docs.withColumn(name, text_struct(docs[text], SCHEMA, lambda x: measure(x, rules)))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fields = [f.split()[0] for f in SCHEMA.split(", ") if not f.startswith("clean_text")]
    return line_quality(docs).select("doc_id", *[f"quality.{f}" for f in fields])


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SYMBOLS = r"length(regexp_replace({}, '[^#*$%&|<>]', '', 'g'))"

SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT r, doc_id, text, {_WORDS.format("text")} AS ws FROM d
), windows AS (
    SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1),
        lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS three
    FROM w WHERE len(ws) > 2
), twice AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM windows
), repeated AS (
    SELECT r, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY r
), split AS (
    SELECT r, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line
    FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d)
), lines AS (
    SELECT r, line, {_WORDS.format("line")} AS ws, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS again
    FROM split
), judged AS (
    SELECT r, again, length(array_to_string(ws, '')) AS size, again
        OR (len(ws) <= 25 AND regexp_matches(lower(line), '{PHRASES}'))
        OR (len(ws) > 1 AND 4 * length(regexp_replace(line, '[^|>]', '', 'g')) >= len(ws))
        OR 100 * {_SYMBOLS.format("line")} > 30 * len(ws)
        OR (len(ws) >= 5 AND 2 * len(list_filter(ws, lambda x: upper(x) = x AND lower(x) <> x)) > len(ws))
        OR len(ws) < 15 AND NOT contains('{ENDS.replace("'", "''")}', ws[-1][-1]) AS fails
    FROM lines WHERE len(ws) > 0
), lost AS (
    SELECT r, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed,
        coalesce(sum(size) FILTER (fails), 0)::BIGINT AS chars_removed
    FROM judged GROUP BY r
), base AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        {_SYMBOLS.format("text")}::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed,
        coalesce(chars_removed, 0) AS chars_removed,
        len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) AS base_failed
    FROM w LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r)
)
SELECT *, NOT base_failed AND 100 * chars_removed <= 30 * word_chars AS kept FROM base
"""

QUERIES = {"op5_line_first_quality": quality_query}
ORACLE = {"op5_line_first_quality": SQL}
