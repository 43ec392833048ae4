"""Categories by a table of search terms, met through an inverted index of their rarest words.

Where `functions.categories` writes rules into the plan, here they are rows, and may be many thousands. A text and a term
are the words (letters, digits, `_`) they are made of, in small letters; a term is in a text where its words follow each other
there, whatever stands between them. Each term is filed under the one of its words that the fewest texts hold. The words
of the texts meet that index by a join, and the other words of a term are verified in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.session import materialize

# Fixed value: what a word is made of.
WORD = r"[\p{L}\p{N}_]+"


def words_of(text: Column) -> Column:
    """The words of a text in small letters; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def phrases(terms: DataFrame) -> DataFrame:
    """Each different run of words among the terms with the first rule that has it: phrase, words, rule, category, term.

    Terms without a word and rules without a number are left out.
    """
    named = terms.filter("rule IS NOT NULL").select(
        words_of(F.col("term")).alias("words"), F.struct("rule", "category", "term").alias("_rule")
    )
    named = named.filter(F.size("words") > 0).groupBy("words").agg(F.min("_rule").alias("_rule"))
    return named.select(_padded(F.col("words")).alias("phrase"), "words", "_rule.*")


def term_index(texts: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """The phrases by their rarest word: anchor, phrase, rule, category, term.

    Rare is what few of the texts hold, ties go to the smaller word. A phrase with a word that no text holds can be nowhere
    and is left out.
    """
    wanted = found.select(F.explode("words").alias("word")).distinct()
    held = texts.select(F.explode(F.array_distinct(words_of(F.col(text)))).alias("word"))
    often = held.join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("texts"))
    parts = found.select("phrase", "rule", "category", "term", F.explode(F.array_distinct("words")).alias("word"))
    filed = parts.join(often, "word", "left").groupBy("phrase", "rule", "category", "term").agg(
        F.min(F.struct("texts", "word")).alias("_rarest"), F.count_if(F.col("texts").isNull()).alias("_unknown")
    )
    return filed.filter("_unknown = 0").select(F.col("_rarest.word").alias("anchor"), "phrase", "rule", "category", "term")


def category_terms(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """The first rule with a term in each text: `key`, rule, category, term.

    `terms` has rule (its place in the order), category and term; of equal rules the smaller category, then the smaller
    term counts. Texts without any term, null and empty ones are left out. Rows of one key, null being one, are judged
    together.

    A text is sent along once for each of its words that files a term. Spark broadcasts the index while it is small;
    otherwise words of texts and index are shuffled, and a word that many texts hold is split like any hot key.
    """
    index = materialize(term_index(texts, materialize(phrases(terms), "phrases"), text), "terms")
    found = words_of(F.col(text))
    words = texts.select(
        F.col(key).alias("_key"), _padded(found).alias("_text"), F.explode(F.array_distinct(found)).alias("anchor")
    )
    hits = words.join(index, "anchor").filter(F.contains("_text", "phrase"))
    first = hits.groupBy("_key").agg(F.min(F.struct("rule", "category", "term")).alias("_first"))
    return first.select(F.col("_key").alias(key), "_first.*")
