"""Text clean-up as Column expressions; none of them needs Python workers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters Unicode counts as whitespace, with the four ASCII separators. `trim` and a
# plain `\s` see only a part of them.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Drop whitespace at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """Turn every whitespace run into one space and drop it at both ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "), F.lit(" "))


def normalized(title: Column) -> Column:
    """The form of a title that two ads are compared by."""
    return F.lower(strip(title))


def first_filled(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty, else the empty string."""
    filled = F.filter(F.array(*candidates), lambda c: c != "")
    return F.coalesce(F.try_element_at(filled, F.lit(1)), F.lit(""))


def shorten(text: Column, width: int) -> Column:
    """At most `width` characters, with an ellipsis only where something was cut."""
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("..."))).otherwise(text)


def headline(text: Column, width: int) -> Column:
    """At most `width` characters, always followed by an ellipsis."""
    return F.concat(F.left(text, F.lit(width)), F.lit("..."))


def join_numbers(numbers: Column, separator: str = ",") -> Column:
    return F.array_join(F.transform(numbers, lambda n: n.cast("string")), separator)


def one_decimal(value: Column, unit: str) -> Column:
    # Rounds the exact binary value, ties to even; `format_string` rounds the printed one up.
    return F.concat(F.call_function("format_number", value, F.lit("0.0")), F.lit(unit))


def stamp(moment: Column) -> Column:
    """The text form of `scraped_at`."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def concat_key(parts: Iterable[Column]) -> Column:
    """A composite key as one text, each part stripped and missing parts empty."""
    return F.concat_ws("|", *[strip(F.coalesce(p, F.lit(""))) for p in parts])
