"""Fast paths over raw HTML that need no parser: heading and anchors by pattern.

They resolve the common character references only; `sources.pages.parse` resolves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions.text import collapse

H1 = r"(?is)<h1\b[^>]*>(.*?)</h1>"
TAG = r"(?s)<[^>]*>"

# What holds text that is no part of the page.
SILENT = r"(?is)<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>"
HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""

# Character references, the ampersand last. Text may leave out the semicolon of all but the
# second group.
_LOOSE = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "nbsp": "\u00a0", "pound": "£", "middot": "·", "copy": "©"}
_STRICT = {"apos": "'", "euro": "€"}


def unescape(text: Column, strict: bool = False) -> Column:
    """Resolve the common character references; `strict` is for attribute values."""
    for name, char in {**_LOOSE, **_STRICT, "amp": "&"}.items():
        if strict or name in _STRICT:
            text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
        else:
            text = F.regexp_replace(text, f"&{name};?", char)
    return text


def visible(html: Column) -> Column:
    """A page without comments, scripts and the like."""
    return F.regexp_replace(html, SILENT, "")


def title_of(html: Column) -> Column:
    """Text of the first level-one heading; empty if there is none."""
    return collapse(unescape(F.regexp_replace(F.regexp_extract(visible(html), H1, 1), TAG, "")))


def hrefs_of(html: Column) -> Column:
    """Targets of all anchors that have one, in document order."""

    def bare(value: Column) -> Column:
        quoted = value.rlike("^[\"']")
        inner = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return unescape(inner, strict=True)

    return F.filter(F.transform(F.regexp_extract_all(visible(html), F.lit(HREF), F.lit(1)), bare), lambda h: h != "")
