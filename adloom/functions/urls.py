"""Ad identifiers and listing URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme, authority, path, query and fragment of a URI reference (RFC 3986, appendix B)
_URI = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, _URI, index)


def id_from_url(url: Column) -> Column:
    """Last path segment, trailing slashes ignored; a query stays part of it."""
    return F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)


def id_from_html_url(url: Column) -> Column:
    """Last path segment without any `.html`; nothing is trimmed before."""
    return F.replace(F.substring_index(url, "/", -1), F.lit(".html"), F.lit(""))


def without_query(href: Column) -> Column:
    return F.substring_index(href, "?", 1)


def absolute_url(href: Column, host: str) -> Column:
    """Prefix the host, but only to hrefs that start at the root."""
    return F.when(href.startswith("/"), F.concat(F.lit(host.rstrip("/")), href)).otherwise(href)


def _without_dots(path: Column) -> Column:
    segments = F.split(path, "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.regexp_replace(F.array_join(closed, "/"), "^(?!/)", "/")


def canonical_url(href: Column, host: str) -> Column:
    """Drop the query and resolve the rest against `host` (scheme and authority, no path)."""
    host = host.rstrip("/")
    scheme = host.split(":", 1)[0]
    link = without_query(href)
    path = _part(link, 3)
    fragment = F.when(_part(link, 5) != "", F.concat(F.lit("#"), _part(link, 5))).otherwise(F.lit(""))
    rooted = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.lit("/"), F.regexp_replace(path, "/+(?=/)", ""))
    )
    clean = F.when(rooted.contains("/."), _without_dots(rooted)).otherwise(rooted)
    return (
        F.when(link == "", F.lit(host))
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit(scheme + ":"), link))
        .when(path == "", F.concat(F.lit(host), fragment))
        .otherwise(F.concat(F.lit(host), clean, fragment))
    )


def normalize_base_url(url: Column) -> Column:
    """Drop trailing slashes and a trailing `/pageN`."""
    return F.regexp_replace(F.rtrim(url, F.lit("/")), r"(?U)/page\d+\n?\z", "")


def _decode(text: Column) -> Column:
    # A percent sign that starts no escape stands for itself.
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    # Form encoding, with `*` escaped and `~` left alone.
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def set_query_param(url: Column, name: str, value: Column) -> Column:
    """Set one query parameter and keep the others; parameters without a value are lost.

    A parameter keeps its first place, and repeated ones are brought together there.
    """
    query = _part(url, 4)
    fields = F.filter(F.split(query, "&", -1), lambda f: f.rlike("(?s)^[^=]*=.+$"))
    pairs = F.transform(
        fields,
        lambda f: F.struct(
            _decode(F.substring_index(f, "=", 1)).alias("k"),
            _decode(F.regexp_replace(f, "(?s)^[^=]*=", "")).alias("v"),
        ),
    )
    names = F.array_distinct(F.concat(F.transform(pairs, lambda p: p["k"]), F.array(F.lit(name))))
    encoded = F.flatten(
        F.transform(
            names,
            lambda k: F.when(
                k == name, F.array(F.concat(F.lit(f"{name}="), _encode(value.cast("string"))))
            ).otherwise(
                F.transform(
                    F.filter(pairs, lambda p: p["k"] == k),
                    lambda p: F.concat(_encode(k), F.lit("="), _encode(p["v"])),
                )
            ),
        )
    )
    scheme, authority, fragment = _part(url, 1), _part(url, 2), _part(url, 5)
    return F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(F.lit("")),
        F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(F.lit("")),
        _part(url, 3),
        F.lit("?"),
        F.array_join(encoded, "&"),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def page_path(base: Column, page: Column) -> Column:
    """`/pageN` form of a listing page; the first page is the base itself.

    With a query on the base the page goes into the path before it.
    """
    numbered = F.concat(
        F.regexp_replace(F.regexp_extract(base, r"(?s)^[^?#]*", 0), "/+$", ""),
        F.lit("/page"),
        page.cast("string"),
        F.regexp_extract(base, r"(?s)^[^?#]*(.*)$", 1),
    )
    return F.when(page == 1, base).otherwise(numbered)
