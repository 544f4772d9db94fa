"""URL normalisation, filters, links and names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
NON_DOC_FOLDERS = tuple("about account auth billing blog careers cart community contact download downloads events forum login news press pricing privacy shop signup terms".split())
NON_DOC_SUFFIXES = tuple("avif css dmg eot exe gif gz ico iso jpeg jpg js json mp3 mp4 pdf png svg tar tgz ttf webp woff woff2 xml zip".split())


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 host, 3 path, 4 query; empty where absent."""
    return F.regexp_extract(url, _PARTS, k)


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def normalize(url: Column) -> Column:
    """Lower-case scheme and host, path of / at least and without one trailing /, sorted query, no fragment.

    Values are kept as they are encoded; parts of a query without = get one, empty parts go.
    """
    p = path(url)
    p = F.when(p == "", "/").when((F.length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)
    pairs = F.filter(F.split(part(url, 4), "&", -1), lambda x: x != "")
    pairs = F.array_sort(F.transform(pairs, lambda x: F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("=")))))
    query = F.when(F.size(pairs) == 0, "").otherwise(F.concat(F.lit("?"), F.array_join(pairs, "&")))
    site = F.when(part(url, 2) == "", "").otherwise(F.concat(F.lit("//"), host(url)))
    scheme = F.when(part(url, 1) == "", "").otherwise(F.concat(F.lower(part(url, 1)), F.lit(":")))
    return F.concat(scheme, site, p, query)


def glob_regex(pattern: str) -> str:
    """** any text, * any text within a segment, ? one character of a segment; the rest literally, whole path."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(pattern[i]) or re.escape(pattern[i]))
        i += 1
    return "^" + "".join(out) + "$"


def any_regex(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def is_allowed(url: Column, base: str | Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Of the base's host, not in a folder or of a kind that holds no documentation, and within the globs."""
    p = F.when(path(url) == "", "/").otherwise(path(url))
    lower = F.lower(p)
    ok = host(url) == (F.lit(re.match(_PARTS, base)[2].lower()) if isinstance(base, str) else host(base))
    ok &= ~lower.rlike("/(" + "|".join(NON_DOC_FOLDERS) + ")/")
    ok &= ~lower.rlike(r"\.(" + "|".join(NON_DOC_SUFFIXES) + ")$")
    if exclude:
        ok &= ~p.rlike(any_regex([glob_regex(x) for x in exclude]))
    if include:
        ok &= p.rlike(any_regex([glob_regex(x) for x in include]))
    return ok


def absolute(href: Column, base: Column) -> Column:
    """An href seen from the page `base`; dot segments are resolved for leading ./ and ../ only."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    up = F.regexp_replace(folder, "[^/]+/$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .when(href.startswith("../"), F.concat(root, up, F.regexp_replace(href, r"^\.\./", "")))
        .otherwise(F.concat(root, folder, F.regexp_replace(href, r"^\./", "")))
    )


def links(html: Column, url: Column, base: str | Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Sorted distinct normal URLs of a page's hrefs that the filter lets through."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)href=["']([^"']+)["']"""), 1)
    hrefs = F.filter(hrefs, lambda x: ~x.rlike("(?i)^(javascript|mailto|tel):"))
    out = F.transform(hrefs, lambda x: normalize(absolute(F.trim(x), url)))
    return F.array_sort(F.array_distinct(F.filter(out, lambda x: is_allowed(x, base, include, exclude))))


def breadcrumb(url: Column) -> Column:
    """The path's segments, each without its last extension."""
    segments = F.transform(F.split(path(url), "/", -1), lambda x: F.regexp_replace(x, r"\.[^.]*$", ""))
    return F.filter(segments, lambda x: x != "")


def software_name(url: Column) -> Column:
    """A name from a host: prefixes like docs. and one known ending off, the project of a readthedocs host."""
    h = F.regexp_replace(host(url), r"^(api|docs?|www)\.", "")
    h = F.regexp_replace(h, r"\.(com|dev|io|net|org)$", "")
    first = F.element_at(F.split(h, r"\."), 1)
    name = F.regexp_replace(first, "[^a-z0-9-]", "")
    hosted = h.contains("readthedocs") & ~first.isin("readthedocs", "docs") & (first != "")
    return F.when(hosted, first).otherwise(F.when(name == "", "unknown").otherwise(name))


def is_url(value: Column) -> Column:
    return value.rlike("^https?://[^/?#]+")


def robots_allows(path_: Column, disallowed: Column) -> Column:
    """No disallowed prefix leads the path; a host without rules allows everything."""
    return ~F.exists(F.coalesce(disallowed, F.array().cast("array<string>")), lambda p: path_.startswith(p))
