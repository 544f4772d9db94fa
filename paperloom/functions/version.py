"""Version strings: recognition, order and detection in pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LIKE = r"(?i)^v?\d+(\.\d+)*([-.]?(alpha|beta|dev|pre|rc|stable))?$"
_NUMBERS = r"^([0-9]+)(?:\.([0-9]+)(?:\.([0-9]+))?)?([\w.-]*)$"
_LINK = r'href="[^"]*?/([0-9]+(?:\.[0-9]+)*)/[^"]*"'


def looks_like(value: Column) -> Column:
    return value.rlike(_LIKE)


def key(version: Column) -> Column:
    """What versions are ordered by: three numbers, then none of a suffix above any, then the suffix.

    Versions that don't begin with a number are below all others.
    """
    v = F.trim(version)
    number = lambda k: F.coalesce(F.regexp_extract(v, _NUMBERS, k).try_cast("bigint"), F.lit(0).cast("bigint"))
    numeric = v.rlike(_NUMBERS)
    suffix = F.lower(F.when(numeric, F.regexp_extract(v, _NUMBERS, 4)).otherwise(v))
    numbers = F.when(numeric, F.array(number(1), number(2), number(3))).otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)).cast("array<bigint>"))
    return F.struct(numbers.alias("numbers"), (suffix == "").alias("final"), suffix.alias("suffix"))


def path_key(version: Column) -> Column:
    """Order of versions found in URLs: all parts as numbers, others as 0."""
    return F.transform(F.split(F.regexp_replace(version, "^[vV]+", ""), r"[.\-]", -1), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint")))


def in_links(html: Column) -> Column:
    """Distinct versions in links, by first place."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(_LINK), 1))


def in_dropdown(html: Column) -> Column:
    """Options of selects about versions or releases; else versions in links."""
    selects = F.regexp_extract_all(html, F.lit(r"(?is)<select\b[^>]*(?:release|version)[^>]*>(.*?)</select>"), 1)
    options = F.flatten(F.transform(selects, lambda x: F.regexp_extract_all(x, F.lit(r'<option\b[^>]*value="([^"]*)"'), 1)))
    options = F.filter(F.transform(options, lambda x: F.regexp_replace(x, "^/+|/+$", "")), looks_like)
    return F.when(F.size(options) > 0, F.array_distinct(options)).otherwise(F.filter(in_links(html), looks_like))


def of_url(url_path: Column, base_path: str) -> Column:
    """The first segment after the base path, if it looks like a version; else null."""
    rest = F.when(url_path.startswith(base_path), F.substring(url_path, len(base_path) + 1, 1_000_000)).otherwise(url_path)
    first = F.element_at(F.filter(F.split(rest, "/"), lambda x: x != ""), 1)
    return F.when(looks_like(first), first)
