"""Hashes that name pages, chunks and collections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """Runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def content_hash(text: Column) -> Column:
    """Alike for texts that differ in blanks or case alone."""
    return F.sha2(F.lower(squeezed(text)), 256)


def chunk_id(software: Column, version: Column, url: Column, heading: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws("|", software, version, url, heading, index.cast("string")), 256)


def page_id(url: Column, title: Column) -> Column:
    return F.sha2(F.concat_ws("|", url, title), 256)


def model_key(model: Column) -> Column:
    return F.substring(F.md5(F.translate(F.lower(model), "/-.", "___")), 1, 8)


def collection(software: Column, version: Column, model: Column) -> Column:
    return F.concat_ws("_", software, version, model_key(model))
