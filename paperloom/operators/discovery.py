"""Where the documentation of a software is, and which versions it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions import version as V
from . import extract

_PLACES = ["docs.{}.com/", "{}.readthedocs.io/", "{}.readthedocs.io/en/latest/", "www.{}.org/docs/", "{}.org/documentation/", "devdocs.io/{}/", "docs.{}.dev/"]


def candidates(names: DataFrame, most: int = 5) -> DataFrame:
    """name, url, seq: the first places to look at for each name."""
    urls = F.array(*[F.concat(F.lit("https://" + p.split("{}")[0]), F.col("name"), F.lit(p.split("{}")[1])) for p in _PLACES[:most]])
    return names.select("name", F.posexplode(urls).alias("seq", "url"))


def probe(names: DataFrame, fetches: DataFrame, most: int = 5, least: float = 0.3) -> DataFrame:
    """Candidates that answered (status below 400) and look like documentation, by confidence."""
    found = candidates(names, most).join(fetches.filter("status_code < 400"), "url")
    return found.withColumn("confidence", extract.doc_score(F.col("html"))).filter(F.col("confidence") > least).orderBy(F.desc("confidence"), "seq")


def detect(entries: DataFrame, strategy: str, urls: DataFrame | None = None, fetches: DataFrame | None = None) -> DataFrame:
    """name, versions of entries (name, base_url, version_pattern, known_versions) by one of four strategies.

    explicit: the known ones. url_enumeration: known ones whose URL in fetches answered below 400, in order.
    sitemap: first path segments after the base in urls (name, loc) that look like versions, newest first.
    dropdown_scraping: of the base page in fetches.
    """
    if strategy == "explicit":
        return entries.select("name", F.col("known_versions").alias("versions"))
    if strategy == "url_enumeration":
        rows = entries.select("name", "version_pattern", "base_url", F.posexplode("known_versions").alias("n", "version"))
        at = F.replace(F.coalesce("version_pattern", F.concat("base_url", F.lit("/{version}/"))), F.lit("{version}"), F.col("version"))
        found = rows.withColumn("url", at).join(fetches.filter("status_code < 400").select("url"), "url", "left_semi")
        return found.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "version"))), lambda x: x["version"]).alias("versions"))
    if strategy == "sitemap":
        rows = urls.join(entries.select("name", "base_url"), "name")
        base, own = F.regexp_replace(U.path(F.col("base_url")), "/+$", ""), U.path(F.col("loc"))
        rest = F.when(own.startswith(base), F.substr(own, F.length(base) + 1)).otherwise(own)
        first = F.get(F.filter(F.split(rest, "/"), lambda x: x != ""), 0)
        found = rows.select("name", first.alias("version")).filter(V.looks_like(F.col("version"))).distinct()
        newest = F.sort_array(F.collect_list(F.struct(V.path_key(F.col("version")).alias("key"), "version")), asc=False)
        return found.groupBy("name").agg(F.transform(newest, lambda x: x["version"]).alias("versions"))
    if strategy == "dropdown_scraping":
        page = fetches.select(F.col("url").alias("base_url"), "html")
        return entries.join(page, "base_url").select("name", V.in_dropdown(F.col("html")).alias("versions"))
    raise ValueError(f"unknown version strategy {strategy}")


def resolve(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """wanted (input) with what the registry knows of it; for URLs a name from the host, for neither nulls."""
    name = F.when(U.is_url(F.col("input")), U.software_name(F.col("input"))).otherwise(F.col("input"))
    rows = wanted.select("input", name.alias("name"))
    known = registry.select("name", "display_name", F.col("base_url"), F.col("known_versions").alias("versions"), F.col("latest").alias("latest_version"))
    out = rows.join(F.broadcast(known) if registry.count() <= 100_000 else known, "name", "left")
    shown = F.initcap(F.translate("name", "-_", "  "))
    base = F.when(U.is_url(F.col("input")), F.col("input"))
    return out.select("input", "name", F.coalesce("display_name", shown).alias("display_name"), F.coalesce("base_url", base).alias("base_url"), F.coalesce("versions", F.array(F.lit("latest"))).alias("versions"), F.coalesce("latest_version", F.lit("latest")).alias("latest_version"))
