"""Sitemaps, robots rules, registries and evaluation sets as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import url as U


def _inner(block: Column, tag: str) -> Column:
    return F.trim(F.regexp_extract(block, rf"(?s)<(?:\w+:)?{tag}>\s*(.*?)\s*</(?:\w+:)?{tag}>", 1))


def sitemap(texts: DataFrame, text: str = "xml") -> DataFrame:
    """loc, lastmod, priority, seq of each <url> in the XML texts; entries without loc go, a bad priority is null."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<(?:\w+:)?url>(.*?)</(?:\w+:)?url>"), 1)
    rows = texts.select(F.posexplode(blocks).alias("seq", "b"))
    loc, lastmod = _inner(F.col("b"), "loc"), _inner(F.col("b"), "lastmod")
    priority = F.nullif(_inner(F.col("b"), "priority"), F.lit("")).try_cast("double")
    clean = F.replace(F.replace(F.replace(loc, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return rows.select(clean.alias("loc"), F.nullif(lastmod, F.lit("")).alias("lastmod"), priority.alias("priority"), "seq").filter("loc <> ''")


def sitemap_file(spark: SparkSession, path: str) -> DataFrame:
    """The same of files, split and parsed by the XML source."""
    schema = "loc string, lastmod string, priority string"
    rows = spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", True).schema(schema).load(path)
    return rows.select(F.trim("loc").alias("loc"), F.trim("lastmod").alias("lastmod"), F.col("priority").try_cast("double").alias("priority")).filter("loc <> ''")


def sitemap_index(texts: DataFrame, text: str = "xml") -> DataFrame:
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<(?:\w+:)?sitemap>(.*?)</(?:\w+:)?sitemap>"), 1)
    return texts.select(F.explode(blocks).alias("b")).select(_inner(F.col("b"), "loc").alias("loc")).filter("loc <> ''")


def sitemap_tree(store: DataFrame, root: str, depth: int = 8) -> DataFrame:
    """URL entries under a root sitemap of store (url, xml): indexes are followed, missing or bad children skipped."""
    level, out = store.filter(F.col("url") == root), None
    for _ in range(depth):
        own = sitemap(level)
        out = own if out is None else out.unionByName(own)
        children = sitemap_index(level).distinct()
        level = store.join(children, store["url"] == children["loc"], "left_semi")
        if level.isEmpty():
            break
    return out


def robots(texts: DataFrame, agent: str = "paperloom") -> DataFrame:
    """host, disallowed, crawl_delay, sitemaps of texts (host, robots).

    Disallow and Crawl-delay count after a last User-agent of * or one that names the tool; Sitemap always does.
    """
    rows = texts.select("host", F.posexplode(F.split("robots", r"\r?\n", -1)).alias("n", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = rows.select("host", "n", F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)).alias("v"))
    now = F.last(F.when(F.col("k") == "user-agent", F.lower("v")), ignorenulls=True).over(W.partitionBy("host").orderBy("n"))
    rows = rows.withColumn("ours", F.coalesce((now == "*") | now.contains(agent), F.lit(False)))
    pick = lambda key, only: F.when((F.col("k") == key) & (F.col("v") != "") & (F.col("ours") if only else F.lit(True)), F.struct("n", "v"))
    texts_of = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    return rows.groupBy("host").agg(
        texts_of(pick("disallow", True)).alias("disallowed"), F.max_by(F.when(F.col("ours") & (F.col("k") == "crawl-delay"), F.col("v").try_cast("double")), F.when(F.col("ours") & (F.col("k") == "crawl-delay"), F.col("n"))).alias("crawl_delay"),
        texts_of(pick("sitemap", False)).alias("sitemaps"),
    )


def robots_gate(urls: DataFrame, rules: DataFrame, respect: bool = True) -> DataFrame:
    """URLs whose path no rule of their host disallows. Rules are one row per host and join by it."""
    if not respect:
        return urls
    out = urls.withColumn("__h", U.host(F.col("url"))).join(rules.select(F.col("host").alias("__h"), "disallowed"), "__h", "left")
    p = F.when(U.path(F.col("url")) == "", "/").otherwise(U.path(F.col("url")))
    return out.filter(U.robots_allows(p, F.col("disallowed"))).select(*urls.columns)


REGISTRY_SCHEMA = "name string, display_name string, base_url string, version_pattern string, sitemap_url string, strategy string, known_versions array<string>, latest string, content_selectors map<string,string>, include array<string>, exclude array<string>, page_type_hints map<string,array<string>>"


def registry_frame(spark: SparkSession, rows: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame(list(rows), REGISTRY_SCHEMA)


def check_entry(data: dict) -> None:
    """Raises ValueError where an entry lacks what the registry needs."""
    docs = data.get("documentation")
    if not isinstance(data.get("name"), str) or not isinstance(data.get("display_name"), str) or not isinstance(docs, dict):
        raise ValueError("an entry needs name, display_name and documentation")
    if not str(docs.get("base_url", "")).startswith(("http://", "https://")):
        raise ValueError(f"{data['name']}: documentation.base_url must be a URL")
    strategy = (docs.get("versions") or {}).get("strategy", "explicit")
    if strategy not in ("explicit", "url_enumeration", "sitemap", "dropdown_scraping"):
        raise ValueError(f"{data['name']}: unknown version strategy {strategy}")


def registry(spark: SparkSession, folder: str, load: Callable[[str], dict] | None = None) -> DataFrame:
    """A row per YAML (or JSON) file of folder/software, by name; empty files are skipped and the last of a name wins."""
    if load is None:
        import yaml

        load = yaml.safe_load
    by_name = {}
    for p in sorted(Path(folder, "software").glob("*.yaml")) + sorted(Path(folder, "software").glob("*.json")):
        data = load(p.read_text()) if p.suffix == ".yaml" else json.loads(p.read_text())
        if not data:
            continue
        check_entry(data)
        d = data["documentation"]
        v, f = d.get("versions") or {}, d.get("url_filters") or {}
        known = [str(x) for x in v.get("known_versions") or []]
        by_name[data["name"]] = (
            data["name"], data["display_name"], d["base_url"], d.get("version_pattern"), d.get("sitemap_url"), v.get("strategy", "explicit"), known or ["latest"], str(v.get("latest") or (known or ["latest"])[0]),
            d.get("content_selectors") or {}, f.get("include") or [], f.get("exclude") or [], d.get("page_type_hints") or {},
        )
    return spark.createDataFrame([by_name[k] for k in sorted(by_name)], REGISTRY_SCHEMA)


EVAL_SCHEMA = "id string, question string, software string, version string, expected_chunk_ids array<string>, expected_urls array<string>, expected_titles array<string>, category string, difficulty string"


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_SCHEMA).option("multiLine", True).json(path)
