"""Crawling level by level: one join and one fetch pass for each depth, with a frontier that can be resumed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ensure_importable
from ..functions import url as U
from ..sources.tables import Tables
from ..sources.web import robots, robots_gate

FETCHED = "url string, status_code int, html string, etag string, last_modified string"


def table_fetcher(store: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A source that answers from a table (url, status_code, html, etag, last_modified)."""
    return lambda urls: urls.select("url").join(store.select(*[x.split()[0] for x in FETCHED.split(", ")]), "url")


def http_fetcher(get: Callable[[str, str | None, str | None], dict], delay: float = 0.0, attempts: int = 3, hosts: int = 64) -> Callable[[DataFrame], DataFrame]:
    """A source that calls get(url, etag, last_modified) in tasks of whole hosts, at most one request each `delay`
    seconds to a host. Answers of 500 and more, 429 and errors are tried again with growing pauses; then dropped."""

    def fetch(urls: DataFrame) -> DataFrame:
        ensure_importable(urls.sparkSession)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last: dict[str, float] = {}
            for frame in frames:
                out = []
                for r in frame.itertuples():
                    for k in range(attempts + 1):
                        if (wait := last.get(r.host, 0) + delay - time.monotonic()) > 0:
                            time.sleep(wait)
                        last[r.host] = time.monotonic()
                        try:
                            answer = get(r.url, r.etag, r.last_modified)
                        except OSError:
                            answer = None
                        if answer and answer["status_code"] < 500 and answer["status_code"] != 429:
                            out.append((r.url, answer["status_code"], answer.get("html"), answer.get("etag"), answer.get("last_modified")))
                            break
                        if k < attempts:
                            time.sleep(0.5 * 2**k)
                yield pd.DataFrame(out, columns=[x.split()[0] for x in FETCHED.split(", ")])

        known = urls if "etag" in urls.columns else urls.withColumn("etag", F.lit(None).cast("string")).withColumn("last_modified", F.lit(None).cast("string"))
        return known.select("url", "etag", "last_modified", U.host(F.col("url")).alias("host")).repartition(hosts, "host").mapInPandas(run, FETCHED)

    return fetch


def robots_rules(fetch: Callable[[DataFrame], DataFrame], urls: DataFrame) -> DataFrame:
    """Robots rules of the hosts of urls, one row per host; a host whose robots.txt can't be had has no rules."""
    hosts = urls.select(U.host(F.col("url")).alias("host"), F.concat(F.regexp_extract("url", "^([^:]+)://", 1), F.lit("://"), U.host(F.col("url")), F.lit("/robots.txt")).alias("url")).dropDuplicates(["host"])
    answers = fetch(hosts.select("url")).filter("status_code < 400 and html is not null")
    return robots(hosts.join(answers.select("url", F.col("html").alias("robots")), "url").select("host", "robots"))


def fetch_cached(tables: Tables, urls: DataFrame, fetch: Callable[[DataFrame], DataFrame], hours: int = 168) -> DataFrame:
    """Answers (url, status_code, html, etag, last_modified) to urls: from the cache while they last, else fetched, with
    the cached etag and date as condition; a 304 renews what the cache has. Every answer goes into the cache."""
    now = F.current_timestamp()
    known = tables.read("response_cache").join(urls.select("url"), "url", "left_semi")
    fresh = known.filter(F.col("expires_at") > now)
    asked = urls.select("url").join(fresh.select("url"), "url", "left_anti")
    stale = known.select("url", F.col("html").alias("__html"), F.col("etag").alias("__etag"), F.col("last_modified").alias("__last"), F.col("status_code").alias("__code"))
    conditions = stale.select("url", F.col("__etag").alias("etag"), F.col("__last").alias("last_modified"))
    answers = fetch(asked.join(conditions, "url", "left")).join(stale, "url", "left")
    same = (F.col("status_code") == 304) & F.col("__code").isNotNull()
    pick = lambda new, old: F.when(same, F.col(old)).otherwise(F.col(new)).alias(new)
    answers = answers.select("url", pick("status_code", "__code"), pick("html", "__html"), F.coalesce("etag", F.when(same, F.col("__etag"))).alias("etag"), F.coalesce("last_modified", F.when(same, F.col("__last"))).alias("last_modified"))
    tables.upsert("response_cache", answers.withColumn("fetched_at", now).withColumn("expires_at", now + F.make_interval(hours=F.lit(hours))))
    return tables.read("response_cache").join(urls.select("url"), "url", "left_semi")


def crawl(tables: Tables, seeds: Sequence[str], fetch: Callable[[DataFrame], DataFrame], rules: DataFrame | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (), max_pages: int = 10_000, max_depth: int = 10, resume: bool = False, respect_robots: bool = False, hours: int = 168) -> DataFrame:
    """Fetched pages reachable from the seeds. Seeds bypass the URL filter.

    The frontier is the table crawl_queue, the answers response_cache; both are written after each level, so a crawl
    that broke off goes on with resume=True where it was. Of one level the first URLs by priority and name are
    fetched as long as max_pages allows. Answers of an earlier crawl are used for `hours`. With respect_robots the
    robots.txt of every host that comes up is fetched once, unless rules (host, disallowed) are given; URLs they
    forbid are marked skipped, those without an answer or with an error failed.
    """
    spark, base = tables.spark, seeds[0]
    if not resume:
        first = spark.createDataFrame([(s, 0, 0, "pending") for s in seeds], "url string, depth int, priority int, status string")
        tables.replace("crawl_queue", first.withColumn("url", U.normalize(F.col("url"))).dropDuplicates(["url"]))
    known = rules
    done = tables.read("crawl_queue").filter("status = 'completed'").count()
    while done < max_pages:
        queue = tables.read("crawl_queue")
        depth = queue.filter("status = 'pending'").agg(F.min("depth")).first()[0]
        if depth is None or depth > max_depth:
            break
        level = tables.stage(queue.filter((F.col("status") == "pending") & (F.col("depth") == depth)).orderBy("priority", "url").limit(max_pages - done))
        if respect_robots and rules is None:
            asked = level if known is None else level.join(known.select(F.col("host").alias("__h")), U.host(F.col("url")) == F.col("__h"), "left_anti")
            found = robots_rules(fetch, asked)
            # a host without rules has a row as well, so that it isn't asked again
            hosts = asked.select(U.host(F.col("url")).alias("host")).distinct().join(found, "host", "left").select("host", F.coalesce("disallowed", F.array().cast("array<string>")).alias("disallowed"))
            known = tables.stage(hosts if known is None else known.select("host", "disallowed").unionByName(hosts))
        allowed = tables.stage(robots_gate(level, known)) if known is not None else level
        pages = fetch_cached(tables, allowed, fetch, hours)
        found = pages.filter("status_code < 400").select(F.explode(U.links(F.col("html"), F.col("url"), base, include, exclude)).alias("url")).distinct()
        new = found.join(queue.select("url"), "url", "left_anti").select("url", F.lit(depth + 1).alias("depth"), F.lit(0).alias("priority"), F.lit("pending").alias("status"))
        status = F.when(F.col("__ok").isNull(), "skipped").when(F.col("status_code") < 400, "completed").otherwise("failed")
        state = level.join(allowed.select("url", F.lit(True).alias("__ok")), "url", "left").join(pages.select("url", "status_code"), "url", "left").select("url", "depth", "priority", status.alias("status"))
        tables.upsert("crawl_queue", state.unionByName(new))
        done = tables.read("crawl_queue").filter("status = 'completed'").count()
    return tables.read("response_cache").join(tables.read("crawl_queue").filter("status = 'completed'").select("url"), "url", "left_semi")


def clear(tables: Tables, name: str = "crawl_queue") -> None:
    """Empties the frontier, the response cache or the embedding cache."""
    if name not in ("crawl_queue", "response_cache", "embedding_cache"):
        raise ValueError(f"{name} can't be cleared")
    tables.replace(name, tables.read(name).limit(0))


def queue_stats(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("n"))
