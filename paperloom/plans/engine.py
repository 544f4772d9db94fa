"""The engine: index, search, update, re-embed, list, stats and delete over snapshot tables."""

from __future__ import annotations

import re
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import ensure_importable
from ..functions import ids
from ..functions import url as U
from ..functions import version as V
from ..operators import changes, chunking, classify, crawl, discovery, embed, extract, search
from ..sources import web
from ..sources.backends import backend
from ..sources.config import load_config
from ..sources.tables import Tables

PRODUCER = "paperloom 0.1"
Name = str | None


class Events:
    """Handlers by event name, called in the order of registration; "*" hears everything."""

    def __init__(self):
        self._by_name = defaultdict(list)

    def on(self, name: str, handler: Callable[[str, dict], None]) -> None:
        self._by_name[name].append(handler)

    def off(self, name: str, handler: Callable[[str, dict], None]) -> None:
        if handler in self._by_name[name]:
            self._by_name[name].remove(handler)

    def emit(self, name: str, **data: Any) -> None:
        for handler in [*self._by_name[name], *self._by_name["*"]]:
            handler(name, data)


@dataclass
class VersionResult:
    software: str
    version: str
    status: str = "completed"
    pages: int = 0
    chunks: int = 0
    embedded: int = 0
    error: str | None = None
    seconds: dict[str, float] = field(default_factory=dict)


def roll_up(statuses: Sequence[str]) -> str:
    """failed if all failed, partial if some did, else completed."""
    failed = [s == "failed" for s in statuses]
    return "failed" if failed and all(failed) else "partial" if any(failed) else "completed"


class Engine:
    """One knowledge base under settings' general.data_dir; also a context manager."""

    def __init__(self, spark: SparkSession, registry: DataFrame | None = None, config: dict | None = None):
        self.spark, self.registry = spark, registry
        self.config = config or load_config()
        self.tables = Tables(spark, self.config["general"]["data_dir"])
        self.vectors = backend(self.config["storage"]["backend"], self.tables, self.config["storage"])
        self.extractor, self.classifier = extract.extract, classify.classify
        self.events = Events()
        ensure_importable(spark)

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        pass

    # -- versions

    def _entry(self, software: str) -> dict | None:
        rows = self.registry.filter(F.col("name") == software).collect() if self.registry is not None else []
        return rows[0].asDict() if rows else None

    def versions(self, software: str):
        """What is indexed, from old to new."""
        rows = self.tables.read("indexed_versions").filter(F.col("software") == software)
        return [r["version"] for r in rows.orderBy(V.key(F.col("version"))).select("version").collect()]

    def latest(self, software: str) -> str:
        own = self.versions(software)
        if not own:
            raise ValueError(f"{software} has no indexed version")
        return own[-1]

    def set_latest(self, software: str, version: str):
        rows = self.tables.read("indexed_software").filter(F.col("software") == software)
        marked = F.map_concat(F.map_filter(F.coalesce(F.from_json("config_snapshot", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: k != "latest_version"), F.create_map(F.lit("latest_version"), F.lit(version)))
        self.tables.upsert("indexed_software", rows.withColumn("config_snapshot", F.to_json(marked)))

    def marked_latest(self, software: str) -> str | None:
        """The version that set_latest() marked."""
        row = self.tables.read("indexed_software").filter(F.col("software") == software).select(F.get_json_object("config_snapshot", "$.latest_version").alias("v")).first()
        return row["v"] if row else None

    def exists(self, software: str, version: str) -> bool:
        return version in self.versions(software)

    def version_info(self, software: str, version: str) -> dict | None:
        row = self.tables.read("indexed_versions").filter((F.col("software") == software) & (F.col("version") == version)).first()
        return row.asDict() if row else None

    def _version(self, software: str, version: str | None) -> str:
        """The one asked for, or the latest: as marked, as the registry says, or the greatest that is indexed."""
        if version not in (None, "latest"):
            return version
        entry = self._entry(software)
        return self.marked_latest(software) or (entry["latest"] if entry else self.latest(software))

    # -- pages to vectors; one narrow pass up to the cache look-up

    def process(self, pages: DataFrame, software: str, version: str, selectors: dict | None = None, hints: dict | None = None) -> DataFrame:
        """pages (url, html) as chunks with all metadata but the vectors."""
        c = self.config["chunker"]
        typed = self.classifier(self.extractor(pages.select("url", "html"), selectors), hints)
        chunks = chunking.chunk_pages(typed, c["target_chunk_size"], c["max_chunk_size"], c["min_chunk_size"], c["overlap_tokens"], None if c["strategy"] == "auto" else c["strategy"])
        return chunks.withColumns({
            "software": F.lit(software), "version": F.lit(version),
            "chunk_id": ids.chunk_id(F.lit(software), F.lit(version), F.col("url"), F.col("section_heading"), F.col("chunk_index")),
            "parent_page_id": ids.page_id(F.col("url"), F.col("title")), "content_hash": ids.content_hash(F.col("content")),
            "crawl_timestamp": F.current_timestamp(), "producer_version": F.lit(PRODUCER),
        })

    def _embedded(self, chunks: DataFrame, model: str) -> DataFrame:
        """chunks as vector rows. New texts go into the cache first: every text is embedded once, and a run that breaks
        off loses none."""
        _, new = embed.embed_chunks(chunks, self.tables.read("embedding_cache"), model)
        seen = Observation()
        self.tables.upsert("embedding_cache", new.observe(seen, F.count(F.lit(1)).alias("n")))
        self.events.emit("embedding_progress", model=model, embedded=seen.get["n"])
        done, _ = embed.embed_chunks(chunks, self.tables.read("embedding_cache"), model)
        return done.withColumns({"embedding_model": F.lit(model), "embedding_dimension": F.size("vector"), "model_hash": ids.model_key(F.lit(model))})

    def _embed_and_store(self, chunks: DataFrame, model: str) -> None:
        self.vectors.write(self._embedded(chunks, model))

    def _state(self, chunks: DataFrame, fetches: DataFrame, software: str, version: str, removed: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Takes over chunks and pages; removed (url) and gone (chunk_id) go. Only this version's partition is written."""
        own = {"software": F.lit(software), "version": F.lit(version)}
        rows = chunks.select("chunk_id", F.col("url").alias("page_url"), "content_hash", "software", "version")
        self.tables.merge("chunk_state", rows, None if gone is None else gone.withColumns(own))
        first = chunks.filter("chunk_index = 0").select("url", "content_hash")
        meta = [c for c in ("etag", "last_modified") if c in fetches.columns]
        rows = fetches.select("url", *meta).join(first, "url").withColumns({"software": F.lit(software), "version": F.lit(version), "last_crawled_at": F.current_timestamp()})
        for c in {"etag", "last_modified"} - set(meta):
            rows = rows.withColumn(c, F.lit(None).cast("string"))
        self.tables.merge("page_state", rows, None if removed is None else removed.withColumns(own))

    def _run_row(self, run: str, r: VersionResult, mode: str, status: str, started: float, model: str) -> None:
        row = (run, r.software, r.version, mode, status, r.pages, r.chunks, model, r.error)
        df = self.spark.createDataFrame([row], "run_id string, software string, version string, mode string, status string, pages long, chunks long, model string, error string")
        at = F.timestamp_seconds(F.lit(started))
        self.tables.upsert("pipeline_runs", df.withColumn("started_at", at).withColumn("completed_at", F.current_timestamp() if status != "running" else F.lit(None).cast("timestamp")))

    def _finish(self, r: VersionResult, entry: dict | None, model: str) -> None:
        pages = self.tables.read("page_state").filter((F.col("software") == r.software) & (F.col("version") == r.version)).count()
        n = self.vectors.count(r.software, r.version, model)
        row = [(r.software, r.version, pages, n, model, embed.provider(model)[1])]
        df = self.spark.createDataFrame(row, "software string, version string, page_count long, chunk_count long, embedding_model string, embedding_dimension int")
        self.tables.upsert("indexed_versions", df.withColumn("indexed_at", F.current_timestamp()))
        name = (entry or {}).get("display_name") or re.sub("[-_]", " ", r.software).title()
        was = self.tables.read("indexed_software").filter(F.col("software") == r.software).select("config_snapshot").first()
        sw = self.spark.createDataFrame([(r.software, name, was[0] if was else None)], "software string, display_name string, config_snapshot string")
        self.tables.upsert("indexed_software", sw.withColumn("last_indexed_at", F.current_timestamp()))
        r.chunks = n

    # -- entry points

    def discover(self, software: str, fetch: Callable[[DataFrame], DataFrame] | None = None) -> dict:
        """name, display_name, base_url, versions, latest_version of a software's name or of a URL.

        What the registry lacks is looked for: a URL is its own base; of a name's usual places the one is taken that
        answers and looks most like documentation. Where the registry names a strategy other than `explicit`, versions
        that it finds win over the known ones; a detection that fails changes nothing.
        """
        known = web.registry_frame(self.spark) if self.registry is None else self.registry
        out = discovery.resolve(self.spark.createDataFrame([(software,)], "input string"), known).first().asDict()
        entry = self._entry(out["name"]) if out["name"] else None
        if entry is None and out["base_url"] is None and fetch is not None:
            names = self.spark.createDataFrame([(out["name"],)], "name string")
            best = discovery.probe(names, fetch(discovery.candidates(names).select("url"))).select("url").first()
            out["base_url"] = best["url"] if best else None
        if entry and entry["strategy"] != "explicit" and fetch is not None:
            found = self._detected(entry, fetch)
            if found:
                out["versions"] = found
                out["latest_version"] = out["latest_version"] if out["latest_version"] in found else found[0]
        return out

    def _detected(self, entry: dict, fetch: Callable[[DataFrame], DataFrame]) -> list[str] | None:
        own = self.registry.filter(F.col("name") == entry["name"])
        try:
            if entry["strategy"] == "sitemap":
                urls = self._sitemap(entry, fetch)
                rows = discovery.detect(own, "sitemap", urls=urls.select(F.lit(entry["name"]).alias("name"), "loc")) if urls is not None else None
            elif entry["strategy"] == "url_enumeration":
                pattern = entry["version_pattern"] or entry["base_url"] + "/{version}/"
                urls = self.spark.createDataFrame([(pattern.replace("{version}", v),) for v in entry["known_versions"]], "url string")
                rows = discovery.detect(own, "url_enumeration", fetches=fetch(urls))
            else:
                rows = discovery.detect(own, entry["strategy"], fetches=fetch(own.select(F.col("base_url").alias("url"))))
            row = rows.first() if rows is not None else None
            return row["versions"] if row else None
        except Exception as e:  # a site that can't be asked must not stop what the registry knows
            self.events.emit("discovery_failed", software=entry["name"], error=str(e)[:2000])
            return None

    def _sitemap(self, entry: dict | None, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        """loc, lastmod, priority, seq of the entry's sitemap; indexes are followed."""
        if not entry or not entry["sitemap_url"]:
            return None
        level, out = self.spark.createDataFrame([(entry["sitemap_url"],)], "url string"), None
        for _ in range(8):
            texts = self.tables.stage(fetch(level).filter("status_code < 400 and html is not null").select("url", F.col("html").alias("xml")))
            own = web.sitemap(texts)
            out = own if out is None else out.unionByName(own)
            level = web.sitemap_index(texts).distinct().select(F.col("loc").alias("url"))
            if level.isEmpty():
                break
        return out

    def index(self, software: str, version: Name = None, fetch: Callable[[DataFrame], DataFrame] | None = None, pages: DataFrame | None = None, mode: str = "full") -> VersionResult:
        """Crawls (fetch) or takes pages (url, html, etag?, last_modified?), and stores their chunks. software may be a
        URL or a name the registry lacks; then its place is discovered."""
        if mode == "incremental":
            return self.update(software, pages=pages, fetch=fetch)[0]
        if mode != "full":
            raise ValueError(f"unknown mode {mode}")
        entry, model, started, run = self._entry(software), self.config["embeddings"]["model"], time.time(), uuid.uuid4().hex
        place = {"base_url": entry["base_url"] if entry else None, "latest_version": entry["latest"] if entry else "latest"}
        if pages is None and fetch is not None and (entry is None or entry["strategy"] != "explicit"):
            place = self.discover(software, fetch)
            software = place["name"]
            entry = self._entry(software)
        version = version or place["latest_version"] or "latest"
        r = VersionResult(software, version)
        self._run_row(run, r, mode, "running", started, model)
        self.events.emit("index_started", software=software, version=version)
        try:
            with self._timed(r, "crawl"):
                if pages is None:
                    if fetch is None or not place["base_url"]:
                        raise ValueError("index needs pages, or a fetcher and a place to start from")
                    base = place["base_url"].rstrip("/") + "/"
                    start = base if entry is None else f"{base}{version}/"
                    include, exclude = ([g.replace("{version}", version) for g in (entry or {}).get(k, [])] for k in ("include", "exclude"))
                    c = self.config["crawler"]
                    pages = crawl.crawl(self.tables, [start], fetch, None, include, exclude, c["max_pages"], c["max_depth"], respect_robots=c["respect_robots"], hours=c["cache_ttl_hours"]).filter("status_code < 400")
            with self._timed(r, "process"):
                chunks = self.tables.stage(self.process(pages, software, version, (entry or {}).get("content_selectors"), (entry or {}).get("page_type_hints")))
                r.pages, r.embedded = pages.count(), chunks.count()
            with self._timed(r, "embed"):
                self._embed_and_store(chunks, model)
            with self._timed(r, "store"):
                self._state(chunks, pages, software, version)
                self._finish(r, entry, model)
        except Exception as e:
            r.status, r.error = "failed", str(e)[:2000]
            self._run_row(run, r, mode, "failed", started, model)
            self.events.emit("index_failed", software=software, version=version, error=r.error)
            raise
        self._run_row(run, r, mode, r.status, started, model)
        self.events.emit("index_completed", software=software, version=version, pages=r.pages, chunks=r.chunks)
        return r

    @contextmanager
    def _timed(self, r: VersionResult, stage: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            r.seconds[stage] = r.seconds.get(stage, 0.0) + time.perf_counter() - began

    def update(self, software: Name = None, pages: DataFrame | None = None, sitemap: DataFrame | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None) -> list[VersionResult]:
        """Takes over what changed of one software or of all: gone pages are dropped, of changed ones only the chunks
        that differ are embedded.

        pages is the site as it is now, or the sites; sitemap (loc, lastmod, seq), if given, tells changes without
        reading pages. Without pages `fetch` is asked: for what a sitemap (given, or the registry's) has as new or
        changed, else for every stored page under its etag and date, where 304 means unchanged and no answer, or an
        error, leaves the page as it is. Every software sees its own URLs only: those under its registry base, or on the
        hosts it has pages of. One that fails is reported as such and doesn't stop the others.
        """
        if pages is None and fetch is None:
            raise ValueError("update needs pages or a fetcher")
        names = [software] if software else [r["software"] for r in self.tables.read("indexed_software").orderBy("software").collect()]
        return [self._update_one(name, pages, sitemap, fetch) for name in names]

    def _own(self, rows: DataFrame, column: str, name: str, entry: dict | None, state: DataFrame) -> DataFrame:
        if "software" in rows.columns:
            return rows.filter(F.col("software") == name).drop("software")
        if entry:
            base = entry["base_url"].rstrip("/")
            return rows.filter((F.col(column) == base) | F.col(column).startswith(base + "/"))
        hosts = state.select(U.host(F.col("url")).alias("__host")).distinct()
        return rows if state.isEmpty() else rows.join(hosts, U.host(F.col(column)) == F.col("__host"), "left_semi")

    def _changes(self, r: VersionResult, entry: dict | None, state: DataFrame, pages: DataFrame | None, sitemap: DataFrame | None, fetch: Callable | None) -> tuple[DataFrame, DataFrame]:
        """(changes: url, change_type; the pages that are new or changed)"""
        own = lambda rows, column: self._own(rows, column, r.software, entry, state)
        if sitemap is None and pages is None:
            sitemap = self._sitemap(entry, fetch)
        if sitemap is not None:
            delta = self.tables.stage(changes.detect_changes(own(sitemap, "loc"), state))
        elif pages is not None:
            delta = self.tables.stage(changes.detect_changes(own(pages, "url").select(F.col("url").alias("loc"), F.lit(None).cast("string").alias("lastmod"), F.lit(0).alias("seq")), state))
        else:
            asked = state.select("url", "etag", "last_modified")
            if state.isEmpty() and entry:
                asked = self.spark.createDataFrame([(f"{entry['base_url'].rstrip('/')}/{r.version}", None, None)], "url string, etag string, last_modified string")
            answers = self.tables.stage(fetch(asked))
            return changes.without_sitemap(asked, answers).select("url", "change_type"), answers.filter("status_code < 400 and status_code <> 304")
        touched = delta.filter("change_type in ('new', 'changed')").select("url", "lastmod")
        if pages is None:
            pages = fetch(touched.join(state.select("url", "etag", F.lit(None).cast("string").alias("last_modified")), "url", "left").drop("lastmod")).filter("status_code < 400 and status_code <> 304")
        found = own(pages, "url").join(touched, "url")
        had = F.col("last_modified") if "last_modified" in found.columns else F.lit(None).cast("string")
        return delta, self.tables.stage(found.withColumn("last_modified", F.coalesce("lastmod", had)).drop("lastmod"))

    def _update_one(self, name: str, pages: DataFrame | None, sitemap: DataFrame | None, fetch: Callable | None) -> VersionResult:
        version, model, started, run = self._version(name, None), self.config["embeddings"]["model"], time.time(), uuid.uuid4().hex
        entry, r = self._entry(name), VersionResult(name, version)
        self._run_row(run, r, "incremental", "running", started, model)
        self.events.emit("update_started", software=name, version=version)
        try:
            mine = (F.col("software") == name) & (F.col("version") == version)
            with self._timed(r, "detect"):
                delta, touched = self._changes(r, entry, self.tables.read("page_state").filter(mine), pages, sitemap, fetch)
            with self._timed(r, "process"):
                chunks = self.tables.stage(self.process(touched, name, version, (entry or {}).get("content_selectors"), (entry or {}).get("page_type_hints")))
                removed = self.tables.stage(delta.filter("change_type = 'removed'").select("url"))
                old = self.tables.read("chunk_state").filter(mine)
                affected = old.join(touched.select(F.col("url").alias("page_url")), "page_url", "left_semi")
                diff = self.tables.stage(changes.diff_chunks(chunks.select(F.col("url").alias("page_url"), "chunk_id", "content_hash"), affected))
                fresh = chunks.join(diff.filter("action in ('add', 'updated')").select("chunk_id"), "chunk_id", "left_semi")
                gone = diff.filter("action = 'remove'").select("chunk_id").unionByName(old.join(removed.select(F.col("url").alias("page_url")), "page_url", "left_semi").select("chunk_id"))
                gone = self.tables.stage(gone)
                r.embedded, r.pages = fresh.count(), touched.count()
            with self._timed(r, "embed"):
                new = self._embedded(fresh, model) if r.embedded else None
                self.vectors.write(new, gone.withColumns({"software": F.lit(name), "version": F.lit(version)}))
            with self._timed(r, "store"):
                self._state(chunks, touched, name, version, removed, gone)
                self._finish(r, entry, model)
        except Exception as e:
            r.status, r.error = "failed", str(e)[:2000]
            self._run_row(run, r, "incremental", "failed", started, model)
            self.events.emit("update_failed", software=name, version=version, error=r.error)
            return r
        self._run_row(run, r, "incremental", r.status, started, model)
        self.events.emit("update_completed", software=name, version=version, pages=r.pages, embedded=r.embedded)
        return r

    def reembed(self, software: str, model: str, version: Name = None) -> VersionResult:
        """Embeds all chunks of a version with another model, into that model's collection; the old one stays."""
        embed.provider(model)
        r = VersionResult(software, self._version(software, version))
        old_key = self.tables.read("indexed_versions").filter((F.col("software") == software) & (F.col("version") == r.version)).select("embedding_model").first()
        if old_key is None:
            raise ValueError(f"{software} {r.version} isn't indexed")
        rows = self.vectors.read(software, r.version, old_key[0])
        r.embedded = rows.count()
        self._embed_and_store(rows.drop("vector", "embedding_model", "embedding_dimension", "model_hash"), model)
        self._finish(r, self._entry(software), model)
        return r

    def search(self, query: str, software: str, version: Name = None, k: int = 10, filters: dict | None = None, model: str | None = None) -> DataFrame:
        """The k chunks nearest to a query, best first, from the one partition of software, version and model."""
        model = model or self.config["embeddings"]["model"]
        vector = embed.provider(model)[0]([query])[0]
        return self.vectors.search(vector.tolist(), software, self._version(software, version), model, k, filters, self.config["storage"]["metric"])

    def search_many(self, queries: DataFrame, software: str, version: Name = None, k: int = 10, model: str | None = None) -> DataFrame:
        """The same for a table of queries (qid, text), in one pass over the chunks."""
        model = model or self.config["embeddings"]["model"]
        q = embed.embed_texts(queries, model, "text").select("qid", F.col("vector").alias("qvector"))
        rows = self.vectors.read(software, self._version(software, version), model)
        return search.top_k_batch(rows, q, k, self.config["storage"]["metric"]).drop("vector")

    def list_indexed(self) -> DataFrame:
        versions = self.tables.read("indexed_versions")
        sums = versions.groupBy("software").agg(F.array_sort(F.collect_list("version")).alias("versions"), F.sum("page_count").alias("pages"), F.sum("chunk_count").alias("chunks"), F.max("indexed_at").alias("indexed_at"))
        return self.tables.read("indexed_software").select("software", "display_name").join(sums, "software", "left").orderBy("software")

    def stats(self, software: str) -> dict:
        if self.tables.read("indexed_software").filter(F.col("software") == software).isEmpty():
            raise ValueError(f"{software} isn't indexed")
        v = self.tables.read("indexed_versions").filter(F.col("software") == software).agg(F.count("*"), F.coalesce(F.sum("chunk_count"), F.lit(0))).first()
        return {"software": software, "versions": v[0], "pages": self.tables.read("page_state").filter(F.col("software") == software).count(), "chunks": v[1]}

    def delete(self, software: str, version: Name = None):
        mine = F.col("software") == software
        if version:
            mine &= F.col("version") == version
        self.vectors.delete(software, version)
        for name in ("chunk_state", "page_state", "indexed_versions"):
            self.tables.delete(name, mine)
        if not version or not self.versions(software):
            self.tables.delete("indexed_software", F.col("software") == software)
        self.events.emit("deleted", software=software, version=version)

    def runs(self, software: Name = None, limit: int = 20) -> DataFrame:
        rows = self.tables.read("pipeline_runs")
        return (rows.filter(F.col("software") == software) if software else rows).orderBy(F.desc("started_at")).limit(limit)
