"""State tables as immutable Parquet segments behind numbered manifests."""

from __future__ import annotations

import json
import urllib.parse
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import latest, upsert

SCHEMAS = {
    "indexed_software": "software string, display_name string, config_snapshot string, last_indexed_at timestamp",
    "indexed_versions": "software string, version string, page_count long, chunk_count long, embedding_model string, embedding_dimension int, indexed_at timestamp",
    "page_state": "url string, software string, version string, content_hash string, etag string, last_modified string, last_crawled_at timestamp",
    "chunk_state": "chunk_id string, page_url string, content_hash string, software string, version string",
    "pipeline_runs": "run_id string, software string, version string, mode string, status string, pages long, chunks long, model string, error string, started_at timestamp, completed_at timestamp",
    "crawl_queue": "url string, depth int, priority int, status string",
    "response_cache": "url string, status_code int, html string, etag string, last_modified string, fetched_at timestamp, expires_at timestamp",
    "embedding_cache": "model_name string, content_hash string, vector array<float>, created_at timestamp",
    "vectors": "chunk_id string, content string, vector array<float>, software string, version string, model_hash string, url string, title string, page_type string, breadcrumb array<string>, section_heading string, chunk_index int, total_chunks int, has_code boolean, code_languages array<string>, content_hash string, parent_page_id string, crawl_timestamp timestamp, embedding_model string, embedding_dimension int, producer_version string",
}
KEYS = {
    "indexed_software": ["software"], "indexed_versions": ["software", "version"], "page_state": ["software", "version", "url"], "chunk_state": ["software", "version", "chunk_id"], "pipeline_runs": ["run_id"],
    "crawl_queue": ["url"], "response_cache": ["url"], "embedding_cache": ["model_name", "content_hash"], "vectors": ["software", "version", "model_hash", "chunk_id"],
}
PARTITIONS = {"vectors": ["software", "version", "model_hash"], "page_state": ["software", "version"], "chunk_state": ["software", "version"], "embedding_cache": ["model_name"]}
#: Tables whose upserts append a segment; of a key that several segments hold the last one counts.
LOGS = {"pipeline_runs", "crawl_queue", "response_cache", "embedding_cache"}
#: Segments of a log after which the next write compacts it.
SEGMENTS = 16


class Conflict(RuntimeError):
    """Another writer changed the same partitions in between."""


class Tables:
    """Tables under one folder: seg=<id>/<partition folders> of Parquet, and manifests that list which folder holds
    each partition now.

    A write adds a segment with the partitions it touches and then a manifest with the next number; creating that file
    fails if another writer took the number, and the change is then made on top of theirs, unless both touched one
    partition. Readers never see half of a write, and a read before a write keeps seeing the old rows. Partitions that
    a write doesn't touch are neither read nor written; filters on partition columns prune folders.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._bytes = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._empty = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}

    # -- manifests: partition values -> folders, oldest first

    def _manifest(self, name: str) -> tuple[int, list[tuple[tuple[str, ...], str]]]:
        found = sorted(x.getPath().getName() for x in self._fs.globStatus(self._path(f"{self.root}/{name}/manifest-*")) or ())
        if not found:
            return 0, []
        stream = self._fs.open(self._path(f"{self.root}/{name}/{found[-1]}"))
        try:
            rows = json.loads(bytes(self._bytes.toByteArray(stream)).decode())
        finally:
            stream.close()
        return int(found[-1].split("-")[1]), [(tuple(p), f) for p, f in rows]

    def _commit(self, name: str, seen: list, touched: set | None, change: Callable[[list], list]) -> None:
        """Writes change(manifest) as the next one; `touched` partitions must still be as in `seen` (None: all)."""
        for _ in range(20):
            n, now = self._manifest(name)
            own = lambda m: [x for x in m if touched is None or x[0] in touched]
            if own(now) != own(seen):
                raise Conflict(f"{name} was changed by another writer")
            try:
                out = self._fs.create(self._path(f"{self.root}/{name}/manifest-{n + 1:012d}"), False)
            except Exception as e:
                if "exist" not in str(e).lower():
                    raise
                continue
            out.write(bytearray(json.dumps(change(now)).encode()))
            out.close()
            return
        raise Conflict(f"{name} is written by too many at once")

    def _write(self, name: str, rows: DataFrame) -> list[tuple[tuple[str, ...], str]]:
        """A new segment of rows: its partitions and their folders."""
        keys, seg = PARTITIONS.get(name, []), f"seg={uuid.uuid4().hex}"
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._empty[name].schema])
        writer = typed.write.option("compression", "zstd")
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{self.root}/{name}/{seg}")
        if not keys:
            return [((), seg)]
        found = self._fs.globStatus(self._path(f"{self.root}/{name}/{seg}/" + "/".join(f"{k}=*" for k in keys))) or ()
        folders = [x.getPath().toString().split(f"/{name}/{seg}/", 1)[1] for x in found]
        return [(tuple(urllib.parse.unquote(p.split("=", 1)[1]) for p in f.split("/")), f"{seg}/{f}") for f in folders]

    def _load(self, name: str, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self._empty[name]
        schema = SCHEMAS[name] + ", seg string" * (name in LOGS)
        df = self.spark.read.option("basePath", f"{self.root}/{name}").schema(schema).parquet(*[f"{self.root}/{name}/{f}" for f in folders])
        if name not in LOGS:
            return df.select(*self._empty[name].columns)
        order = {f.split("/")[0]: k for k, f in enumerate(folders)}
        if len(order) == 1:
            return df.select(*self._empty[name].columns)
        seq = F.create_map(*[F.lit(x) for s, k in order.items() for x in (s.removeprefix("seg="), k)])[F.col("seg")]
        return latest(df.withColumn("__seq", seq).select(*self._empty[name].columns, "__seq"), KEYS[name], "__seq").drop("__seq")

    # -- reads and writes

    def read(self, name: str) -> DataFrame:
        return self._load(name, [f for _, f in self._manifest(name)[1]])

    def replace(self, name: str, rows: DataFrame) -> None:
        """Rows become the table; earlier segments stay until vacuum()."""
        _, seen = self._manifest(name)
        new = self._write(name, rows)
        self._commit(name, seen, None, lambda now: new)

    def stage(self, rows: DataFrame) -> DataFrame:
        """Rows written once, for plans that read them several times; under staging, until vacuum("staging")."""
        path = f"{self.root}/staging/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows win by key. Logs get a segment more; of other tables the partitions that rows fall in are rewritten."""
        rows = rows.select(*self._empty[name].columns)
        if name not in LOGS:
            return self.merge(name, rows)
        _, seen = self._manifest(name)
        new = self._write(name, rows.dropDuplicates(KEYS[name]))
        self._commit(name, seen, set(), lambda now: [*now, *new])
        if len({f.split("/")[0] for _, f in self._manifest(name)[1]}) > SEGMENTS:
            self.compact(name)

    def merge(self, name: str, rows: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Drops the rows that `gone` matches in all its columns, then upserts rows; only in the partitions concerned."""
        keys = PARTITIONS.get(name, [])
        _, seen = self._manifest(name)
        touched = {p for p, _ in seen} if not keys else set()
        for df in (rows, gone):
            if df is not None and keys:
                own = [k for k in keys if k in df.columns]
                values = {tuple(str(x) for x in r) for r in df.select(*own).distinct().collect()}
                touched |= {p for p, _ in seen if tuple(p[keys.index(k)] for k in own) in values}
        old = self._load(name, [f for p, f in seen if p in touched])
        if gone is not None:
            old = old.join(gone, gone.columns, "left_anti")
        new = self._write(name, old if rows is None else upsert(old, rows.select(*self._empty[name].columns), KEYS[name]))
        concerned = touched | {p for p, _ in new}
        self._commit(name, seen, concerned, lambda now: [x for x in now if x[0] not in concerned] + new)

    def delete(self, name: str, condition: Column) -> None:
        """Drops the rows of a condition: whole partitions from the manifest if it asks for no more, else the partitions
        that hold such rows are rewritten."""
        keys, (_, seen) = PARTITIONS.get(name, []), self._manifest(name)
        if not seen:
            return
        if keys:
            parts = self.spark.createDataFrame(sorted({p for p, _ in seen}), ", ".join(f"{k} string" for k in keys))
            try:
                dropped = {tuple(r) for r in parts.filter(condition).collect()}
            except AnalysisException:
                pass
            else:
                return self._commit(name, seen, dropped, lambda now: [x for x in now if x[0] not in dropped])
        rows = self.read(name)
        touched = {tuple(str(x) for x in r) for r in rows.filter(condition).select(*keys).distinct().collect()} if keys and name not in LOGS else {p for p, _ in seen}
        old = self._load(name, [f for p, f in seen if p in touched])
        new = self._write(name, old.filter(~F.coalesce(condition, F.lit(False))))
        self._commit(name, seen, touched | {p for p, _ in new}, lambda now: [x for x in now if x[0] not in touched] + new)

    def compact(self, name: str) -> None:
        """Writes the segments of a log as one."""
        _, seen = self._manifest(name)
        new = self._write(name, self._load(name, [f for _, f in seen]))
        old = set(seen)
        self._commit(name, seen, set(), lambda now: new + [x for x in now if x not in old])

    def vacuum(self, name: str) -> None:
        """Deletes what the last manifest doesn't list."""
        n, now = (0, []) if name == "staging" else self._manifest(name)
        keep = {f.split("/")[0] for _, f in now} | {f"manifest-{n:012d}"}
        for x in self._fs.listStatus(self._path(f"{self.root}/{name}")):
            if x.getPath().getName() not in keep:
                self._fs.delete(x.getPath(), True)


def cached(tables: Tables, at: Column | None = None) -> DataFrame:
    """Responses that have not expired at a time, by default now."""
    return tables.read("response_cache").filter(F.col("expires_at") > (F.current_timestamp() if at is None else at))
