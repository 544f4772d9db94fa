"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Workspace, _tables, arrow_rows, ascii_lower, documents, join_groups, raw_texts, row_key, select_rows

QUERY = "op9_exact_dedup"


def _digest_batch(batch: pa.RecordBatch):
    seen = [hashlib.sha256(ascii_lower(t)).digest() for t in raw_texts(batch.column("text"))]
    yield pa.record_batch([*[batch.column(c) for c in ("uid", "__id", "__h")], pa.array(seen, pa.binary())], ["uid", "__id", "__h", "digest"])


class DigestIndex:
    """Digests seen so far, as an external Parquet table bucketed and sorted by digest.

    A look-up is a sort-merge anti-join that reads the index bucket by bucket without shuffling it; only the new
    digests move. Digests are spread evenly by construction, so no bucket is hot. Every digest has the name of the
    batch that brought it: a batch that is run again doesn't find itself, and what it already appended isn't appended
    twice. Appended files make buckets unsorted until compact() writes the next generation, one sorted file a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, scratch: bool = False):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = "paperloom_digests_" + hashlib.sha256(self.path.encode()).hexdigest()[:32]
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at, self._fs = hadoop.Path, hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.generation = max((int(g.split("-")[1]) for g in self._listed("done-*")), default=0)
        self._open(scratch)

    def _listed(self, pattern: str) -> list[str]:
        return [x.getPath().getName() for x in self._fs.globStatus(self._at(f"{self.path}/{pattern}")) or ()]

    @property
    def table(self) -> str:
        return f"{self.name}_{self.generation}"

    @property
    def files(self) -> str:
        return f"{self.path}/gen-{self.generation}"

    def _open(self, scratch: bool) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, doc_id BIGINT, batch STRING) USING parquet LOCATION '{self.files}' "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )
        self.scratch = scratch
        if scratch:
            _tables.append((self.spark, self.table))

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame, batch: str | None = None) -> DataFrame:
        """Rows of `groups` (one per digest) that the index lacks; what `batch` itself appended doesn't count."""
        known = self.read()
        if batch is not None:
            known = known.filter(~F.col("batch").eqNullSafe(F.lit(batch)))
        return groups.join(known.select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str | None = None) -> None:
        """Adds the digests the index lacks; one file for each bucket, written sorted. Call it once the results that
        rest on the look-up are written: a run that dies before that leaves the index as it was."""
        rows = self.unseen(groups.select("digest", F.col("doc_id").cast("bigint").alias("doc_id"))).withColumn("batch", F.lit(batch).cast("string"))
        rows = rows.repartition(self.buckets, "digest")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.files).saveAsTable(self.table)

    def compact(self) -> None:
        """Writes all digests as the next generation, one sorted file a bucket, marks it done and drops the old one."""
        old_table, old_files = self.table, self.files
        rows = self.spark.read.schema(self.read().schema).parquet(old_files)  # as plain files, so that repartition() gathers buckets
        self.generation += 1
        self._fs.delete(self._at(self.files), True)  # of a compaction that died
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self._open(self.scratch)
        rows.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.files).saveAsTable(self.table)
        self._fs.create(self._at(f"{self.path}/done-{self.generation}")).close()
        self.spark.sql(f"DROP TABLE IF EXISTS {old_table}")
        self._fs.delete(self._at(old_files), True)


def digests(docs: DataFrame) -> DataFrame:
    """uid, the key of the row (doc_id and a hash of its text) and SHA-256 of each text with A-Z lower-cased (null as empty)."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), *row_key(), "text")
    return arrow_rows(rows, _digest_batch, "uid long, __id long, __h long, digest binary")


def verdicts(docs: DataFrame, index: DigestIndex | None = None, buckets: int = 64, batch: str | None = None) -> DataFrame:
    """One row per document: uid, __id, __h (its key), doc_id, digest, keep_id, group_size, kept, is_new.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest doc_id
    stays (of repeated rows with that id, one). Null doc_ids lose to any other and are kept only where alone.
    A text that an earlier batch brought into the index is not new: none of its rows is kept. The index is only read;
    ingest() or index.append() adds new digests once the result is written. Without an index a scratch one is made.
    An empty table gives no rows. Columns other than doc_id and text play no part, whatever their names.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "exact")
    rows = ws.save(digests(docs), "digests")
    best = F.max(F.struct(F.col("__id").alias("doc_id"), "uid"))
    groups = ws.save(rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    if index is None:
        index = DigestIndex(spark, f"{ws.path}/index", buckets, scratch=True)
    fresh = ws.save(index.unseen(groups.select("digest"), batch), "fresh")
    if fresh.count() == groups.count():
        groups = groups.withColumn("is_new", F.lit(True))
    else:
        groups = groups.join(fresh.withColumn("is_new", F.lit(True)), "digest", "left").fillna(False, ["is_new"])
    joined = join_groups(rows, groups, "digest", "group_size")
    return joined.select(
        "uid", "__id", "__h", F.col("__id").alias("doc_id"), "digest", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("is_new") & (F.col("uid") == F.col("best.uid"))).alias("kept"), "is_new",
    )


def _kept(docs: DataFrame, index: DigestIndex | None, batch: str | None) -> tuple[DataFrame, DataFrame]:
    """(the documents that stay, verdicts)"""
    ws = Workspace(docs.sparkSession, "exact-rows")
    out = ws.save(verdicts(docs, index, batch=batch), "verdicts")
    copies = out.groupBy("__id", "__h").agg(F.count("*").alias("copies"), F.bool_or("kept").alias("kept"))
    return select_rows(docs, ws.save(copies.filter("kept"), "kept")), out


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns; repeated rows of one document are cut to one, of texts that
    only null doc_ids have one row stays, null texts are equal to empty ones, an empty table stays empty."""
    return _kept(docs, index, batch)[0]


def ingest(docs: DataFrame, index: DigestIndex, batch: str, path: str) -> DataFrame:
    """Deduplicates a batch against the index, writes what stays to `path` as Parquet, and appends its digests then.

    Safe to repeat under the same batch name after a failure at any point: what an earlier try wrote is overwritten,
    and digests it appended don't count as seen. Null, equal and empty cases are those of verdicts().
    """
    kept, out = _kept(docs, index, batch)
    kept.write.mode("overwrite").option("compression", "zstd").parquet(path)
    index.append(out.filter("kept").select("digest", "doc_id"), batch)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
