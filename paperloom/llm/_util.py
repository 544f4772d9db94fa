"""Shared pieces of the training-data operators: scratch tables and skew-safe joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import ensure_importable, spread

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of every text rule here: runs of anything but ASCII blanks; the same as bytes.split().
WORD = r"[^\x20\x09-\x0D]+"
_UPPER_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_own_dir: list[str] = []
_made: list[tuple[SparkSession, str]] = []
#: Catalog tables over scratch folders, dropped with them.
_tables: list[tuple[SparkSession, str]] = []


def ascii_lower(raw: bytes) -> bytes:
    """Lower-cases A-Z and leaves every other byte of UTF-8 text as it is."""
    return raw.translate(_UPPER_LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="paperloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


class Workspace:
    """Written tables that cut lineage and survive the loss of executors.

    Tables stay until release() as the frames an operator returns read them lazily.
    """

    def __init__(self, spark: SparkSession, tag: str):
        ensure_importable(spark)
        self.spark, self.path = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        _made.append((spark, self.path))

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes every scratch table made so far; results computed from them must have been written before."""
    while _tables:
        spark, name = _tables.pop()
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    while _made:
        spark, path = _made.pop()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    while _own_dir:
        shutil.rmtree(_own_dir.pop(), ignore_errors=True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ensure_importable(spark)
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return spread(rows) if table == "documents" else rows


def arrow_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a generator for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about `most` bytes together, at least one text each; keeps vectorised passes small."""
    i = total = 0
    for j, t in enumerate(texts):
        if j > i and total + len(t) > most:
            yield i, j
            i, total = j, 0
        total += len(t)
    if i < len(texts):
        yield i, len(texts)


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], n: str) -> DataFrame:
    """Inner join of rows with one row per key, safe against hot keys.

    `n` counts a key's rows; keys with more than a thousandth of its sum are fewer than 1000, hence broadcast
    whatever the size of the data, and every other key is small enough for one task of a shuffled join.
    """
    keys = [key] if isinstance(key, str) else key
    total, most = groups.agg(F.sum(n), F.max(n)).first()
    limit = max((total or 0) // 1000, 20_000)
    if (most or 0) <= limit:
        return rows.join(groups, keys)
    hot = groups.filter(F.col(n) > limit)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.filter(F.col(n) <= limit), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def row_key() -> list:
    """What finds a row again without a shuffle of texts to number it: its doc_id and a hash of its text."""
    return [F.col("doc_id").cast("bigint").alias("__id"), F.xxhash64("text").alias("__h")]


def select_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose key is in `kept` (__id, __h, copies: rows of docs with that key), one row for each key.

    The hash table is built of the short keys; texts stream through and are not sorted.
    """
    columns = docs.columns
    tagged = docs.select("*", *row_key())
    keys = kept.select(F.col("__id").alias("__a"), F.col("__h").alias("__b"), "copies")
    both = lambda k: tagged.join(k.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("__a")) & (F.col("__h") == F.col("__b")), "left_semi")
    repeated = keys.filter("copies > 1")
    if repeated.isEmpty():
        return both(keys).select(*columns)
    return both(keys.filter("copies = 1")).unionByName(both(repeated).dropDuplicates(["__id", "__h"])).select(*columns)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))
