"""Language-model scoring by compression: how much better an in-domain dictionary compresses a text than a general one."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import ensure_importable

from ._util import Workspace, documents, raw_texts, slices
from .dsir import kth_largest
from .hashing import SLICE, Substrings, mix, word_bounds

QUERY = "op10_compression_lm"
#: In-domain ids that are broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Bytes of a word; longer runs without a blank (scripts that write without) count as several.
LONGEST = 64


def _marked(docs: DataFrame, domain: DataFrame | np.ndarray) -> DataFrame:
    """inside (is the document's id in the domain), text; of every in-domain id, however many there are."""
    if isinstance(domain, np.ndarray):
        domain = docs.sparkSession.createDataFrame([(int(x),) for x in domain], "doc_id long")
    ids = domain.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("__d")).distinct()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    inside = F.col("__d").isNotNull().alias("inside")
    if ids.limit(BROADCAST + 1).count() <= BROADCAST:
        return rows.join(F.broadcast(ids), F.col("doc_id") == F.col("__d"), "left").select(inside, "text")
    # the hash table is built of the ids; null ids would all go to one task
    known = rows.filter("doc_id is not null").join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("__d"), "left")
    return known.select(inside, "text").unionByName(rows.filter("doc_id is null").select(F.lit(False).alias("inside"), "text"))


def _pieces(raw: bytes, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs without a blank, those of more than LONGEST bytes cut into pieces: where the hash of the six bytes before is a
    multiple of 16, hence at the same places of equal passages, and after LONGEST bytes at the latest."""
    long = np.flatnonzero(e - s > LONGEST)
    if not len(long):
        return s, e
    buf = np.frombuffer(raw, np.uint8)
    starts, ends = [np.delete(s, long)], [np.delete(e, long)]
    for a, b in zip(s[long].tolist(), e[long].tolist()):
        cut = a + 6 + np.flatnonzero(mix(Substrings(buf[a:b]).windows(6))[:-1] % np.uint64(16) == 0)
        at = [a]
        for x in [*cut.tolist(), b]:
            while x - at[-1] > LONGEST:
                at.append(at[-1] + LONGEST)
            if x > at[-1]:
                at.append(x)
        starts.append(np.array(at[:-1])), ends.append(np.array(at[1:]))
    s, e = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def _counted():
    """Words of all texts, counted in each slice before they move: word, in all, in the domain's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            inside = batch.column("inside").to_numpy(zero_copy_only=False)
            for i, j in slices(texts):
                part = texts[i:j]
                raw = b" ".join(part)
                for at, end in _windows(raw):
                    some = raw[at:end]
                    buf = np.frombuffer(some, np.uint8)
                    s, e = _pieces(some, *word_bounds(buf))
                    h = mix(Substrings(buf).hash(s, e) + (e - s).astype(np.uint64)) if len(s) else np.zeros(0, np.uint64)
                    ends = np.cumsum([len(t) + 1 for t in part])
                    owner = inside[i:j][np.searchsorted(ends, s + at, "right")]
                    kinds, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                    own = np.bincount(back, owner, len(kinds)).astype(np.int64)
                    words = [some[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())]
                    yield pa.record_batch([pa.array(words, pa.binary()), pa.array(n), pa.array(own)], ["word", "n", "own"])

    return run


def _windows(raw: bytes, most: int = 2 * SLICE) -> Iterator[tuple[int, int]]:
    """Parts of a long text, cut after a blank where there is one."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > most:
            cut = max(raw.rfind(b, at, at + most) for b in (b" ", b"\n", b"\t"))
            end = cut + 1 if cut > at else at + most
        yield at, end
        at = end


def _room(counts: DataFrame) -> int:
    """Bytes of a dictionary: 8 times the root of the bytes of all counted words, 65,536 at least, without an upper limit."""
    total = counts.agg(F.sum(F.col("n") * (F.length("word") + 1))).first()[0]
    return max(65_536, 8 * math.isqrt(total or 0))


def dictionaries(docs: DataFrame, domain: DataFrame | np.ndarray, size: int | None = None) -> tuple[bytes, bytes]:
    """(in-domain, general) dictionary contents of at most `size` bytes each; by default that grows with the corpus.

    Words (pieces of at most LONGEST bytes where blanks are rarer) are counted over all documents, and over those of the
    domain (doc_ids); those that save most, by count and length, are laid out with the best last, where references to them are shortest. Only the words that can get in (at
    most size / 4 of each ranking) come to the driver: the least gain among them is found first.
    """
    ensure_importable(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "lm")
    counts = _marked(docs, domain).mapInArrow(_counted(), "word binary, n long, own long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    counts = ws.save(counts.filter("n > 1"), "words")
    size = _room(counts) if size is None else size
    out = []
    for column in ("own", "n"):
        gain = F.col(column) * (F.length("word") + 1)
        ranked = counts.filter(F.col(column) > 1).select("word", gain.cast("double").alias("gain"))
        least = kth_largest(ranked, "gain", min(size // 4, ranked.count()))
        best = ranked.filter(F.col("gain") >= (least or 0)).orderBy(F.desc("gain"), "word").limit(size // 4).collect()
        content, room = [], size
        for r in best:
            piece = bytes(r["word"]) + b" "
            if len(piece) > room:
                break
            content.append(piece)
            room -= len(piece)
        out.append(b"".join(reversed(content)))
    return out[0], out[1]


def _sizes(content: bytes, level: int):
    """Compresses with the dictionary; window and tables are as large as it takes to reach all of it."""
    data, how = None, zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
    if len(content) >= 8:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        if len(content) <= 1 << 17:  # the level's own tables hold every place
            data.precompute_compress(level=level)
        else:
            bits = len(content).bit_length()
            how = zstandard.ZstdCompressionParameters.from_level(
                level, window_log=max(bits + 1, how.window_log), hash_log=max(bits, how.hash_log), chain_log=max(bits, how.chain_log), write_content_size=False, write_checksum=False, write_dict_id=False
            )
            data.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=data).compress


def scores(docs: DataFrame, domain: DataFrame | np.ndarray, size: int | None = None, level: int = 3) -> DataFrame:
    """One row per document: doc_id, n_bytes, domain_bytes, general_bytes, score. `domain` holds doc_ids.

    score = (general - in-domain) / larger of both compressed sizes of the whole text: higher for texts like the
    domain's, 0 for null and empty texts and where neither dictionary helps. Repeated rows score alike, an empty table
    gives no rows, and columns other than doc_id and text play no part. Without in-domain documents that dictionary
    is empty.
    """
    contents = docs.sparkSession.sparkContext.broadcast(dictionaries(docs, domain, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, general = (_sizes(c, level) for c in contents.value)
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            a = np.array([len(own(t)) if t else 0 for t in texts], np.int64)
            b = np.array([len(general(t)) if t else 0 for t in texts], np.int64)
            score = (b - a) / np.maximum(np.maximum(a, b), 1)
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(a), pa.array(b), pa.array(score)], ["doc_id", "n_bytes", "domain_bytes", "general_bytes", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, domain_bytes long, general_bytes long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels").filter("quality = 1"))
