"""Removal of repeated passages: every byte under a window of `size` bytes that also starts anywhere else."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Workspace, arrow_rows, documents, join_groups, raw_texts, row_key, slices
from .hashing import Substrings, mix

QUERY = "op3_suffix_dedup"
_U = np.uint64
#: Bytes that one vectorised pass covers; it holds some hundred times as many.
SLICE = 1 << 20
_POSITION = _U((1 << 23) - 1)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of v[i : i + width] for every i, by minima from the left and the right of blocks."""
    n = len(v)
    full = np.full(-(-n // width) * width, np.iinfo(_U).max, _U)
    full[:n] = v
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _anchors(raw: bytes, starts: np.ndarray, ends: np.ndarray, size: int, digit: int) -> tuple[np.ndarray, ...]:
    """Runs of windows by their anchor, for documents at [starts, ends) of a buffer.

    A window's anchor is the place of its least `digit`-byte hash (the leftmost), so equal windows have equal anchors
    at equal offsets wherever they stand. Returns for each run: its document, its first and last window, its anchor,
    a hash of the anchor's bytes and one of all bytes the run covers together with its offsets.
    """
    empty = np.zeros(0, np.int64)
    keep = ends - starts >= size
    if not keep.any():
        return (empty, empty, empty, empty, empty.astype(_U), empty.astype(_U))
    buf = np.frombuffer(raw, np.uint8)
    one, two = Substrings(buf, 0), Substrings(buf, 1)
    grams = mix(one.windows(digit))
    anchor = (_sliding_min((grams & ~_POSITION) | np.arange(len(grams), dtype=_U), size - digit + 1) & _POSITION).astype(np.int64)
    doc = np.flatnonzero(keep)
    count = ends[doc] - starts[doc] - size + 1
    first = np.cumsum(count) - count
    s = np.arange(count.sum()) + np.repeat(starts[doc] - first, count)
    at = anchor[s]
    new = np.ones(len(s), bool)
    new[1:] = (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)
    begin = np.flatnonzero(new)
    low, high, a = s[begin], s[np.append(begin[1:], len(s)) - 1], at[begin]
    span = mix(two.hash(low, high + size) + ((a - low) * 4096 + a - high).astype(_U) * _U(0x9E3779B97F4A7C15))
    return doc[np.searchsorted(first, begin, "right") - 1], low, high, a, grams[a], span


def _runs(size: int, digit: int):
    """First pass: a row for each run of each document; `place` packs anchor and the offsets of the outer windows."""

    def emit(some, doc, low, high, a, key, span):
        take = pa.array(doc)
        place = (a << 24) | ((a - low) << 12) | (a - high)
        return pa.record_batch(
            [some.column("__id").take(take), some.column("__h").take(take), pa.array(place), pa.array(key.astype(np.int64)), pa.array(span.astype(np.int64))],
            ["__id", "__h", "place", "key", "span"],
        )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = raw_texts(batch.column("text"))
        for i, j in slices(texts, SLICE):
            some = batch.slice(i, j - i)
            if len(texts[i]) > 2 * SLICE:  # alone in its slice; windows of one part at a time
                for at in range(0, len(texts[i]) - size + 1, SLICE):
                    part = texts[i][at : at + SLICE + size - 1]
                    doc, low, high, a, key, span = _anchors(part, np.array([0]), np.array([len(part)]), size, digit)
                    yield emit(some, doc, low + at, high + at, a + at, key, span)
                continue
            ends = np.cumsum([len(t) for t in texts[i:j]])
            starts = ends - [len(t) for t in texts[i:j]]
            yield emit(some, *_local(_anchors(b"".join(texts[i:j]), starts, ends, size, digit), starts))

    return run


def _local(found: tuple[np.ndarray, ...], starts: np.ndarray) -> tuple[np.ndarray, ...]:
    doc, low, high, a, key, span = found
    base = starts[doc]
    return doc, low - base, high - base, a - base, key, span


def _contexts(size: int):
    """Second pass: the bytes that the wanted runs cover."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cid, key, n, place, blob = [], [], [], [], []
        for text, wanted in zip(raw_texts(batch.column("text")), batch.column("wanted").to_pylist()):
            for x in wanted:
                a, low, high = x["place"] >> 24, (x["place"] >> 12) & 4095, x["place"] & 4095
                cid.append(x["cid"]), key.append(x["key"]), n.append(x["n"]), place.append(x["place"]), blob.append(text[a - low : a - high + size])
        yield pa.record_batch([pa.array(cid, pa.int64()), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(place, pa.int64()), pa.array(blob, pa.binary())], ["cid", "key", "n", "place", "blob"])

    return run


def _digits(size: int, width: int, leaves: bool):
    """Third pass, on contexts: a row for each block of `width` offsets of a run, or (leaves) for each offset of the
    wanted blocks. `core` hashes what all windows of a block share, `span` all that the run's own windows there cover."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 1024):
            yield from some(batch.slice(at, 1024))

    def some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        blobs = batch.column("blob").to_pylist()
        place = batch.column("place").to_numpy()
        base = np.cumsum([0] + [len(x) for x in blobs])[:-1]
        far, near = (place >> 12) & 4095, place & 4095  # offsets of the first and the last window
        a = base + far
        buf = np.frombuffer(b"".join(blobs), np.uint8)
        one = Substrings(buf, 0)
        if leaves:
            blocks = batch.column("blocks")
            row = np.repeat(np.arange(len(blobs)), blocks.value_lengths().to_numpy())
            j = blocks.flatten().to_numpy()
        else:
            lo, count = near // width, far // width - near // width + 1
            row = np.repeat(np.arange(len(blobs)), count)
            j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[row]
        p, q = np.maximum(j * width, near[row]), np.minimum(j * width + width - 1, far[row])
        names = ["cid", "n", "key"]
        if leaves:
            size_of = q - p + 1
            offset = np.arange(size_of.sum()) - np.repeat(np.cumsum(size_of) - size_of, size_of) + np.repeat(p, size_of)
            row = np.repeat(row, size_of)
            start = a[row] - offset
            window = mix(one.hash(start, start + size) + offset.astype(_U))
            extra = {"offset": offset, "window": window}
        else:
            two = Substrings(buf, 1)
            core = mix(one.hash(a[row] - j * width, a[row] - j * width - width + 1 + size) + j.astype(_U))
            span = mix(two.hash(a[row] - q, a[row] - p + size) + (p * 4096 + q).astype(_U) * _U(0x9E3779B97F4A7C15))
            extra = {"block": j, "p": p, "q": q, "core": core, "span": span}
        take = pa.array(row)
        yield pa.record_batch([*(batch.column(c).take(take) for c in names), *(pa.array(x.astype(np.int64)) for x in extra.values())], [*names, *extra])

    return run


def spans(docs: DataFrame, size: int = 400, digit: int = 100, width: int = 20) -> DataFrame:
    """__id, __h (key of a document) and `spans`: packed (start << 32 | end) byte ranges of repeated windows, unmerged.

    A radix sort by most significant digits, cut off at the threshold depth, on windows in place of suffixes:
    1. first digit: windows fall under the hash of their anchor's `digit` bytes (not of their own first bytes: equal
    windows share the anchor, and one run of windows is one row); an anchor found once ends there;
    2. runs of windows whose whole extent is found twice are repeated as they stand;
    3. other runs under such an anchor are split into blocks of `width` offsets, by the next digit: the bytes that all
       windows of a block share. Found once: not repeated. Equal in whole extent to another: repeated. Else the
       block's windows are compared one by one at full depth. Equal groups are exactly the repeated windows.
    Each pass is an aggregation by hash and drops what is alone; only one run of equal ones goes on, so large groups
    of copies shrink to one row before any of them is split. Decisions rest on 128 bits of hash.
    """
    if not 0 < digit <= size < 4000 or width + digit > size:
        raise ValueError("0 < digit <= size - width and size < 4000")
    ws = Workspace(docs.sparkSession, "suffix")
    keyed = docs.select(*row_key(), "text")
    runs = ws.save(arrow_rows(keyed, _runs(size, digit), "__id long, __h long, place long, key long, span long"), "runs")
    keys = ws.save(runs.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "keys")
    again = ws.save(join_groups(runs, keys, "key", "m"), "again")
    classes = again.groupBy("key", "span").agg(F.count("*").alias("n"), F.min(F.struct("__id", "__h", "place")).alias("rep"))
    classes = ws.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    whole = join_groups(again.drop("m"), classes.filter("n > 1").select("key", "span", "n"), ["key", "span"], "n")
    a, far, near = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(4095), F.col("place").bitwiseAND(4095)
    pack = lambda start, end: F.shiftleft(start.cast("bigint"), 32).bitwiseOR(end.cast("bigint")).alias("range")
    found = whole.select("__id", "__h", pack(a - far, a - near + size))

    mixed = ws.save(classes.groupBy("key").agg(F.bool_or(F.col("n") == 1).alias("open"), F.count("*").alias("k")).filter("open and k > 1"), "mixed")
    parts = join_groups(classes, mixed, "key", "k").select("cid", "key", "n", "rep.*")
    wanted = parts.groupBy("__id", "__h").agg(F.collect_list(F.struct("cid", "key", "n", "place")).alias("wanted"))
    wanted = wanted.select(F.col("__id").alias("__a"), F.col("__h").alias("__b"), "wanted")
    same = F.col("__id").eqNullSafe(F.col("__a")) & (F.col("__h") == F.col("__b"))
    texts = keyed.join(wanted.hint("shuffle_hash"), same).select("text", "wanted")
    cut = arrow_rows(texts, _contexts(size), "cid long, key long, n long, place long, blob binary")
    contexts = ws.save(cut.dropDuplicates(["cid"]) if _repeats(docs) else cut, "contexts")

    blocks = ws.save(arrow_rows(contexts, _digits(size, width, False), "cid long, n long, key long, block long, p long, q long, core long, span long"), "blocks")
    cores = blocks.groupBy("key", "core").agg(F.sum("n").alias("seen"), F.count("*").alias("m")).filter("seen > 1")
    some = ws.save(join_groups(blocks, ws.save(cores, "cores"), ["key", "core"], "m"), "cored")
    kinds = ws.save(some.groupBy("key", "core", "span").agg(F.sum("n").alias("seen"), F.count("*").alias("k")), "kinds")
    open_ = ws.save(kinds.groupBy("key", "core").agg(F.bool_or(F.col("seen") == 1).alias("open"), F.sum("k").alias("k")).filter("open"), "open")
    repeated = join_groups(some.filter("n = 1").drop("seen", "m"), kinds.filter("seen > 1"), ["key", "core", "span"], "k").select("cid", "p", "q")
    deeper = join_groups(some.select("cid", "block", "key", "core"), open_, ["key", "core"], "k")
    deeper = deeper.groupBy("cid").agg(F.collect_list("block").alias("blocks"))
    leaves = arrow_rows(contexts.join(deeper, "cid"), _digits(size, width, True), "cid long, n long, key long, offset long, window long")
    leaves = ws.save(leaves, "leaves")
    twice = ws.save(leaves.groupBy("key", "window").agg(F.sum("n").alias("seen"), F.count("*").alias("k")).filter("seen > 1"), "twice")
    single = join_groups(leaves.filter("n = 1").drop("n"), twice, ["key", "window"], "k").select("cid", F.col("offset").alias("p"), F.col("offset").alias("q"))
    at = classes.filter("n = 1").select("cid", "rep.*")
    parts = repeated.unionByName(single).join(at, "cid").select("__id", "__h", pack(a - F.col("q"), a - F.col("p") + size))
    return found.unionByName(parts).groupBy("__id", "__h").agg(F.collect_set("range").alias("spans"))


def _repeats(docs: DataFrame) -> bool:
    """Whether some row of docs is there twice: its text would be found twice."""
    return not docs.select(*row_key()).groupBy("__id", "__h").count().filter("count > 1").isEmpty()


def _removal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size, removed, runs, digest, ranges = [], [], [], [], []
    for text, packed in zip(raw_texts(batch.column("text")), batch.column("spans").to_pylist()):
        merged: list[list[int]] = []
        for x in sorted(packed or ()):
            start, end = x >> 32, x & 0xFFFFFFFF
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        kept, at = hashlib.sha256(), 0
        for start, end in merged:
            kept.update(text[at:start])
            at = end
        kept.update(text[at:])
        size.append(len(text)), removed.append(sum(e - s for s, e in merged)), runs.append(len(merged))
        digest.append(kept.hexdigest()), ranges.append([x for r in merged for x in r])
    columns = [pa.array(x, pa.int64()) for x in (size, removed, runs)]
    yield pa.record_batch([batch.column("doc_id"), *columns, pa.array(digest), pa.array(ranges, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "ranges"])


def _marked(docs: DataFrame, **how) -> DataFrame:
    marks = spans(docs, **how).select(F.col("__id").alias("__a"), F.col("__h").alias("__b"), "spans")
    same = F.col("__id").eqNullSafe(F.col("__a")) & (F.col("__h") == F.col("__b"))
    return docs.select("*", *row_key()).join(marks.hint("shuffle_hash"), same, "left")


def removals(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, ranges (start, end, start, end, ...).

    A byte goes if a window of `size` bytes over it also starts at another place, in the same or in another document;
    windows never cross documents and are judged on the input. Null and short texts lose nothing. Repeated rows are
    documents of their own, so whole copies lose everything (from `size` bytes on). An empty table gives no rows;
    columns other than doc_id and text play no part. Other columns of the same names don't disturb.
    """
    rows = _marked(docs.select("doc_id", "text"), **how).select(F.col("__id").alias("doc_id"), "text", "spans")
    return arrow_rows(rows, _removal, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, ranges array<long>")


def clean(docs: DataFrame, **how) -> DataFrame:
    """docs with the repeated bytes taken out of text; bytes of a character cut in two are dropped.

    All columns stay, whatever their names; null texts become empty ones, short and empty texts stay as they are,
    repeated rows are documents of their own (whole copies of `size` bytes and more end empty), an empty table stays so.
    """

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rest = []
        for text, packed in zip(raw_texts(batch.column("text")), batch.column("__spans").to_pylist()):
            keep = np.ones(len(text), bool)
            for x in packed or ():
                keep[x >> 32 : x & 0xFFFFFFFF] = False
            rest.append(np.frombuffer(text, np.uint8)[keep].tobytes().decode(errors="ignore"))
        out = batch.drop_columns(["__spans"])
        k = out.schema.get_field_index("text")
        yield out.set_column(k, "text", pa.array(rest, out.schema.field(k).type))

    rows = _marked(docs, **how).withColumnRenamed("spans", "__spans").select(*docs.columns, "__spans")
    return arrow_rows(rows, cut, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(documents(spark, sf_dir)).drop("ranges")
