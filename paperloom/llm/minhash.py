"""Near-duplicate detection by min-max hashing, banding and a check on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graphs
from ._util import Workspace, arrow_rows, ascii_lower, documents, join_groups, raw_texts, row_key, select_rows, slices
from .hashing import many_word_hashes, mix

QUERY = "op5_minhash"
_U = np.uint64
#: A group of candidates with at most so many shingles in all is compared in one task.
GROUP_SHINGLES = 8_000_000


@cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of a text's 2-word shingles; with one word, of that word."""
    if len(words) < 2:
        return mix(words ^ _U(0xA5A5A5A5A5A5A5A5))
    return np.unique(mix(words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:]))


def _texts_shingles(texts: list[bytes]) -> Iterator[np.ndarray]:
    for i, j in slices(texts):
        words, at = many_word_hashes([ascii_lower(t) for t in texts[i:j]])
        for k in range(j - i):
            yield shingles(words[at[k] : at[k + 1]])


def signature(own: np.ndarray, permutations: int) -> np.ndarray:
    """The minimum under each permutation, then the maximum under each: two values for one hash evaluation."""
    a, b = _permutations(permutations)
    low, high = np.full(permutations, 2**32 - 1, np.uint32), np.zeros(permutations, np.uint32)
    short = (own >> _U(32)).astype(np.uint32)
    for k in range(0, len(short), 512):
        x = a[:, None] * short[None, k : k + 512]
        x += b[:, None]
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return np.concatenate([low, high])


def _bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of each signature. Bands hold minima only or maxima only, so their rows are independent."""
    parts = signatures.reshape(len(signatures), -1, rows).astype(_U)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=_U), parts.shape[:2])
    for r in range(rows):
        key = mix(key * _U(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key.astype(np.int64)


def _sketch(permutations: int, rows: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = raw_texts(batch.column("text"))
        for at in range(0, len(texts), 1024):
            sets = list(_texts_shingles(texts[at : at + 1024]))
            full = [k for k, x in enumerate(sets) if len(x)]
            found = _bands(np.array([signature(sets[k], permutations) for k in full], np.uint32).reshape(len(full), -1), rows) if full else []
            bands: list = [None] * len(sets)
            for k, x in zip(full, found):
                bands[k] = x
            key = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            some = batch.slice(at, 1024)
            columns = [some.column("__id"), some.column("__h"), pa.array([len(x) for x in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["__id", "__h", "n_shingles", "set", "bands"])

    return run


def linked(sizes: np.ndarray, n: int, shared: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (sizes + n - shared)


def cluster(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The least index that each set reaches over links, exactly.

    One set against all is one pass over all shingles. A component is complete once each of its sets was compared
    with all others; smallest components go first, and the last one left needs no further look.
    """
    m = len(sets)
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    label, done = np.arange(m), np.zeros(m, bool)
    mark = np.zeros(len(values), bool)
    while True:
        size = np.bincount(label, minlength=m)
        left = np.flatnonzero(~done)
        if len(np.unique(label[left])) <= 1:
            return label
        # a component with all sets done is closed and can't grow
        u = left[np.argmin(size[label[left]])] if done.any() else int(np.argmax(sizes))
        mark[ids[starts[u] : starts[u] + sizes[u]]] = True
        shared = np.add.reduceat(mark[ids], starts)
        mark[:] = False
        hit = np.unique(label[np.flatnonzero(linked(sizes, sizes[u], shared, percent))])
        label[np.isin(label, hit)] = hit.min()
        done[u] = True


def _verify(percent: int):
    def close(sids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(sids)
        ids = np.array(sids, np.int64)[order]
        return pa.record_batch([pa.array(ids), pa.array(ids[cluster([sets[k] for k in order], percent)])], ["sid", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sids, sets = None, [], []
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            for g, sid, own in zip(batch.column("g").to_pylist(), batch.column("sid").to_pylist(), _texts_shingles(texts)):
                if g != now:
                    if sids:
                        yield close(sids, sets)
                    now, sids, sets = g, [], []
                if sid not in sids[-1:]:  # repeated rows of one document follow each other
                    sids.append(sid), sets.append(own)
        if sids:
            yield close(sids, sets)

    return run


def _within(found: list, most: int) -> list:
    """The first of (sid, shingles) that hold at most `most` shingles together, one at least."""
    room, out = most, []
    for sid, n in found:
        room -= n
        if out and room < 0:
            break
        out.append(sid)
    return out


def _large_groups(ws: Workspace, texts: DataFrame, percent: int, tag: str, at_a_time: int = 64, at_once: int = GROUP_SHINGLES) -> DataFrame:
    """Roots for groups too large for a task: their sets stay spread over all tasks, and some sets of each group, the
    smallest components' first, are compared with all of it in each round until one open component is left. The sets
    of a round, which every task gets, hold at most `at_once` shingles (8 bytes each) or are one set. A round joins its
    new links with the roots so far, so plans don't grow."""
    spark = ws.spark

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = [x.tobytes() for x in _texts_shingles(raw_texts(batch.column("text")))]
        yield pa.record_batch([batch.column("g"), batch.column("sid"), pa.array([len(x) // 8 for x in own], pa.int64()), pa.array(own, pa.binary())], ["g", "sid", "n", "own"])

    sets = ws.save(arrow_rows(texts, make, "g long, sid long, n long, own binary"), f"{tag}-sets")
    state = ws.save(sets.select("g", "sid", "n", F.col("sid").alias("root"), F.lit(False).alias("done")).distinct(), f"{tag}-state-0")
    for k in range(1, 1_000_000):
        size = state.groupBy("g", "root").agg(F.count("*").alias("size"), F.bool_and("done").alias("closed"))
        opened = size.filter("not closed")
        busy = opened.groupBy("g").agg(F.count("*").alias("open")).filter("open > 1").select("g")
        pick = state.filter("not done").join(size.select("root", "size"), "root").join(busy, "g")
        rank = F.row_number().over(W.partitionBy("g").orderBy("size", "sid"))
        # at most at_a_time sets of each group, and 512 in all
        best = pick.withColumn("rank", rank).filter(F.col("rank") <= at_a_time).orderBy("rank", "sid").limit(512)
        chosen = _within([(r["sid"], r["n"]) for r in best.select("sid", "n").collect()], at_once)
        if not chosen:
            return state.select("sid", "root")
        query = spark.sparkContext.broadcast([(r["g"], r["sid"], bytes(r["own"])) for r in sets.filter(F.col("sid").isin(chosen)).dropDuplicates(["sid"]).collect()])

        def compare(batch: pa.RecordBatch, query=query) -> Iterator[pa.RecordBatch]:
            by: dict = {}
            for g, sid, own in query.value:
                by.setdefault(g, []).append((sid, np.frombuffer(own, _U)))
            a, b = [], []
            for g, sid, own in zip(*(batch.column(c).to_pylist() for c in ("g", "sid", "own"))):
                x = np.frombuffer(own, _U)
                for other, y in by.get(g, ()):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if sid != other and 100 * shared >= percent * (len(x) + len(y) - shared):
                        a.append(other), b.append(sid)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        new = ws.save(arrow_rows(sets, compare, "a long, b long"), f"{tag}-links-{k}")
        links = new.unionByName(state.select(F.col("sid").alias("a"), F.col("root").alias("b")))
        roots = graphs.components(Workspace(spark, "near-links"), links).select(F.col("node").alias("sid"), F.col("root").alias("least"))
        state = state.withColumn("done", F.col("done") | F.col("sid").isin(chosen)).join(roots, "sid", "left")
        state = ws.save(state.select("g", "sid", "n", F.coalesce("least", "sid").alias("root"), "done"), f"{tag}-state-{k}")
    raise AssertionError


def near_groups(docs: DataFrame, percent: int = 80, permutations: int = 256, rows: int = 8, group_shingles: int = GROUP_SHINGLES, at_once: int = 2_000_000) -> DataFrame:
    """One row per document: __id, __h (its key), doc_id, n_shingles, component_id, kept, first (of its component).

    Words are runs without ASCII blanks, A-Z lower-cased; a document is the set of its distinct 2-word shingles, with
    one word of that word, without words (null, empty) nothing, linked with nothing and its own component. Links need
    100 * intersection >= percent * union of full sets. component_id is the least doc_id that links reach; of equal
    sets only one is compared. Rows with a null doc_id take part, but are no component's id unless alone (then null,
    not kept). Repeated rows are equal sets. An empty table gives no rows; other columns play no part.

    2 * permutations values in bands of `rows`: at 80 % a link shares no band with probability 8e-6 (256 and 8).
    Documents that share a band, directly or over others, form a group that is compared on full sets.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near")
    keyed = docs.select(*row_key(), "text")
    sketch = ws.save(arrow_rows(keyed, _sketch(permutations, rows), "__id long, __h long, n_shingles long, set binary, bands array<long>"), "sketch")
    own = F.struct("__id", "__h")
    sets = sketch.filter("n_shingles > 0").groupBy("set").agg(F.min("__id").alias("first_id"), F.min(own).alias("rep"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("n"), F.any_value("bands").alias("bands"))
    sets = ws.save(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")
    keys = sets.select("sid", F.explode("bands").alias("key"))
    buckets = ws.save(keys.groupBy("key").agg(F.min("sid").alias("least"), F.count("*").alias("m")).filter("m > 1"), "buckets")
    edges = join_groups(keys, buckets, "key", "m").select(F.col("sid").alias("a"), F.col("least").alias("b"))
    groups = graphs.components(ws, edges, at_once).select(F.col("node").alias("sid"), F.col("root").alias("g"))
    members = ws.save(groups.join(sets.select("sid", "rep", "n_shingles"), "sid"), "members")
    sizes = ws.save(members.groupBy("g").agg(F.sum("n_shingles").alias("shingles")), "group-sizes")
    rep = members.select("sid", "g", F.col("rep.__id").alias("__a"), F.col("rep.__h").alias("__b"))

    def texts_of(which: DataFrame) -> DataFrame:
        same = F.col("__id").eqNullSafe(F.col("__a")) & (F.col("__h") == F.col("__b"))
        return keyed.join(which.hint("shuffle_hash"), same).select("g", "sid", "text")

    large = sizes.filter(F.col("shingles") > group_shingles).select("g")
    some_large = not large.isEmpty()
    small = rep.join(large, "g", "left_anti") if some_large else rep
    roots = texts_of(small).repartition("g").sortWithinPartitions("g", "sid").mapInArrow(_verify(percent), "sid long, root long")
    if some_large:
        spread = ws.save(texts_of(rep.join(large, "g")), "large-texts")
        roots = roots.unionByName(_large_groups(ws, spread, percent, "large"))
    roots = ws.save(roots, "verified")
    found = roots.join(sets.select("sid", "first_id", "rep"), "sid")
    best = found.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("rep").alias("least_rep"))
    best = found.select("sid", "root").join(best, "root").drop("root")
    sets = sets.select("set", "sid", "n", "first_id", "rep").join(best, "sid", "left")
    # without a null id the least row of a component is that of its id
    first = F.when(F.col("component_id").isNull(), F.col("rep")).otherwise(F.col("least_rep"))
    sets = ws.save(sets.select("set", "n", F.coalesce("component_id", "first_id").alias("component_id"), first.alias("first")), "components")
    full = join_groups(sketch.filter("n_shingles > 0").drop("bands"), sets, "set", "n")
    columns = ["__id", "__h", "n_shingles", "component_id", "first"]
    empty = sketch.filter("n_shingles = 0").withColumn("component_id", F.col("__id")).withColumn("first", own)
    out = full.select(*columns).unionByName(empty.select(*columns))
    return out.select("__id", "__h", F.col("__id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(False)).alias("kept"), "first")


def dedup(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, the one with its id; all columns. Documents without words stay, repeats cut to one."""
    ws = Workspace(docs.sparkSession, "near-rows")
    out = near_groups(docs, **how).withColumn("kept", F.struct("__id", "__h") == F.col("first"))
    copies = ws.save(out.groupBy("__id", "__h").agg(F.count("*").alias("copies"), F.bool_or("kept").alias("kept")), "rows")
    return select_rows(docs, copies.filter("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
