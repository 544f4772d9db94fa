"""Packing documents into fixed windows that each hold the sources in target proportions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import Workspace, documents
from .tokens import encoder

QUERY = "op1_pack_mixture"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class Schedule:
    """Deficit round-robin over source queues in closed form.

    Source s holds tokens[s] tokens and has weight[s]. Its block b of `quantum` tokens falls due at virtual time
    (b + 1/2) * quantum / weight[s]; blocks are served by due time, then by source. So a source's deficit (what its
    weight entitles it to, less what it was served) stays within a quantum at every window's end, is carried from each
    window to the next, and a queue that runs dry leaves its share to the others. As served(p) depends on nothing but
    p, tasks compute the windows they need on their own: the deficits carry across partitions without a scan.
    Windows are `length` long; what is left at the end is cut into powers of two, so nothing is padded.
    """

    def __init__(self, tokens: list[int], weights: list[float] | None = None, length: int = 2048, quantum: int = 1):
        self.tokens = np.array(tokens, np.int64)
        self.weights = np.array([w or 1e-9 for w in weights] if weights else np.maximum(self.tokens, 1), np.float64)
        self.length, self.quantum, self.total = length, quantum, int(self.tokens.sum())
        self.whole, rest = divmod(self.total, length)
        self.tail = [1 << k for k in reversed(range(length.bit_length())) if rest >> k & 1]
        self.windows = self.whole + len(self.tail)

    def start(self, w: np.ndarray) -> np.ndarray:
        """Tokens before window w."""
        tail = np.concatenate([[0], np.cumsum(self.tail, dtype=np.int64)])
        return np.minimum(w, self.whole) * self.length + tail[np.clip(w - self.whole, 0, len(self.tail))]

    def window(self, p: np.ndarray) -> np.ndarray:
        """The window of global position p."""
        tail = np.cumsum(self.tail, dtype=np.int64)
        return np.where(p < self.whole * self.length, p // self.length, self.whole + np.searchsorted(tail, p - self.whole * self.length, "right"))

    def due(self, t: np.ndarray) -> np.ndarray:
        """Tokens of each source due by times t."""
        with np.errstate(over="ignore"):
            blocks = np.floor(np.minimum(t[:, None] * (self.weights / self.quantum) + 0.5, 2.0**62))
        return np.minimum(blocks * self.quantum, self.tokens).astype(np.int64)

    def served(self, p: np.ndarray) -> np.ndarray:
        """Tokens of each source among the first p; each row sums to p."""
        low = np.zeros(len(p))
        high = np.full(len(p), (self.tokens / self.weights).max(initial=0.0) + (self.quantum / self.weights).max(initial=1.0) + 1.0)
        for _ in range(200):
            mid = (low + high) / 2
            if not ((low < mid) & (mid < high)).any():
                break
            fits = self.due(mid).sum(1) <= p
            low, high = np.where(fits, mid, low), np.where(fits, high, mid)
        out = self.due(low)
        step = np.maximum(self.due(high) - out, 0)  # blocks due at one time: in the order of sources
        before = np.cumsum(step, 1) - step
        return out + np.clip((p - out.sum(1))[:, None] - before, 0, step)

    def served_to(self, p: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of the sources `ranks` among the first p, of all sources before each of them); few p at a time."""
        at_once = max(1, min(4096, (1 << 22) // max(len(self.tokens), 1)))
        own, before = np.zeros((len(p), len(ranks)), np.int64), np.zeros((len(p), len(ranks)), np.int64)
        for k in range(0, len(p), at_once):
            all_ = self.served(p[k : k + at_once])
            own[k : k + at_once] = all_[:, ranks]
            before[k : k + at_once] = (np.cumsum(all_, 1) - all_)[:, ranks]
        return own, before

    def span(self, source: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows [first, last] that surely hold the tokens [a, b) of a source; a few more at either end."""
        time = lambda j: (j // self.quantum + 0.5) * self.quantum / self.weights[source]
        slack = len(self.tokens) * self.quantum + 2
        early, late = time(a), time(b - 1)
        at_once = max(1, (1 << 22) // max(len(self.tokens), 1))
        ahead = lambda t: np.concatenate([self.due(t[k : k + at_once]).sum(1) for k in range(0, len(t), at_once)])
        first = ahead(early * (1 - 1e-12)) - slack
        last = ahead(late * (1 + 1e-12)) + slack
        return self.window(np.maximum(first, 0)), self.window(np.minimum(last, self.total - 1))


def _tokenised(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Tokens of each document with their place in the queue of its source: within a partition, in the order of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, ahead = encoder(vocabulary).encode, np.array([end_id], "<u2").tobytes(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                keys, starts, ids = some.column("source").to_pylist(), [], []
                for key, text in zip(keys, some.column("text").to_pylist()):
                    x = encode(text) + end if text else end
                    starts.append(ahead.get(key, 0))
                    ahead[key] = starts[-1] + len(x) // 2
                    ids.append(x)
                columns = [some.column(c) for c in ("doc_id", "source", "part")]
                columns += [pa.array(starts, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.record_batch(columns, ["doc_id", "source", "part", "start", "n", "ids"])

    source = F.col("source").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source.alias("source"), F.spark_partition_id().alias("part"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, part int, start long, n long, ids binary")


def _cut(plan: Schedule, batch: pa.RecordBatch, with_ids: bool) -> Iterator[pa.RecordBatch]:
    start = batch.column("start").to_numpy() + batch.column("base").to_numpy()
    n, rank, ids = batch.column("n").to_numpy(), batch.column("rank").to_numpy().astype(np.int64), batch.column("ids").to_pylist()
    doc, source = batch.column("doc_id"), batch.column("source")
    first, last = plan.span(rank, start, start + n)
    need = np.unique(np.concatenate([np.arange(x, y + 2) for x, y in zip(first, last)]))
    ranks, column = np.unique(rank, return_inverse=True)
    served, inside = plan.served_to(plan.start(need), ranks)  # inside of the windows' ends minus starts: what earlier sources take
    row, s, size, w, offset, crc, cut = [], [], [], [], [], [], []
    for i in range(len(n)):
        lo, r = int(np.searchsorted(need, first[i])), column[i]
        hi = lo + int(last[i] - first[i]) + 2
        edge = served[lo:hi, r] - start[i]
        a, b = np.maximum(edge[:-1], 0), np.minimum(edge[1:], n[i])
        k = np.flatnonzero(a < b)
        off = inside[lo + k + 1, r] - inside[lo + k, r] + a[k] - edge[k]
        wide = memoryview(np.frombuffer(ids[i], "<u2").astype("<u4").tobytes())
        for x, y in zip((4 * a[k]).tolist(), (4 * b[k]).tolist()):
            crc.append(zlib.crc32(wide[x:y]))
            if with_ids:
                cut.append(np.frombuffer(wide[x:y], "<u4").astype(np.int32))
        row.append(np.full(len(k), i)), s.append(a[k]), size.append(b[k] - a[k]), w.append(need[lo + k]), offset.append(off)
    row, s, size, w, offset = map(np.concatenate, (row, s, size, w, offset))
    take = pa.array(row, pa.int64())
    columns = [doc.take(take), pa.array(s), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(w), pa.array(offset), source.take(take)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    if with_ids:
        columns.append(pa.array(cut, pa.list_(pa.int32())))
    yield pa.record_batch(columns, [*names, "ids"][: len(columns)])


def pack(docs: DataFrame, weights: dict[str | None, float] | None = None, length: int = 2048, quantum: int = 1, with_ids: bool = False,
         vocabulary: str = "byte_bpe_50k", end_id: int = 1) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in which sequence, at which offset.

    Every document (null and empty texts too: the end id alone) is tokenised once and cut freely over windows of
    `length` tokens so that each window holds every source within `quantum` tokens of its target share; `weights`
    gives the shares, by default in proportion to the sources' tokens, which uses up all queues at one time. Sources
    that weights lacks come last. Every source is a queue of its own, however many there are: each task holds one total
    and weight a source, and the time a window takes grows with their number.
    Repeated rows are documents of their own. Tokens are written once; no text is shuffled, and no token
    up to a million pairs of a source and a task of the first pass.
    An empty table gives no rows. Columns other than doc_id, text and source play no part.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "pack")
    tokens = ws.save(_tokenised(docs, vocabulary, end_id), "tokens")
    parts = ws.save(tokens.groupBy("source", "part").agg(F.sum("n").alias("tokens")), "parts")
    totals = sorted(((r["source"], r["tokens"]) for r in parts.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()), key=lambda x: (x[0] is None, x[0]))
    schema = _PIECES + ", ids array<int>" * with_ids
    if not totals:
        return spark.createDataFrame([], schema)
    shares = [weights.get(q, 0) for q, _ in totals] if weights else None
    plan = Schedule([t for _, t in totals], shares, length, quantum)
    shared = spark.sparkContext.broadcast(plan)
    ranks = spark.createDataFrame([(q, k) for k, (q, _) in enumerate(totals)], "s string, rank int")
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = parts.select(F.col("source").alias("q"), F.col("part").alias("p"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    bases = bases.join(ranks, F.col("q").eqNullSafe(F.col("s"))).select("q", "p", "base", "rank")
    # one row for each task of the first pass and source: broadcast up to a million of them, else shuffled
    bases = F.broadcast(bases) if parts.count() <= 1_000_000 else bases
    rows = tokens.join(bases, F.col("source").eqNullSafe(F.col("q")) & (F.col("part") == F.col("p")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield from _cut(shared.value, batch.slice(at, 1024), with_ids)

    return rows.select("doc_id", "source", "start", "base", "n", "rank", "ids").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), quantum=32).drop("source")
