"""Quality classifier: importance resampling with hashed n-gram models of target and raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import ensure_importable

from ._util import Workspace, documents, raw_texts, row_key, slices
from .hashing import Substrings, mix

QUERY = "op6_quality_classifier"
_U = np.uint64
#: Buckets of hashed words, and as many of hashed pairs of words.
BUCKETS = 1 << 16
#: Labelled documents that the target model and the threshold are fitted on, at most.
MAX_LABELLED = 200_000
#: Kinds of bytes: blank, letter (every byte beyond ASCII too), digit, sign.
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
#: Stands for a word that repeats the word before it, whatever word it is.
_AGAIN = _U(0x5851F42D4C957F2D)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of each word with the one before it, whether there is such a one, offsets by text).

    Words are runs of letters, of digits or of signs, case kept; one that repeats the word before it (signs between
    them aside) becomes one and the same word of its own, so repetition has n-grams however rare the repeated words.
    """
    raw = b"\n".join(texts) + b"\n"
    kind = np.zeros(len(raw) + 2, np.uint8)
    buf = np.frombuffer(raw, np.uint8)
    kind[1:-1] = _KIND[buf]
    change = np.flatnonzero(kind[1:] != kind[:-1])
    s, e = change[:-1], change[1:]
    kinds = kind[s + 1]
    s, e, kinds = s[kinds > 0], e[kinds > 0], kinds[kinds > 0]
    edges = np.concatenate([[0], np.searchsorted(s, np.cumsum([len(t) + 1 for t in texts]))])
    h = mix(Substrings(buf).hash(s, e) + (e - s).astype(_U))
    owner = np.repeat(np.arange(len(texts)), np.diff(edges))
    word = np.flatnonzero(kinds < 3)
    again = word[1:][(h[word[1:]] == h[word[:-1]]) & (owner[word[1:]] == owner[word[:-1]])]
    h[again] = _AGAIN
    inner = np.ones(len(s), bool)
    inner[edges[:-1][np.diff(edges) > 0]] = False
    before = np.concatenate([h[:1], h[:-1]])
    pair = mix(before * _U(0x9E3779B97F4A7C15) + h)
    return (h >> _U(48)).astype(np.int64), (pair >> _U(48)).astype(np.int64), inner, edges


def _counted(target: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2 * BUCKETS), np.int64)
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            labelled = np.isin(batch.column("doc_id").to_numpy(zero_copy_only=False), target)
            for i, j in slices(texts):
                one, two, inner, edges = features(texts[i:j])
                own = np.repeat(labelled[i:j], np.diff(edges))
                for k, some in enumerate((slice(None), own)):
                    total[k, :BUCKETS] += np.bincount(one[some], minlength=BUCKETS)
                    total[k, BUCKETS:] += np.bincount(two[some][inner[some]], minlength=BUCKETS)
        k = np.flatnonzero(total[0])
        yield pa.record_batch([pa.array(k), pa.array(total[0, k]), pa.array(total[1, k])], ["bucket", "raw", "target"])

    return run


def _gumbel(key: np.ndarray, seed: int) -> np.ndarray:
    u = (mix(key.astype(_U) + mix(np.array([seed + 1], _U))) >> _U(11)).astype(np.float64) / 2.0**53
    return -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))


def _weigh(ratio: np.ndarray, seed: int, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Log importance weight of each text, alone and with its Gumbel noise.

    The log ratios of a text's n-grams are summed and tempered by the root of its number of words: errors of the models
    add up like that, so a plain sum would let those of long texts outweigh junk in short ones.
    """
    texts = raw_texts(batch.column("text"))
    out = np.zeros(len(texts))
    for i, j in slices(texts):
        one, two, inner, edges = features(texts[i:j])
        sums = np.concatenate([[0.0], np.cumsum(ratio[one] + np.where(inner, ratio[BUCKETS + two], 0.0))])
        out[i:j] = (sums[edges[1:]] - sums[edges[:-1]]) / np.sqrt(np.maximum(np.diff(edges), 1))
    return out, out + _gumbel(batch.column("__h").to_numpy(), seed)


def _targets(labels: DataFrame, most: int) -> np.ndarray:
    """doc_ids of at most `most` target documents (quality 1), chosen by hash."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    good = good.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    if (n := good.count()) > most:  # little more than `most` ids leave the tasks
        good = good.filter(F.col("h") < int((1 << 40) * min(1.0, 1.05 * most / n)))
    return np.sort(np.array([r[0] for r in good.orderBy("h", "doc_id").limit(most).select("doc_id").collect()], np.int64))


def fit(docs: DataFrame, target: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket: target model over raw model, add-one smoothed; raw counts come from every document.

    Each task sends at most 2 * BUCKETS rows and the model has as many entries, whatever the input.
    """
    ensure_importable(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc_id"), "text")
    counts = rows.mapInArrow(_counted(target), "bucket long, raw long, target long")
    total = np.zeros((2, 2 * BUCKETS))
    for r in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        total[:, r[0]] = r[1], r[2]
    out = np.zeros(2 * BUCKETS)
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        raw, good = total[0, part] + 1, total[1, part] + 1
        out[part] = np.log(good / good.sum()) - np.log(raw / raw.sum())
    return out if total[1].any() else np.zeros(2 * BUCKETS)


def kth_largest(df: DataFrame, column: str, k: int, at_once: int = 50_000) -> float | None:
    """The k-th largest value, exactly: by histograms of 1024 bins within the bin that holds it."""
    if k < 1:
        return None
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    while n > at_once and low < high:
        step = (high - low) / 1024
        number = F.least(F.floor((F.col(column) - low) / step), F.lit(1023)) if step > 0 else F.lit(0)
        bins = df.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(bins.collect(), key=lambda r: -r["low"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        if r["n"] == n:
            break
        low, high, n = r["low"], r["high"], r["n"]
        df = df.filter(F.col(column).between(low, high))
    return df.select(column).orderBy(F.desc(column)).limit(k).agg(F.min(column)).first()[0]


class Sampler:
    """Fitted models and the threshold that the k-th largest perturbed weight sets."""

    def __init__(self, ratio: np.ndarray, seed: int, threshold: float | None):
        self.ratio, self.seed, self.threshold = ratio, seed, threshold

    def weigh(self, docs: DataFrame) -> DataFrame:
        ratio, seed = docs.sparkSession.sparkContext.broadcast(self.ratio), self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                alone, noisy = _weigh(ratio.value, seed, batch)
                yield pa.record_batch([batch.column("doc_id"), pa.array(alone), pa.array(noisy)], ["doc_id", "log_weight", "perturbed"])

        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("__h"), "text")
        return rows.mapInArrow(run, "doc_id long, log_weight double, perturbed double")

    def select(self, docs: DataFrame) -> DataFrame:
        """Narrow: weighs each document again in place of shuffling texts."""
        ratio, seed, least = docs.sparkSession.sparkContext.broadcast(self.ratio), self.seed, self.threshold
        columns = docs.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = _weigh(ratio.value, seed, batch)[1] >= least
                yield batch.drop_columns(["__h"]).filter(pa.array(keep))

        if least is None:
            return docs
        return docs.withColumn("__h", F.xxhash64(F.col("doc_id").cast("bigint"), "text")).select(*columns, "__h").mapInArrow(run, docs.schema)


def sampler(docs: DataFrame, labels: DataFrame, k: int | None = None, recall: float = 0.999, margin: float = 5.0, seed: int = 0, max_labelled: int = MAX_LABELLED) -> tuple[Sampler, DataFrame]:
    """(fitted sampler, its weights of all documents).

    k is the size of the sample. By default it is the number of documents whose log weight is not `margin` below what
    all but 1 - recall of the labelled target documents reach; `margin` allows for the Gumbel noise, which takes at
    most some 3 from a weight. Without labelled target documents and k every document is in the sample.
    """
    ws = Workspace(docs.sparkSession, "dsir")
    target = _targets(labels, max_labelled)
    first = Sampler(fit(docs, target), seed, None)
    weights = ws.save(first.weigh(docs), "weights")
    if k is None:
        if not len(target):
            return first, weights
        known = docs.sparkSession.createDataFrame([(int(x),) for x in target], "doc_id long")
        low = weights.join(F.broadcast(known), "doc_id").agg(F.percentile("log_weight", 1 - recall)).first()[0]
        if low is None:
            return first, weights
        k = weights.filter(F.col("log_weight") >= low - margin).count()
    first.threshold = kth_largest(weights, "perturbed", k) if k > 0 else float("inf")
    return first, weights


def weights(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, log_weight, perturbed (with Gumbel noise), kept (one of the k largest perturbed).

    The noise comes from a hash of doc_id and text, so reruns agree, repeated rows fare alike, and ties at the
    threshold all stay. Null and empty texts weigh 0. Null doc_ids are never labelled. An empty table gives no rows.
    Columns other than doc_id and text, and labels' other than doc_id and quality, play no part.
    """
    fitted, out = sampler(docs, labels, **how)
    kept = F.lit(True) if fitted.threshold is None else F.col("perturbed") >= fitted.threshold
    return out.withColumn("kept", kept)


def sample(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents in the sample, all columns, whatever their names. Null and empty texts weigh 0 and are judged by
    that and their noise; repeated rows fare alike, ties at the threshold all stay, an empty table stays empty."""
    return sampler(docs, labels, **how)[0].select(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
